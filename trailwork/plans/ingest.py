"""Queries of the sources, sinks, catalogs and streams: logs are rendered from web_events and parsed back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from trailwork.functions.tables import once
from trailwork.operators import compare as X
from trailwork.operators import findings as FD
from trailwork.operators import matching as M
from trailwork.plans.base import CTES, EVENTS_SPARK, FRAGMENT, HEADER, query, with_headers
from trailwork.sources import intel, logs, sinks
from trailwork.streaming import streams

_OR = lambda c, other="'-'": F.coalesce(F.col(c).cast("string"), F.expr(other))


def _target():
    return F.concat(F.coalesce("uri_path", F.lit("bad path")), F.coalesce(F.concat(F.lit("?"), "uri_query"), F.lit("")))


_WHOLE = "ts IS NOT NULL AND source_ip IS NOT NULL AND uri_path IS NOT NULL"


def _lines(t, line):
    # A line is put together once, whatever filters and parsers ask of it.
    rows = once(t.events.filter("ts is not null and source_ip is not null"), line=line)
    return rows.select(F.lit("log").alias("input_file"), F.col("event_id").alias("line_number"), "line")


def _combined_line():
    return F.concat("source_ip", F.lit(" - - ["), F.date_format("ts", "dd/MMM/yyyy:HH:mm:ss Z"), F.lit('] "'), "method", F.lit(" "), _target(), F.lit(' HTTP/1.1" '), _OR("status"), F.lit(" "), _OR("response_bytes"), F.lit(' "-" "'), _OR("user_agent"), F.lit('"'))


def _seen(df):
    return df.select(F.col("line_number").alias("event_id"), F.unix_timestamp("ts").alias("at_s"), "source_ip", "method", "uri_path", "uri_query", "status", "response_bytes", "user_agent")


_SEEN = f"SELECT event_id, sec AS at_s, source_ip, method, uri_path, uri_query, status, response_bytes, user_agent FROM e WHERE {_WHOLE}"


@query("parse_combined", _SEEN)
def _(t):
    return _seen(logs.split_errors(logs.parse_combined(_lines(t, _combined_line())))[0])


@query("parse_vhost_combined", f"SELECT event_id, coalesce(host, 'none.example') AS host, uri_path, status FROM e WHERE {_WHOLE}")
def _(t):
    rows = logs.parse_vhost_combined(_lines(t, F.concat(F.coalesce("host", F.lit("none.example")), F.lit(":443 "), _combined_line())), plain_first=True)
    return logs.split_errors(rows)[0].select(F.col("line_number").alias("event_id"), "host", "uri_path", "status")


@query("parse_nginx_postdata", f"SELECT event_id, coalesce(host, 'none') AS host, 'text/plain' AS content_type, 'TLSv1.3' AS tls_protocol, event_id % 7 / 10.0 AS request_time_seconds, 'a=1' AS request_body, uri_path FROM e WHERE {_WHOLE}")
def _(t):
    line = F.concat(F.lit("2024 Jan 02 03:04:05 (x) a->/var/log/"), F.coalesce("host", F.lit("none")), F.lit("_access_2.log "), _combined_line(), F.lit(' "text/plain" "TLSv1.3" "AES" '), (F.col("event_id") % 7 / 10.0).cast("string"), F.lit(" postdata[a=1]"))
    return logs.split_errors(logs.parse_nginx_postdata(_lines(t, line)))[0].select(F.col("line_number").alias("event_id"), "host", "content_type", "tls_protocol", "request_time_seconds", "request_body", "uri_path")


#: What is wrong with the lines of events by event_id % 9, and the reason it has.
_BAD = {1: "not-combined", 2: "timestamp", 3: "request-line", 4: "target", 5: "percent-escape", 6: "line-too-long"}


@query("parse_error_summary", "SELECT reason, count(*) AS lines FROM (SELECT CASE event_id % 9 " + " ".join(f"WHEN {k} THEN '{r}'" for k, r in _BAD.items()) + " ELSE CASE WHEN uri_path IS NULL THEN 'request-line' END END AS reason FROM e WHERE ts IS NOT NULL AND source_ip IS NOT NULL) WHERE reason IS NOT NULL GROUP BY 1")
def _(t):
    k, good = F.col("event_id") % 9, _combined_line()
    line = F.when(k == 1, F.lit("no log line")).when(k == 2, F.replace(good, F.lit("/2024:"), F.lit("/x024:"))).when(k == 3, F.replace(good, F.lit(" HTTP/1.1"), F.lit(" GOPHER")))
    line = line.when(k == 4, F.regexp_replace(good, r'"[A-Z]+ .* HTTP', '"GET a HTTP')).when(k == 5, F.regexp_replace(good, r'"[A-Z]+ .* HTTP', '"GET /%zz HTTP')).when(k == 6, F.concat(good, F.repeat(F.lit("x"), F.lit(logs.LONGEST_LINE)))).otherwise(good)
    return logs.parse_error_summary(logs.split_errors(logs.parse_combined(_lines(t, line)))[1])


@query("parse_waf_json", "SELECT event_id, CAST(floor(epoch_us(ts) / 1000.0) AS BIGINT) AS ms, source_ip, method, uri_path, uri_query, coalesce(uri_path || '?' || uri_query, uri_path) AS uri, status, ja4, waf_action, request_id, host, user_agent FROM e WHERE ts IS NOT NULL AND source_ip IS NOT NULL")
def _(t):
    headers = F.array_compact(F.array(F.when(F.col("host").isNotNull(), F.struct(F.lit("Host").alias("name"), F.col("host").alias("value"))), F.when(F.col("user_agent").isNotNull(), F.struct(F.lit("user-agent").alias("name"), F.col("user_agent").alias("value")))))
    request = F.struct(F.col("source_ip").alias("clientIp"), F.col("uri_path").alias("uri"), F.col("uri_query").alias("args"), F.col("method").alias("httpMethod"), F.col("request_id").alias("requestId"), headers.alias("headers"))
    line = F.to_json(F.struct(F.unix_millis("ts").alias("timestamp"), F.col("waf_action").alias("action"), F.col("status").alias("responseCodeSent"), F.col("ja4").alias("ja4Fingerprint"), request.alias("httpRequest")))
    rows = logs.split_errors(logs.parse_waf_json(_lines(t, line)))[0]
    return rows.select(F.col("line_number").alias("event_id"), F.unix_millis("ts").alias("ms"), "source_ip", "method", "uri_path", "uri_query", "uri", "status", "ja4", "waf_action", "request_id", "host", "user_agent")


@query("parse_alb", f"SELECT event_id, sec AS at_s, source_ip, CAST(1024 + event_id % 1000 AS INT) AS source_port, coalesce(host, 'none.example') AS host, method, uri_path, uri_query, status, response_bytes, user_agent FROM e WHERE {_WHOLE}")
def _(t):
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    parts = [F.lit("https"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("app/lb/1"), F.concat("source_ip", F.lit(":"), (1024 + F.col("event_id") % 1000).cast("string")), F.lit("10.0.0.1:80 0.0 0.0 0.0"), _OR("status"), F.lit("200 34"), _OR("response_bytes")]
    parts += [quoted(F.concat("method", F.lit(" https://"), F.coalesce("host", F.lit("none.example")), F.lit(":443"), _target(), F.lit(" HTTP/1.1"))), quoted(_OR("user_agent")), F.lit("AES TLSv1.3 arn:group"), quoted(F.lit("Root=1"))]
    rows = logs.split_errors(logs.parse_alb(_lines(t, F.concat_ws(" ", *parts)).filter("not contains(line, 'bad path')")))[0]
    return rows.select(F.col("line_number").alias("event_id"), F.unix_timestamp("ts").alias("at_s"), "source_ip", "source_port", F.regexp_replace("host", r":\d+$", "").alias("host"), "method", "uri_path", "uri_query", "status", "response_bytes", "user_agent")


@query("parse_cloudfront", f"SELECT event_id, sec AS at_s, source_ip, method, uri_path, uri_query, status, response_bytes, user_agent FROM e WHERE {_WHOLE}")
def _(t):
    cells = [F.date_format("ts", "yyyy-MM-dd"), F.date_format("ts", "HH:mm:ss"), F.lit("EDGE"), _OR("response_bytes"), F.col("source_ip"), F.col("method"), _OR("host"), F.col("uri_path"), _OR("status"), F.lit("-"), F.coalesce(F.replace("user_agent", F.lit(" "), F.lit("%20")), F.lit("-")), _OR("uri_query"), F.lit("session=1"), F.lit("Hit"), _OR("request_id"), _OR("host"), F.lit("https"), F.lit("10"), F.lit("0.1")]
    lines = _lines(t, F.concat_ws("\t", *cells)).filter("size(split(line, '\t')) = 19")
    header = t.spark.createDataFrame([("log", -1, "#Version: 1.0"), ("log", 0, "#Fields: " + " ".join(logs.CLOUDFRONT_FIELDS))], "input_file string, line_number long, line string")
    return _seen(logs.split_errors(logs.parse_cloudfront(lines.unionByName(header)))[0])


#: A line of each format, by event_id % 7.
_KINDS = ["combined", "vhost", "nginx-postdata", "waf", "alb", "cloudfront", "unknown"]


@query("detect_format", "SELECT DISTINCT CASE event_id % 7 " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(_KINDS)) + " END AS input_file, input_file AS format, CASE event_id % 7 WHEN 0 THEN 2 WHEN 6 THEN 0 ELSE 1 END AS sources FROM e WHERE ts IS NOT NULL AND source_ip IS NOT NULL AND event_id <= 1000")
def _(t):
    e = t.events.filter("ts is not null and source_ip is not null")
    k, good = F.col("event_id") % 7, F.regexp_replace(_combined_line(), "bad path", "/x")
    kind = F.get(F.array(*map(F.lit, _KINDS)), k.cast("int"))
    line = F.when(k == 0, good).when(k == 1, F.concat(F.lit("www.example.org:80 "), good)).when(k == 2, F.concat(good, F.lit(' "text/plain" "-" "-" 0.1 postdata[a=1]'))).when(k == 3, F.lit('{"timestamp": 1, "httpRequest": {}}')).when(k == 4, F.lit("https 2024-01-01T00:00:00Z lb")).when(k == 5, F.lit("#Version: 1.0")).otherwise(F.lit("free text"))
    found = logs.detect_format(e.select(kind.alias("input_file"), F.col("event_id").alias("line_number"), line.alias("line")))
    return found.select("input_file", "format", F.size("sources").alias("sources"))


@query("read_indicators", "SELECT type, value, CASE WHEN type = 'hash' THEN 'unknown-type' WHEN type = 'path' AND NOT starts_with(value, '/') THEN 'invalid-path' END AS reason FROM (SELECT DISTINCT CASE event_id % 4 WHEN 0 THEN 'ip' WHEN 1 THEN 'path' WHEN 2 THEN 'hash' ELSE 'host' END AS type, CASE event_id % 4 WHEN 0 THEN source_ip WHEN 1 THEN event_type WHEN 2 THEN 'x' ELSE 'h' || CAST(event_id % 5 AS VARCHAR) END AS value FROM (SELECT e.*, v.event_type FROM e JOIN events v USING (event_id)) WHERE source_ip IS NOT NULL)")
def _(t):
    e = t.events.filter("source_ip is not null").join(t.read("events").select("event_id", "event_type"), "event_id")
    line = F.expr("concat_ws('\t', element_at(array('IP', 'path', 'hash', 'host'), cast(event_id % 4 + 1 as int)), element_at(array(source_ip, event_type, 'x', concat('h', event_id % 5)), cast(event_id % 4 + 1 as int)), 'label')")
    return intel.parse_indicators(e.select(line.alias("line"))).select("type", "value", "reason")


@query("normalize_blocklist", "SELECT DISTINCT 'ip' AS scope, source_ip AS value, CAST(85 AS BIGINT) AS score, 'addresses' AS source FROM e WHERE source_ip IS NOT NULL AND event_id % 2 = 0")
def _(t):
    lines = t.events.filter("source_ip is not null").select(F.when(F.col("event_id") % 2 == 0, F.concat("source_ip", F.lit(" ; listed"))).otherwise(F.concat(F.lit("# "), "source_ip")).alias("line"))
    return intel.normalize_blocklist(lines, "addresses")


@query("read_address_set", "SELECT DISTINCT concat(split_part(source_ip,'.',1),'.',split_part(source_ip,'.',2),'.',split_part(source_ip,'.',3),'.0/24') AS network, CAST(NULL AS VARCHAR) AS reason FROM e WHERE source_ip IS NOT NULL")
def _(t):
    return intel.parse_address_set(t.events.filter("source_ip is not null").select(F.concat("source_ip", F.lit("/24 # seen")).alias("line")))


#: Rule templates in the shape of a catalog, derived from parts.
_TEMPLATES = "SELECT p_partkey AS k, concat('CVE-2024-', CAST(1000 + p_partkey % 400 AS VARCHAR(9))) AS cve, CASE WHEN p_size % 3 = 0 THEN 'not-observable' ELSE 'observable' END AS detectability, CASE WHEN p_size % 4 = 0 THEN 'unsupported' ELSE 'converted' END AS conversion_status, CASE WHEN p_size % 5 = 0 THEN 'failed' ELSE 'passed' END AS validation_status, p_size % 6 AS h FROM part"
CTES["tem"] = f"tem AS ({_TEMPLATES})"


def _templates(t):
    t.read("part").createOrReplaceTempView("trailwork_part")
    rows = t.spark.sql(_TEMPLATES.replace("VARCHAR(9)", "STRING").replace("FROM part", "FROM trailwork_part"))
    headers = F.when(F.col("h") == 0, F.array()).when(F.col("h") == 1, F.array(F.lit("cookie"))).when(F.col("h") == 2, F.array(F.lit("host"), F.lit("cookie"))).when(F.col("h") == 3, F.array(F.lit("host"))).when(F.col("h") == 4, F.array(F.lit("x-auth"))).otherwise(F.array())
    return rows.select(F.col("k").cast("string").alias("template_id"), F.array("cve").alias("cves"), "detectability", "conversion_status", "validation_status", headers.cast("array<string>").alias("required_headers"))


def _kev(t):
    return t.read("supplier").select(F.concat(F.lit(" cve-2024-"), (1000 + F.col("s_suppkey") * 7 % 450).cast("string")).alias("cve_id"))


CTES["kevs"] = "kevs AS (SELECT DISTINCT concat('CVE-2024-', CAST(1000 + s_suppkey * 7 % 450 AS VARCHAR)) AS cve FROM supplier)"


@query("template_reasons", "SELECT reason, count(*) AS templates FROM (SELECT k, unnest(CASE h WHEN 0 THEN CAST([] AS VARCHAR[]) WHEN 1 THEN ['header-needed'] ELSE ['header-needed', 'body-matcher'] END) AS reason FROM tem) GROUP BY 1", "tem")
def _(t):
    # Parts of one size need as many headers; the reasons go with them, one of them twice.
    h = F.col("template_id").cast("long")
    sized = _templates(t).join(t.read("part").select(F.col("p_partkey").alias("k"), (F.col("p_size") % 6).alias("h")), h == F.col("k"))
    reasons = F.when(F.col("h") == 0, F.array().cast("array<string>")).when(F.col("h") == 1, F.array(F.lit("header-needed"))).otherwise(F.array(F.lit("header-needed"), F.lit("body-matcher"), F.lit("body-matcher")))
    return X.template_reasons(sized.withColumn("reasons", reasons))


@query("header_coverage", "SELECT (SELECT count(*) FROM tem) AS templates, (SELECT count(*) FROM tem WHERE h NOT IN (1, 2, 4)) AS observable, count(*) AS cves, count(*) FILTER (seen) AS observable_cves, count(*) FILTER (cve IN (SELECT cve FROM kevs)) AS kevs, count(*) FILTER (seen AND cve IN (SELECT cve FROM kevs)) AS observable_kevs FROM (SELECT cve, bool_or(h NOT IN (1, 2, 4)) AS seen FROM tem GROUP BY 1)", "tem kevs")
def _(t):
    return X.header_coverage(_templates(t), _kev(t), ["Host", "Referer"])


@query("normalize_ranges", "SELECT start_ip, asn, CASE k WHEN 0 THEN 'address' WHEN 1 THEN 'order' WHEN 2 THEN 'asn' WHEN 3 THEN 'unassigned' END AS reason, count(*) AS rows_read FROM (SELECT event_id % 6 AS k, CASE event_id % 6 WHEN 0 THEN 'no address' WHEN 1 THEN '198.51.9.9' ELSE source_ip END AS start_ip, CASE event_id % 6 WHEN 2 THEN NULL WHEN 3 THEN 0 ELSE user_id % 7 END AS asn FROM e JOIN events USING (event_id) WHERE source_ip IS NOT NULL AND NOT (event_id % 6 > 3 AND user_id % 7 = 0)) GROUP BY ALL")
def _(t):
    k = F.col("event_id") % 6
    e = t.events.join(t.read("events").select("event_id", "user_id"), "event_id").filter("source_ip is not null and not (event_id % 6 > 3 and user_id % 7 = 0)")
    start = F.when(k == 0, "no address").when(k == 1, "198.51.9.9").otherwise(F.col("source_ip"))
    end = F.when(k == 1, "198.51.9.0").otherwise(F.lit("198.51.6.255"))
    asn = F.when(k == 2, "x").when(k == 3, "0").otherwise((F.col("user_id") % 7).cast("string"))
    rows = intel.normalize_ranges(e.select(F.concat_ws("\t", start, end, asn, F.lit("ZZ"), F.lit("Example")).alias("line")))
    return rows.groupBy("start_ip", "asn", "reason").agg(F.count("*").alias("rows_read"))


@query("corpus_union", f"SELECT event_id, source_ip, uri_path, status, CASE WHEN event_id % 2 = 1 THEN ja4 END AS ja4, CASE WHEN event_id % 2 = 1 THEN 'aws-waf' ELSE 'nginx' END AS log_source FROM e WHERE {_WHOLE}")
def _(t):
    lines = _lines(t, _combined_line())
    request = F.struct(F.col("source_ip").alias("clientIp"), F.col("uri_path").alias("uri"), F.col("method").alias("httpMethod"))
    waf = _lines(t, F.to_json(F.struct(F.unix_millis("ts").alias("timestamp"), F.col("status").alias("responseCodeSent"), F.col("ja4").alias("ja4Fingerprint"), request.alias("httpRequest"))))
    parts = [logs.split_errors(logs.parse_combined(lines.filter("line_number % 2 = 0")))[0], logs.split_errors(logs.parse_waf_json(waf.filter("line_number % 2 = 1")))[0].filter("uri_path is not null")]
    return logs.corpus_union(parts).select(F.col("line_number").alias("event_id"), "source_ip", "uri_path", "status", "ja4", "log_source")


@query("kev_coverage", "SELECT cve, count(k) AS templates, coalesce(max(CAST(detectability = 'observable' AS INT)), 0) = 1 AS web_relevant, CASE WHEN count(k) = 0 THEN 'no-template' WHEN max(CAST(validation_status = 'passed' AS INT)) = 1 THEN 'validated' WHEN max(CAST(conversion_status = 'converted' AS INT)) = 1 THEN 'converted' WHEN max(CAST(detectability = 'observable' AS INT)) = 1 THEN 'observable' ELSE 'not-observable' END AS state FROM kevs LEFT JOIN tem USING (cve) GROUP BY 1", "tem kevs")
def _(t):
    return X.kev_coverage(_kev(t), _templates(t))


@query("template_coverage", "SELECT detectability, conversion_status, count(*) AS templates, count(*) AS with_cve FROM tem GROUP BY 1, 2", "tem")
def _(t):
    return X.template_coverage(_templates(t))


@query("select_detections", "SELECT CAST(k AS VARCHAR) AS template_id FROM tem WHERE conversion_status = 'converted' AND validation_status = 'passed'", "tem")
def _(t):
    return intel.select_detections(_templates(t)).select("template_id")


@query("select_templates", "SELECT p_partkey AS template_id, CASE WHEN v = 'v1' OR p_partkey % 7 = 3 THEN 'denied' WHEN v IS NULL THEN 'unknown-vendor' WHEN v <> 'v2' AND p_partkey % 5 <> 4 THEN 'not-allowed' ELSE 'kept' END AS reason FROM (SELECT *, CASE WHEN p_partkey % 10 > 0 THEN concat('v', CAST(p_size % 4 AS VARCHAR)) END AS v FROM part)", "")
def _(t):
    k, numbered = F.col("p_partkey"), lambda name, n: F.concat(F.lit(name), n.cast("string"))
    rows = t.read("part").select(k.alias("template_id"), F.when(k % 10 > 0, numbered("v", F.col("p_size") % 4)).alias("vendor"), F.array(numbered("p", k % 5)).alias("products"), F.array(numbered("t", k % 7)).alias("tags"))
    return M.select_templates(rows, allow={"vendor": ["V2"], "products": ["P4"]}, deny={"vendor": ["V1"], "tags": ["T3"]}, exclude_unknown=True).select("template_id", "reason")


@query("telemetry_coverage", "SELECT profile, count(*) AS templates, count(*) FILTER (h IN (0, 5) OR (h = 3 AND profile <> 'none') OR (h IN (1, 2) AND profile = 'full')) AS observable FROM tem, (VALUES ('none'), ('combined'), ('full')) p(profile) GROUP BY 1", "tem")
def _(t):
    profiles = t.spark.createDataFrame([("none", []), ("combined", ["host", "user-agent"]), ("full", ["host", "cookie", "user-agent"])], "profile string, headers array<string>")
    return X.telemetry_coverage(_templates(t), profiles)


@query("header_value_ranking", "SELECT header, count(DISTINCT k) AS templates, count(DISTINCT k) FILTER (h <> 2) AS alone, count(DISTINCT cve) AS cves, count(DISTINCT cve) FILTER (cve IN (SELECT cve FROM kevs)) AS kevs FROM (SELECT *, unnest(CASE h WHEN 1 THEN ['cookie'] WHEN 2 THEN ['host', 'cookie'] WHEN 3 THEN ['host'] WHEN 4 THEN ['x-auth'] END) AS header FROM tem) WHERE header IS NOT NULL GROUP BY 1", "tem kevs")
def _(t):
    return X.header_value_ranking(_templates(t), _kev(t))


@query("condition_diff", "SELECT * FROM (SELECT name, sha256(b) AS baseline, sha256(c) AS current, CASE WHEN b IS NULL OR c IS NULL THEN 'unavailable' ELSE 'changed' END AS state FROM (SELECT event_type AS name, CAST(count(*) AS VARCHAR) AS b FROM events WHERE event_id % 2 = 0 GROUP BY 1) FULL JOIN (SELECT event_type AS name, CAST(count(*) AS VARCHAR) AS c FROM events WHERE event_id % 2 = 1 GROUP BY 1) USING (name) WHERE b IS DISTINCT FROM c)", "")
def _(t):
    b, c = (t.read("events").filter(f"event_id % 2 = {k}").groupBy(F.col("event_type").alias("name")).agg(F.count("*").cast("string").alias("value")) for k in (0, 1))
    return X.condition_diff(b, c)


#: Two manifests for each of 72 pairs of runs, by numbers that events have.
_MANIFESTS = """m AS (SELECT DISTINCT event_id % 72 AS pair, CASE event_id % 72 % 4 WHEN 0 THEN NULL ELSE 'combined' END AS p1, CASE event_id % 72 % 4 WHEN 1 THEN 'alb' ELSE 'combined' END AS p2, CASE WHEN event_id % 72 % 9 = 5 THEN 'wide' ELSE 'strict' END AS t2, CASE WHEN event_id % 72 % 3 = 0 THEN 'r2' ELSE 'r1' END AS r2, CASE WHEN event_id % 72 % 8 < 4 THEN '2024-01-02' END AS f2 FROM events)"""


@query("comparability", """SELECT pair, reasons = '' AS comparable, CASE WHEN reasons <> '' THEN 'not-comparable' WHEN f2 IS NULL AND r2 <> 'r1' THEN 'cti-revision' WHEN r2 = 'r1' AND f2 IS NOT NULL THEN 'calendar-window' ELSE 'artifact-diff' END AS kind, reasons FROM
    (SELECT *, concat_ws('; ', CASE WHEN p1 IS NULL THEN 'profile is unavailable for one or both runs' END, CASE WHEN p1 IS DISTINCT FROM p2 THEN 'profile differs' END, CASE WHEN t2 <> 'strict' THEN 'triage_policy differs' END) AS reasons FROM m)""", _MANIFESTS)
def _(t):
    pairs = t.read("events").select((F.col("event_id") % 72).alias("pair")).distinct()
    k, same = F.col("pair"), {"filter_to": F.lit(None).cast("string")}
    before = pairs.withColumns({"profile": F.when(k % 4 != 0, "combined"), "triage_policy": F.lit("strict"), "rules_revision": F.lit("r1"), "filter_from": F.lit(None).cast("string")} | same)
    after = pairs.withColumns({"profile": F.when(k % 4 == 1, "alb").otherwise("combined"), "triage_policy": F.when(k % 9 == 5, "wide").otherwise("strict"), "rules_revision": F.when(k % 3 == 0, "r2").otherwise("r1"), "filter_from": F.when(k % 8 < 4, "2024-01-02")} | same)
    return X.comparability(before, after)


@query("export_stix_objects", """SELECT 'vulnerability' AS type, cve AS value, CAST(NULL AS BIGINT) AS requests FROM fc GROUP BY cve UNION ALL SELECT 'note', string_agg(DISTINCT template_id, ';' ORDER BY template_id), count(DISTINCT event_id) FROM fd JOIN det_cves USING (template_id, ordinal) GROUP BY cve
    UNION ALL SELECT DISTINCT 'ipv4-addr', source_ip, CAST(NULL AS BIGINT) FROM fd WHERE source_ip IS NOT NULL UNION ALL SELECT DISTINCT 'x-uri-path', uri_path, CAST(NULL AS BIGINT) FROM fd""", "e det det_cves fd fc")
def _(t):
    objects = sinks.export_stix(FD.cve_summary(t.findings), "run-1", sinks.observables(t.findings))
    get = lambda name: F.get_json_object("object", f"$.{name}")
    return objects.select("type", F.coalesce(get("name"), get("value"), get("x_template_ids")).alias("value"), get("x_requests").cast("long").alias("requests"))


@query("export_misp", "SELECT 'vulnerability' AS type, cve AS value, concat('requests=', count(*)) AS comment FROM fc GROUP BY cve UNION ALL SELECT DISTINCT 'ip-src', source_ip, 'seen with a match, which is no verdict' FROM fd WHERE source_ip IS NOT NULL UNION ALL SELECT DISTINCT 'uri', uri_path, 'seen with a match, which is no verdict' FROM fd", "e det det_cves fd fc")
def _(t):
    rows = sinks.export_misp(FD.cve_summary(t.findings), "run-1", sinks.observables(t.findings))
    return rows.select(*[F.get_json_object("attribute", f"$.{c}").alias(c) for c in ("type", "value", "comment")])


@query("export_stix", """SELECT 'vulnerability' AS type, cve AS name FROM fc GROUP BY cve""", "e det det_cves fd fc")
def _(t):
    objects = sinks.export_stix(FD.cve_summary(t.findings), "run-1").filter("type = 'vulnerability'")
    return objects.select("type", F.get_json_object("object", "$.name").alias("name"))


@query("sanitize", "SELECT cve, requests, peers, severity FROM (SELECT cve, count(*) AS requests, count(DISTINCT source_ip) AS peers, ['unknown','info','low','medium','high','critical'][max(severity_rank)] AS severity FROM fc GROUP BY cve)", "e det det_cves fd fc")
def _(t):
    return sinks.sanitize(FD.cve_summary(t.findings).withColumn("source_ip", F.lit("198.51.0.1"))).select("cve", "requests", "peers", "severity")


@query("write_address_list", "SELECT DISTINCT source_ip AS value FROM fd WHERE source_ip IS NOT NULL", "e det fd")
def _(t):
    import uuid

    path = f"{streams.shared_folder(t.spark)}/addresses-{uuid.uuid4().hex}"
    sinks.write_address_list(t.findings, path)
    return t.spark.read.text(path)


def _stream(t):
    view = f"trailwork_stream_{abs(hash(t.folder))}"
    # As a glob, since a stream's path must be a folder or a glob, and the table may be one file.
    streams.stream_table(t.spark, f"{t.folder}/events.parque[t]", t.read("events").schema).createOrReplaceTempView(view)
    return with_headers(t.spark.sql(EVENTS_SPARK.replace("FROM events", f"FROM {view}")))


@query("stream_rates_with_late", "SELECT CAST(floor(sec / 3600) AS BIGINT) * 3600 AS start, count(*) AS counted FROM e GROUP BY 1")
def _(t):
    folder = f"{streams.shared_folder(t.spark)}/late-{uuid.uuid4().hex}"
    t.events.select("event_id", "ts").repartition(3).write.parquet(f"{folder}/in")
    source = t.spark.readStream.option("maxFilesPerTrigger", 1).schema("event_id long, ts timestamp").parquet(f"{folder}/in")
    streams.stream_rates_with_late(source, f"{folder}/store", late=3600).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    # Which requests come too late depends on the order of the files; what was counted and what was late adds up to all.
    return streams.read_stream_rates(t.spark, f"{folder}/store").select("start", (F.col("requests") + F.col("late")).alias("counted"))


@query("stream_request_rates", "SELECT CAST(floor(sec / 3600) AS BIGINT) * 3600 AS start, count(*) AS requests FROM e WHERE ts IS NOT NULL GROUP BY 1 HAVING (CAST(floor(any_value(sec) / 3600) AS BIGINT) + 1) * 3600 <= (SELECT max(epoch_us(ts)) / 1000000.0 - 7200 FROM e)")
def _(t):
    return streams.run_available(streams.stream_request_rates(_stream(t)))


@query("stream_match", f"SELECT event_id, template_id FROM e JOIN det ON uri_path = d_path AND lower(method) = lower(d_method) AND (d_query IS NULL OR contains(uri_query, d_query)) AND {HEADER} AND {FRAGMENT}", "e det")
def _(t):
    return streams.run_available(streams.stream_match(_stream(t), t.detections).select("event_id", "template_id"))
