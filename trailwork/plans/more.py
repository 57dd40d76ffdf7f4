"""Queries of rankings, set operations, scalar functions and the remaining stores."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from trailwork.functions import web as W
from trailwork.operators import behaviour as B
from trailwork.operators import compare as X
from trailwork.operators import findings as FD
from trailwork.operators import matching as M
from trailwork.plans.base import CTES, query
from trailwork.plans.measures import _CLASS
from trailwork.plans.shapes import _RARE, _probes, _runs, _store, entries, odd_paths
from trailwork.sources import sinks
from trailwork.streaming import streams


@query("status_class", f"SELECT {_CLASS} AS class, count(*) AS requests FROM e GROUP BY 1")
def _(t):
    return t.events.groupBy(W.status_class(F.col("status")).alias("class")).agg(F.count("*").alias("requests"))


@query("waf_outcome", "SELECT CASE upper(waf_action) WHEN 'BLOCK' THEN 'blocked' WHEN 'ALLOW' THEN 'not-blocked' WHEN 'COUNT' THEN 'not-blocked' ELSE 'unknown' END AS outcome, count(*) AS requests FROM e GROUP BY 1")
def _(t):
    return t.events.groupBy(W.waf_outcome(F.col("waf_action")).alias("outcome")).agg(F.count("*").alias("requests"))


@query("request_specificity", "SELECT template_id, ordinal, CASE WHEN coalesce(d_query, d_fragment, d_header) IS NULL THEN 'response-unverified' ELSE 'request-specific' END AS specificity, count(event_id) AS path_requests FROM det LEFT JOIN e ON uri_path = d_path GROUP BY 1, 2, 3", "e det")
def _(t):
    d = t.detections.withColumn("specificity", M.request_specificity(t.detections))
    hits = t.events.groupBy(F.col("uri_path").alias("path")).agg(F.count("*").alias("n"))
    return d.join(hits, "path", "left").select("template_id", "ordinal", "specificity", F.coalesce("n", F.lit(0)).alias("path_requests"))


@query("field_value", "SELECT event_id, uri_path AS stem, CAST(status AS VARCHAR) AS code, CAST(NULL AS VARCHAR) AS nothing FROM e")
def _(t):
    c = t.events.columns
    return t.events.select("event_id", W.field_value("cs-uri-stem", c).alias("stem"), W.field_value("sc-status", c).alias("code"), W.field_value("unheard-of", c).alias("nothing"))


@query("keyword_text", "SELECT event_id, concat_ws(chr(10), method, host) AS words FROM e")
def _(t):
    return t.events.select("event_id", W.keyword_text(["method", "host"]).alias("words"))


@query("path_parts", "SELECT DISTINCT uri_path, concat('/', split_part(uri_path, '/', 2)) AS first, split_part(uri_path, '/', -1) AS last, CAST(len([x for x in string_split(uri_path, '/') if x <> '']) AS INT) AS depth FROM e WHERE uri_path IS NOT NULL")
def _(t):
    p = F.col("uri_path")
    return t.events.filter("uri_path is not null").select(p, W.first_segment(p).alias("first"), W.last_segment(p).alias("last"), W.path_depth(p).alias("depth")).distinct()


@query("resolve_client_ip", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN concat('203.0.113.', CAST(event_id % 200 AS VARCHAR)) END AS client_ip FROM e WHERE source_ip IS NOT NULL")
def _(t):
    hops = F.concat(F.lit("192.0.2.1, 203.0.113."), (F.col("event_id") % 200).cast("string"), F.lit(", 10.0.0.7"))
    e = t.events.filter("source_ip is not null").withColumns({"headers": F.array(F.struct(F.lit("X-Forwarded-For").alias("name"), hops.alias("value"))), "source_ip": F.when(F.col("event_id") % 2 == 0, "10.0.0.9").otherwise(F.col("source_ip"))})
    return M.resolve_client_ip(e, ["10.0.0.0/8"]).select("event_id", "client_ip")


@query("unserved_paths", "SELECT DISTINCT source_ip, uri_path FROM e WHERE source_ip IS NOT NULL AND uri_path IS NOT NULL AND uri_path NOT IN (SELECT uri_path FROM e WHERE status BETWEEN 200 AND 299 AND uri_path IS NOT NULL AND uri_path NOT LIKE '/%/%1')")
def _(t):
    # Nobody is served what ends in 1.
    status = F.when(~F.coalesce(F.col("uri_path").like("/%/%1"), F.lit(False)), F.col("status")).otherwise(404)
    return B.unserved_paths(t.events.withColumn("status", status))


@query("rank_rare_success", f"SELECT path, preceded, successful_sources, requesting_sources, first_seen FROM ({_RARE}) ORDER BY preceded DESC, successful_sources, requesting_sources, first_seen DESC NULLS LAST, path LIMIT 10", "e listed probes tpl rtpl")
def _(t):
    rows = B.rare_success(t.events.filter("source_ip is not null"), _probes(t), max_sources=1000, max_requesting=1000)
    return B.rank_rare_success(rows).select("path", "preceded", "successful_sources", "requesting_sources", "first_seen").limit(10)


@query("rank_identifier_entries", "SELECT source, method, host, template, position, rejected_ids, ids FROM access ORDER BY rejected_ids DESC NULLS LAST, ids DESC, source, method, host NULLS FIRST, template, position LIMIT 20", "e tpl ids src steps entries")
def _(t):
    rows = entries(t).select("source", "method", "host", "template", "position", "rejected_ids", "ids")
    return rows.orderBy(F.desc_nulls_last("rejected_ids"), F.desc("ids"), "source", "method", F.asc_nulls_first("host"), "template", "position").limit(20)


@query("rank_entities", "SELECT source_ip, observations, templates FROM groups ORDER BY observations DESC, templates DESC, source_ip LIMIT 20", "e det det_cves fd groups")
def _(t):
    return FD.rank_entities(FD.entity_groups(t.findings)).select("source_ip", "observations", "templates").limit(20)


@query("rank_anomaly_sources", "SELECT source_ip, count(DISTINCT event_id) AS requests_with_features, count(DISTINCT feature) AS features FROM odd WHERE source_ip IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20", "e odd")
def _(t):
    return B.anomaly_sources(odd_paths(t)).limit(20)


#: event_id % 8 in 0, 1 reads a constant of 2 or 3 letters; event_id // 4 % 4 tells how: inside HEX with + for spaces, percent
#: escapes, escapes of escapes, or a logged JSON body. Escapes and escaped escapes decode to the same shape.
CTES["sized"] = """asked AS (SELECT *, concat(regexp_extract(source_ip, '^[0-9]+[.][0-9]+[.][0-9]+'), '.9') AS peer, event_id // 4 % 4 AS form, CASE WHEN event_id % 8 < 2 THEN CAST(event_id % 8 + 2 AS INT) END AS k, CASE WHEN event_id % 8 < 2 THEN concat('SELECT ', chr(39), repeat('a', CAST(event_id % 8 + 2 AS INT)), chr(39)) ELSE 'SELECT name  FROM t' END AS x FROM e),
    sized AS (SELECT *, CASE form WHEN 0 THEN 2 ELSE 1 END AS m, CASE form WHEN 2 THEN 1 ELSE form END AS shape, length(CASE form WHEN 0 THEN concat('x=HEX(CAST((', x, ')AS CHAR))') WHEN 1 THEN concat('x=CAST%28%28', replace(x, ' ', '%20'), '%29AS%20CHAR%29') WHEN 2 THEN concat('x=cast%2528%2528', replace(x, ' ', '%2520'), '%2529as%2520char%2529') ELSE concat('{"q":"CAST( (', x, ')AS CHAR)"}') END) AS asks FROM asked
      WHERE source_ip IS NOT NULL AND status IS NOT NULL AND response_bytes IS NOT NULL AND ts IS NOT NULL),
    ctl AS (SELECT host, peer, method, status, shape, arg_min(event_id, o) AS c_id, arg_min(response_bytes, o) AS c_bytes, arg_min(asks, o) AS c_asks, arg_min(k, o) AS c_k FROM (SELECT *, row_number() OVER (ORDER BY ts, event_id) AS o FROM sized WHERE k IS NOT NULL) GROUP BY ALL),
    reads AS (SELECT event_id, host, peer, sec, m, lower(regexp_replace(x, ' +', ' ', 'g')) AS expression, response_bytes - c_bytes - (asks - c_asks) AS d, c_k FROM (SELECT s.*, c.c_id, c.c_bytes, c.c_asks, c.c_k FROM sized s JOIN ctl c ON s.host IS NOT DISTINCT FROM c.host AND s.peer = c.peer AND s.method = c.method AND s.status = c.status AND s.shape = c.shape) WHERE event_id <> c_id),
    told AS (SELECT *, CASE WHEN d % m = 0 THEN d // m + c_k END AS fit, CASE WHEN d % m <> 0 THEN 'not_fitting' WHEN d // m + c_k < 0 THEN 'negative_estimate' WHEN d // m + c_k = 0 THEN 'empty_or_null' ELSE 'length' END AS outcome FROM reads)"""


def _size_events(t):
    k, form = F.col("event_id"), F.floor(F.col("event_id") / 4) % 4
    x = F.when(k % 8 < 2, F.concat(F.lit("SELECT '"), F.repeat(F.lit("a"), (k % 8 + 2).cast("int")), F.lit("'"))).otherwise(F.lit("SELECT name  FROM t"))
    wrapped = lambda before, space, after: F.concat(F.lit(before), F.replace(x, F.lit(" "), F.lit(space)), F.lit(after))
    query = F.when(form == 0, wrapped("x=HEX(CAST((", "+", ")AS+CHAR))")).when(form == 1, wrapped("x=CAST%28%28", "%20", "%29AS%20CHAR%29")).when(form == 2, wrapped("x=cast%2528%2528", "%2520", "%2529as%2520char%2529"))
    body = F.when(form == 3, wrapped("{\\x22q\\x22:\\x22CAST( (", " ", ")AS CHAR)\\x22}"))
    peer = F.concat(F.lit("::ffff:"), F.regexp_extract("source_ip", r"^\d+\.\d+\.\d+", 0), F.lit(".9"))
    return t.events.withColumns({"uri_path": F.lit("/Batch"), "uri_query": query, "uri_fragment": F.lit(None).cast("string"), "request_body": body, "source_ip": peer})


@query("response_size_pairs", "SELECT event_id, CAST(m AS BIGINT) AS multiplier, fit AS length, outcome FROM told", "e sized")
def _(t):
    return B.response_size_pairs(_size_events(t)).select("event_id", "multiplier", "length", "outcome")


@query("paired_expressions", """SELECT host, expression, count(*) AS requests, count(DISTINCT peer) AS sources, count(DISTINCT fit) FILTER (outcome = 'length') AS lengths, max(fit) FILTER (outcome = 'length') AS longest, count(*) FILTER (outcome = 'negative_estimate') AS negative_estimate, count(*) FILTER (outcome = 'empty_or_null') AS empty_or_null, count(*) FILTER (outcome = 'not_fitting') AS not_fitting, min(sec) AS first_seen, max(sec) AS last_seen FROM told GROUP BY 1, 2""", "e sized")
def _(t):
    return B.paired_expressions(B.response_size_pairs(_size_events(t)))


@query("host_fit", "SELECT *, fitting / nullif(fitting + not_fitting, 0) AS fit_rate FROM (SELECT host, count(*) FILTER (m = 2 AND outcome <> 'not_fitting') AS fitting, count(*) FILTER (m = 2 AND outcome = 'not_fitting') AS not_fitting, count(*) FILTER (m <> 2) AS parity_unchecked FROM told GROUP BY 1)", "e sized")
def _(t):
    return B.host_fit(B.response_size_pairs(_size_events(t)))


_WHOLE_READ = "response_bytes IS NOT NULL AND status IS NOT NULL AND ts IS NOT NULL AND source_ip IS NOT NULL"
CTES["chars"] = f"chars AS (SELECT *, event_id % 12 AS p, concat('select c', CAST(event_id % 3 AS VARCHAR), ' from t') AS expression FROM e WHERE event_id % 12 > 0 AND event_id % 5 > 0 AND uri_path IS NOT NULL AND {_WHOLE_READ})"


def _char_events(t):
    """One call of various spellings and escapes; a fifth of the requests has two calls, which can't be told apart."""
    k = F.col("event_id")
    inner = F.concat(F.lit("(SELECT  c"), (k % 3).cast("string"), F.lit(" FROM t)"))
    given = F.when(k % 4 == 0, inner).when(k % 4 == 1, F.concat(F.lit("COALESCE("), inner, F.lit(", 0x20)"))).when(k % 4 == 2, F.concat(F.lit("IFNULL(CAST("), inner, F.lit(" AS NCHAR), 'a,)')"))).otherwise(F.concat(F.lit("(SELECT "), inner, F.lit(" LIMIT 1)")))
    call = F.concat(F.when(k % 2 == 0, "ascii( substr(").otherwise("ORD(mid("), given, F.lit(" , "), (k % 12).cast("string"), F.lit(", 1) )"))
    text = F.concat(F.lit("x="), call, F.when(k % 5 == 0, F.concat(F.lit("&y="), call)).otherwise(""))
    spelt = F.when(k % 7 < 2, F.replace(text, F.lit(" "), F.lit("+"))).when(k % 7 < 4, F.replace(text, F.lit("("), F.lit("%28"))).when(k % 7 < 6, F.replace(text, F.lit("("), F.lit("%2528"))).otherwise(text)
    return t.events.withColumn("uri_query", spelt)


@query("char_position_reads", "SELECT host, expression, count(*) AS reads, count(DISTINCT p) AS positions, max(p) AS last_position, count(DISTINCT source_ip) AS sources, min(sec) AS first_seen, max(sec) AS last_seen FROM chars GROUP BY 1, 2", "e chars")
def _(t):
    return B.char_position_reads(_char_events(t))


@query("char_position_sizes", "SELECT host, expression, status, response_bytes, n AS requests, rank FROM (SELECT *, row_number() OVER (PARTITION BY host, expression, status ORDER BY n DESC, response_bytes) AS rank FROM (SELECT host, expression, status, response_bytes, count(*) AS n FROM chars GROUP BY 1, 2, 3, 4)) WHERE rank <= 3", "e chars")
def _(t):
    return B.char_position_sizes(_char_events(t))


@query("read_outcomes", f"SELECT CASE WHEN uri_path IS NULL THEN 'none' WHEN event_id % 12 = 0 THEN 'none' WHEN event_id % 5 = 0 THEN 'multiple' WHEN {_WHOLE_READ} THEN 'character' ELSE 'incomplete' END AS kind, count(*) AS requests FROM e GROUP BY 1")
def _(t):
    # A position of 0 isn't a read, and two calls of position 0 aren't two reads.
    return B.read_outcomes(_char_events(t))


@query("record_dispositions", "SELECT fd.event_id, fd.template_id FROM fd LEFT JOIN disp ON fd.source_ip = disp.source_ip AND fd.template_id = disp.template_id AND upper(fd.method) = disp.method AND fd.uri_path = disp.uri_path AND fd.uri_query IS NOT DISTINCT FROM disp.uri_query WHERE disposition IS NULL OR disposition <> 'expected'", "e det fd disp")
def _(t):
    new = t.findings.select("event_id", "source_ip", "template_id", F.upper("method").alias("method"), "uri_path", "uri_query", F.lit("expected").alias("disposition")).filter("source_ip is not null")
    rows = X.record_dispositions(_store(t), new, ["source_ip", "template_id", "method", "uri_path", "uri_query"])
    return rows.select("event_id", "template_id").unionByName(t.findings.filter("source_ip is null").select("event_id", "template_id"))


@query("baseline_latest", "SELECT run_id, lag(run_id) OVER (ORDER BY run_id) AS baseline FROM (SELECT DISTINCT run_id FROM runs)", "e runs")
def _(t):
    return X.baseline_latest(_runs(t))


@query("compact_observation_store", "SELECT run_id, concat(split_part(source_ip,'.',1),'.',split_part(source_ip,'.',2),'.',split_part(source_ip,'.',3),'.0/24') AS entity, CAST(min(floor(sec / 60)) AS BIGINT) AS first_minute, CAST(max(floor(sec / 60)) AS BIGINT) AS last_minute FROM runs WHERE source_ip IS NOT NULL GROUP BY 1, 2", "e runs")
def _(t):
    seen = X.observations(_runs(t))
    return X.compact_store(seen.unionByName(seen))


@query("capability_union", "SELECT field, count(*) AS sources FROM (SELECT DISTINCT CASE event_id % 2 WHEN 0 THEN 'a' ELSE 'b' END AS s FROM e) JOIN (VALUES ('a', 'status'), ('a', 'user_agent'), ('a', 'referer'), ('b', 'status'), ('b', 'user_agent'), ('b', 'host'), ('b', 'tls_protocol')) v(s, field) USING (s) GROUP BY 1")
def _(t):
    return X.capability_union(t.events.select(F.when(F.col("event_id") % 2 == 0, "nginx-combined").otherwise("aws-alb").alias("log_source")))


@query("cve_union", "SELECT DISTINCT cve FROM fc UNION SELECT 'CVE-1999-9999' UNION SELECT 'CVE-2024-0001' UNION SELECT 'CVE-2024-0004'", "e det det_cves fd fc")
def _(t):
    return FD.by_cve(t.findings).select("cve").union(t.kev.select(F.upper(F.trim("cve_id")))).distinct()


@query("write_findings", "SELECT event_id, template_id, string_agg(cve, ';' ORDER BY cve) AS cves FROM fd JOIN det_cves USING (template_id, ordinal) GROUP BY 1, 2", "e det det_cves fd")
def _(t):
    path = f"{streams.shared_folder(t.spark)}/findings-{uuid.uuid4().hex}"
    sinks.write_findings(t.findings.select("event_id", "template_id", "cves"), path, "csv")
    return t.spark.read.csv(path, header=True, schema="event_id long, template_id string, cves string")
