"""Queries of the behaviour, network, comparison and store operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from trailwork.functions import network as N
from trailwork.functions import web as W
from trailwork.operators import behaviour as B
from trailwork.operators import compare as X
from trailwork.operators import concentration as C
from trailwork.operators import findings as FD
from trailwork.plans.base import CTES, RANGES, query, values_sql
from trailwork.plans.measures import _DAILY

_NUM = lambda ip: sum(int(p) << s for p, s in zip(ip.split("."), (24, 16, 8, 0), strict=True))


def _range(cidr: str) -> tuple[int, int]:
    base, bits = cidr.split("/")
    return _NUM(base), _NUM(base) + (1 << (32 - int(bits))) - 1


CTES["rng"] = values_sql("rng", "lo, hi, asn", [(_NUM(a), _NUM(b), n) for a, b, n in RANGES])
_ASN = "SELECT ip, arg_max(asn, bits) AS asn, max(bits) AS prefix_len FROM ipn JOIN nets ON num BETWEEN lo AND hi GROUP BY ip"


def _ips(t):
    return t.events.select(F.col("source_ip").alias("ip"))


@query("asn_lookup", _ASN, "e ipn nets")
def _(t):
    return X.asn_lookup(_ips(t), t.networks)


@query("asn_range_lookup", "SELECT ip, asn FROM ipn JOIN rng ON num BETWEEN lo AND hi", "e ipn rng")
def _(t):
    return X.range_lookup(_ips(t), t.ranges)


@query("reputation_lookup", f"""SELECT ip, count(*) AS hits, ['ip','cidr','asn'][min(rank)] AS scope, arg_max(score, -rank * 1000 + score) AS score, CASE WHEN arg_max(score, -rank * 1000 + score) >= 75 THEN 'high' WHEN arg_max(score, -rank * 1000 + score) >= 50 THEN 'medium' WHEN arg_max(score, -rank * 1000 + score) >= 25 THEN 'low' ELSE 'info' END AS tier FROM (
    SELECT ip, 1 AS rank, score FROM ipn JOIN (VALUES ('198.51.3.17', 95), ('198.51.1.8', 40)) v(value, score) ON value = ip
    UNION ALL SELECT ip, 2, score FROM ipn JOIN (VALUES ({_range('198.51.2.0/24')[0]}, {_range('198.51.2.0/24')[1]}, 60), ({_range('198.51.3.0/24')[0]}, {_range('198.51.3.0/24')[1]}, 80)) v(lo, hi, score) ON num BETWEEN lo AND hi
    UNION ALL SELECT ip, 3, score FROM ({_ASN}) JOIN (VALUES (64503, 20), (64500, 30)) v(a, score) ON a = asn) GROUP BY ip""", "e ipn nets")
def _(t):
    return X.reputation_lookup(_ips(t), t.reputation, X.asn_lookup(_ips(t), t.networks).select("ip", "asn"))


@query("prefix_asns", f"SELECT concat(split_part(ip,'.',1),'.',split_part(ip,'.',2),'.',split_part(ip,'.',3),'.0/24') AS block, count(DISTINCT asn) AS asns, count(*) FILTER (asn IS NULL) AS peers_without_asn FROM ipn LEFT JOIN ({_ASN}) USING (ip) GROUP BY 1", "e ipn nets")
def _(t):
    return C.prefix_concentration(t.events, 24, X.asn_lookup(_ips(t), t.networks)).select("block", "asns", "peers_without_asn")


@query("canonical_ip", "SELECT DISTINCT source_ip, source_ip AS canonical, CAST(num AS BIGINT) AS number FROM e JOIN ipn ON ip = source_ip", "e ipn")
def _(t):
    return t.events.filter("source_ip is not null").select("source_ip").distinct().select("source_ip", N.canonical_ip(F.col("source_ip")).alias("canonical"), N.v4_number(F.col("source_ip")).alias("number"))


@query("path_distinctiveness", "SELECT uri_path, CASE WHEN uri_path = '/login' THEN 'generic' ELSE 'distinctive' END AS kind FROM e WHERE uri_path IS NOT NULL GROUP BY 1")
def _(t):
    return t.events.filter("uri_path is not null").select("uri_path", W.path_distinctiveness(F.col("uri_path")).alias("kind")).distinct()


CTES["listed"] = "listed AS (SELECT DISTINCT uri_path, CASE WHEN uri_path = '/.env' THEN 'config-or-secret-files' ELSE 'wordpress-paths' END AS category FROM e WHERE uri_path = '/.env' OR starts_with(uri_path, '/wp-admin/'))"


@query("catalog_paths", "SELECT * FROM listed", "e listed")
def _(t):
    return B.catalog_paths(t.events, t.catalog)


CTES["probes"] = """probes AS (SELECT *, coalesce(met_paths, false) AND (with_status = 0 OR coalesce(met_errors, false)) AND (coalesce(met_catalog, false) OR coalesce(met_unserved, false)) AS probe_shaped FROM (SELECT *,
    CASE WHEN distinct_paths >= 20 THEN true WHEN paths_unavailable > 0 THEN NULL ELSE false END AS met_paths, CASE WHEN client_error_share >= 0.2 THEN true WHEN client_error_share IS NULL THEN NULL ELSE false END AS met_errors, CASE WHEN catalog_paths >= 2 THEN true WHEN paths_unavailable > 0 THEN NULL ELSE false END AS met_catalog, CASE WHEN unserved_share >= 0.5 THEN true WHEN unserved_share IS NULL THEN NULL ELSE false END AS met_unserved FROM (SELECT p.*, m.peak_per_minute, coalesce(x.distinct_paths, 0) AS distinct_paths, coalesce(x.unserved, 0) AS unserved, coalesce(x.catalog_paths, 0) AS catalog_paths, CAST(coalesce(x.catalog_requests, 0) AS BIGINT) AS catalog_requests,
      CASE WHEN with_status > 0 THEN client_errors * 1.0 / requests END AS client_error_share, CASE WHEN with_status > 0 THEN not_found * 1.0 / requests END AS not_found_share, CASE WHEN with_status > 0 AND paths_unavailable = 0 AND x.distinct_paths > 0 THEN x.unserved * 1.0 / x.distinct_paths END AS unserved_share, query_requests * 1.0 / requests AS query_share
    FROM (SELECT source_ip, count(*) AS requests, count(*) FILTER (uri_path IS NULL) AS paths_unavailable, count(status) AS with_status, count(*) FILTER (status BETWEEN 400 AND 498) AS client_errors, count(*) FILTER (status = 404) AS not_found, count(DISTINCT method) AS methods, count(DISTINCT user_agent) AS user_agents, count(uri_query) AS query_requests, count(DISTINCT floor(sec / 86400)) AS active_days, min(sec) AS earliest, max(sec) AS latest FROM e WHERE source_ip IS NOT NULL GROUP BY 1) p
    LEFT JOIN (SELECT source_ip, max(n) AS peak_per_minute FROM (SELECT source_ip, floor(sec / 60) AS m, count(*) AS n FROM e WHERE source_ip IS NOT NULL AND ts IS NOT NULL GROUP BY 1, 2) GROUP BY 1) m USING (source_ip)
    LEFT JOIN (SELECT source_ip, count(*) AS distinct_paths, count(*) FILTER (uri_path NOT IN (SELECT uri_path FROM e WHERE status BETWEEN 200 AND 299 AND uri_path IS NOT NULL)) AS unserved, count(*) FILTER (uri_path IN (SELECT uri_path FROM listed)) AS catalog_paths, sum(CASE WHEN uri_path IN (SELECT uri_path FROM listed) THEN n ELSE 0 END) AS catalog_requests FROM (SELECT source_ip, uri_path, count(*) AS n FROM e WHERE source_ip IS NOT NULL AND uri_path IS NOT NULL GROUP BY 1, 2) GROUP BY 1) x USING (source_ip))))"""


def _probes(t):
    return B.probe_sources(t.events, t.catalog, min_paths=20, min_error_share=0.2, min_catalog=2, min_unserved=0.5)


@query("probe_sources", "SELECT * FROM probes", "e listed probes")
def _(t):
    return _probes(t)


#: A third of the requests came through a proxy that named its client, which is an address or nothing; a few peers are host names.
CTES["who"] = """who AS (SELECT *, CASE WHEN peer IS NULL THEN NULL WHEN named THEN 'hostname-peer' WHEN client IS NOT NULL THEN CASE WHEN client = 'unknown' THEN NULL ELSE 'validated-client' END ELSE 'observed-peer' END AS identity, CASE WHEN peer IS NULL OR client = 'unknown' AND NOT named THEN NULL WHEN named THEN 'crawler.example.org' ELSE coalesce(client, source_ip) END AS source FROM
    (SELECT *, event_id % 31 = 0 AND source_ip IS NOT NULL AS named, source_ip AS peer, CASE WHEN event_id % 3 = 0 THEN CASE WHEN event_id % 15 = 0 THEN 'unknown' ELSE concat('203.0.113.', CAST(event_id % 7 AS VARCHAR)) END END AS client FROM e))"""


def _who(t):
    k = F.col("event_id")
    client = F.when(k % 3 == 0, F.when(k % 15 == 0, "unknown").otherwise(F.concat(F.lit("::ffff:203.0.113."), (k % 7).cast("string"))))
    named = F.when((k % 31 == 0) & F.col("source_ip").isNotNull(), "Crawler.Example.org.").otherwise(F.col("source_ip"))
    return B.with_source(t.events.withColumns({"client_ip": client, "source_ip": named}))


@query("source_identities", "SELECT identity, source, count(*) AS requests, count(DISTINCT uri_path) AS paths FROM who GROUP BY 1, 2", "e who")
def _(t):
    return _who(t).groupBy("identity", "source").agg(F.count("*").alias("requests"), F.countDistinct("uri_path").alias("paths"))


@query("probe_identities", """SELECT identity, source, count(*) AS requests, count(DISTINCT uri_path) AS distinct_paths, count(DISTINCT uri_path) FILTER (uri_path IN (SELECT uri_path FROM listed)) AS catalog_paths, count(*) FILTER (uri_path IN (SELECT uri_path FROM listed)) AS catalog_requests,
    count(DISTINCT uri_path) FILTER (uri_path NOT IN (SELECT uri_path FROM e WHERE status BETWEEN 200 AND 299 AND uri_path IS NOT NULL)) AS unserved, count(DISTINCT floor(sec / 86400)) AS active_days FROM who WHERE identity IS NOT NULL GROUP BY 1, 2""", "e listed who")
def _(t):
    return B.probe_sources(_who(t), t.catalog, key=B.SOURCE).select("identity", "source", "requests", "distinct_paths", "catalog_paths", "catalog_requests", "unserved", "active_days")


@query("probe_categories", "SELECT source_ip, category, count(*) AS requests, count(DISTINCT uri_path) AS paths FROM e JOIN listed USING (uri_path) WHERE source_ip IS NOT NULL GROUP BY 1, 2", "e listed")
def _(t):
    return B.probe_categories(t.events, t.catalog)


@query("rank_probe_sources", "SELECT source_ip, distinct_paths, requests, probe_shaped FROM probes ORDER BY probe_shaped DESC, distinct_paths DESC, requests DESC, source_ip LIMIT 20", "e listed probes")
def _(t):
    return _probes(t).select("source_ip", "distinct_paths", "requests", "probe_shaped").orderBy(F.desc("probe_shaped"), F.desc("distinct_paths"), F.desc("requests"), "source_ip").limit(20)


CTES["tpl"] = "tpl AS (SELECT *, CASE WHEN regexp_matches(split_part(uri_path, '/', 3), '^[0-9]{1,20}$') THEN concat('/', split_part(uri_path, '/', 2), '/{num}') ELSE uri_path END AS path FROM e WHERE uri_path IS NOT NULL)"
CTES["rtpl"] = "rtpl AS (SELECT * FROM tpl WHERE source_ip IS NOT NULL)"
_RARE = """SELECT a.path, CAST(requests AS BIGINT) AS requests, CAST(successes AS BIGINT) AS successes, requesting_sources, successful_sources, preceded, min_bytes, max_bytes, methods, first_seen, last_seen FROM (SELECT path, sum(n) AS requests, sum(ok) AS successes, count(source_ip) AS requesting_sources, count(*) FILTER (ok > 0 AND source_ip IS NOT NULL) AS successful_sources, count(*) FILTER (source_ip IS NULL) AS without_source, max(CAST(coalesce(ok > 0 AND last_ok > first_failure, false) AS INT)) = 1 AS preceded
    FROM (SELECT path, source_ip, count(*) AS n, count(*) FILTER (status BETWEEN 200 AND 299) AS ok, max(CASE WHEN status BETWEEN 200 AND 299 THEN sec END) AS last_ok FROM rtpl GROUP BY 1, 2) LEFT JOIN (SELECT source_ip, min(sec) AS first_failure FROM e WHERE status BETWEEN 400 AND 498 AND source_ip IN (SELECT source_ip FROM probes WHERE probe_shaped) GROUP BY 1) USING (source_ip) GROUP BY 1) a
    JOIN (SELECT path, min(response_bytes) AS min_bytes, max(response_bytes) AS max_bytes, string_agg(DISTINCT method, ';' ORDER BY method) AS methods, min(sec) AS first_seen, max(sec) AS last_seen FROM rtpl GROUP BY 1) b USING (path) WHERE successes > 0 AND without_source = 0 AND successful_sources <= 1000 AND requesting_sources <= 1000"""


@query("rare_success", _RARE, "e listed probes tpl rtpl")
def _(t):
    return B.rare_success(t.events.filter("source_ip is not null"), _probes(t), max_sources=1000, max_requesting=1000)


@query("rare_success_sources", f"SELECT path, source_ip, count(*) AS successes, min(sec) AS first_success, max(sec) AS last_success FROM rtpl WHERE status BETWEEN 200 AND 299 AND path IN (SELECT path FROM ({_RARE})) GROUP BY 1, 2", "e listed probes tpl rtpl")
def _(t):
    e = t.events.filter("source_ip is not null")
    return B.rare_success_sources(e, B.rare_success(e, _probes(t), max_sources=1000, max_requesting=1000))


@query("rare_success_identities", """SELECT path, identity, source, count(*) AS successes FROM (SELECT *, CASE WHEN regexp_matches(split_part(uri_path, '/', 3), '^[0-9]{1,20}$') THEN concat('/', split_part(uri_path, '/', 2), '/{num}') ELSE uri_path END AS path FROM who WHERE identity IS NOT NULL AND uri_path IS NOT NULL) WHERE status BETWEEN 200 AND 299 GROUP BY 1, 2, 3""", "e who")
def _(t):
    e = _who(t).filter("identity is not null")
    rare = B.rare_success(e, B.probe_sources(e, t.catalog, key=B.SOURCE), max_sources=100_000, max_requesting=100_000, key=B.SOURCE)
    return B.rare_success_sources(e, rare, B.SOURCE).select("path", "identity", "source", "successes")


CTES["ids"] = """ids AS (SELECT event_id, source_ip, method, host, ts, status, response_bytes, path AS template, 'path:2' AS position, split_part(uri_path, '/', 3) AS value FROM tpl WHERE path <> uri_path
    UNION ALL SELECT event_id, source_ip, method, host, ts, status, response_bytes, path, concat('query:', split_part(uri_query, '=', 1)), split_part(uri_query, '=', 2) FROM tpl WHERE regexp_matches(uri_query, '=[0-9]{1,20}$'))"""


@query("identifiers", "SELECT event_id, template, position, value FROM ids", "e tpl ids")
def _(t):
    return B.identifiers(t.events).select("event_id", "template", "position", "value")


_KEY = "source, method, host, template, position"
CTES["src"] = "src AS (SELECT * EXCLUDE (source_ip) REPLACE (coalesce(host, '') AS host, CASE WHEN event_id % 397 = 0 THEN NULL ELSE event_id % 5 * 100 END AS response_bytes), source_ip AS source FROM ids WHERE source_ip IS NOT NULL AND method IS NOT NULL)"
CTES["steps"] = f"steps AS (SELECT {_KEY}, count(before) AS pairs, count(before) AS numeric_pairs, count(*) FILTER (abs(CAST(value AS BIGINT) - CAST(before AS BIGINT)) BETWEEN 1 AND 2) AS adjacent_pairs, count(*) FILTER (value <> before AND (starts_with(value, before) OR starts_with(before, value))) AS prefix_pairs FROM (SELECT *, lag(value) OVER (PARTITION BY {_KEY} ORDER BY event_id) AS before FROM src) GROUP BY ALL)"


@query("consecutive_ids", "SELECT 'observed-peer' AS identity, * REPLACE (nullif(host, '') AS host) FROM steps WHERE pairs > 0", "e tpl ids src steps")
def _(t):
    return B.consecutive_ids(t.events)


#: Response sizes repeat and some are missing, so that entries have dominant sizes and some can't be measured.
CTES["entries"] = f"""whole AS (SELECT {_KEY}, count(*) AS requests, count(DISTINCT value) AS ids, count(*) FILTER (status BETWEEN 200 AND 299 AND response_bytes IS NULL) AS ok_without_bytes, count(status) AS known, count(ts) AS dated, min(ts) AS t0, max(ts) AS t1 FROM src GROUP BY ALL),
    corpus AS (SELECT epoch_ms(min(ts)) - 86400000 AS c0, epoch_ms(max(ts)) + 86400000 AS c1 FROM e),
    sized_ids AS (SELECT {_KEY}, value, response_bytes AS size, count(*) AS n, count(ts) AS dated, min(ts) AS seen_at FROM src WHERE status BETWEEN 200 AND 299 AND response_bytes IS NOT NULL GROUP BY ALL),
    dominant AS (SELECT {_KEY}, size AS dominant_bytes FROM (SELECT {_KEY}, size, count(*) AS k FROM sized_ids GROUP BY ALL) JOIN whole USING ({_KEY}) WHERE k >= 2 AND ok_without_bytes = 0 QUALIFY row_number() OVER (PARTITION BY {_KEY} ORDER BY k DESC, size) = 1),
    content AS (SELECT {_KEY}, value, count(*) AS kinds, sum(n) AS content_n, min(seen_at) AS content_at, bool_or(dated < n) AS content_undated FROM sized_ids LEFT JOIN dominant USING ({_KEY}) WHERE dominant_bytes IS NULL OR size <> dominant_bytes GROUP BY ALL),
    wrote AS (SELECT {_KEY}, value, min(ts) AS seen_at FROM src WHERE method = 'POST' GROUP BY ALL),
    prior AS (SELECT s.source, s.method, s.host, s.template, s.position, s.value, true AS has_other, min(w.seen_at) AS written_at FROM (SELECT DISTINCT {_KEY}, value FROM src) s JOIN wrote w ON s.source = w.source AND s.value = w.value AND NOT (s.method = w.method AND s.host = w.host AND s.template = w.template AND s.position = w.position) GROUP BY ALL),
    judged AS (SELECT s.*, kinds, content_n, content_at, content_undated, coalesce(has_other, false) AS has_other, written_at, CASE WHEN CAST(value AS HUGEINT) BETWEEN c0 AND c1 OR CAST(value AS HUGEINT) * 1000 BETWEEN c0 AND c1 THEN numeric_n ELSE 0 END AS timely FROM
      (SELECT {_KEY}, value, count(*) AS numeric_n, coalesce(bool_or(status BETWEEN 200 AND 299 OR status BETWEEN 400 AND 599), false) AS answered, coalesce(bool_or(status BETWEEN 100 AND 199 OR status BETWEEN 300 AND 399), false) AS redirected, coalesce(bool_or(status < 100 OR status > 599), false) AS odd FROM src GROUP BY ALL) s LEFT JOIN content USING ({_KEY}, value) LEFT JOIN prior USING ({_KEY}, value), corpus),
    summed AS (SELECT {_KEY}, count(kinds) AS content_ids, count(*) FILTER (kinds IS NULL AND answered) AS rejected_ids, count(*) FILTER (kinds IS NULL AND NOT answered AND redirected AND NOT odd) AS redirect_only_ids, count(*) FILTER (content_n >= 2) AS repeated_ids, count(*) FILTER (content_n >= 2 AND kinds = 1) AS stable_ids, sum(numeric_n) AS numeric_n, sum(timely) AS timely, count(*) FILTER (has_other) AS written_ids, count(*) FILTER (has_other AND NOT content_undated AND written_at < content_at) AS written_before_content FROM judged GROUP BY ALL),
    access AS (SELECT 'observed-peer' AS identity, source, method, nullif(host, '') AS host, template, position, requests, ids, CASE WHEN m THEN content_ids END AS content_ids, CASE WHEN m THEN rejected_ids END AS rejected_ids, CASE WHEN m THEN redirect_only_ids END AS redirect_only_ids, CASE WHEN m THEN repeated_ids END AS repeated_ids, CASE WHEN m THEN stable_ids END AS stable_ids, CASE WHEN m THEN written_before_content END AS written_before_content, written_ids, CASE WHEN m AND content_ids + rejected_ids > 0 THEN rejected_ids * 1.0 / (content_ids + rejected_ids) END AS rejected_share,
      dominant_bytes, ok_without_bytes, requests - known AS without_status, requests - dated AS undated, CAST(timely AS DOUBLE) / CAST(numeric_n AS DOUBLE) AS timestamp_share, pairs, numeric_pairs, adjacent_pairs, prefix_pairs, CAST(0 AS BIGINT) AS beyond_64_bits, adjacent_pairs / nullif(numeric_pairs, 0) AS adjacent_share, prefix_pairs / nullif(pairs, 0) AS prefix_share, CAST(NULL AS VARCHAR) AS self_reference, CAST(floor(epoch_us(t0) / 1000000.0) AS BIGINT) AS first_seen, CAST(floor(epoch_us(t1) / 1000000.0) AS BIGINT) AS last_seen FROM (SELECT *, ok_without_bytes = 0 AND known > 0 AS m FROM whole) JOIN summed USING ({_KEY}) JOIN steps USING ({_KEY}) LEFT JOIN dominant USING ({_KEY}))"""
_ENTRIES = "e tpl ids src steps entries"


def entries(t):
    return B.identifier_access(t.events.withColumn("response_bytes", F.when(F.col("event_id") % 397 != 0, F.col("event_id") % 5 * 100)))


@query("identifier_access", "SELECT * FROM access", _ENTRIES)
def _(t):
    return entries(t)


@query("writes_before_read", """SELECT r.source_ip, r.value, r.entry, min(write_at) AS write_at, any_value(read_at) AS read_at FROM (SELECT source_ip, value, concat_ws('|', template, position) AS entry, min(epoch_us(ts)) AS read_at FROM ids WHERE source_ip IS NOT NULL AND ts IS NOT NULL AND status BETWEEN 200 AND 299 AND method <> 'POST' GROUP BY ALL) r
    JOIN (SELECT source_ip, value, concat_ws('|', template, position) AS entry, min(epoch_us(ts)) AS write_at FROM ids WHERE source_ip IS NOT NULL AND ts IS NOT NULL AND method = 'POST' GROUP BY ALL) w ON r.source_ip = w.source_ip AND r.value = w.value AND r.entry <> w.entry AND write_at < read_at GROUP BY 1, 2, 3""", "e tpl ids")
def _(t):
    return B.writes_before_read(t.events)


#: What is added to the paths of events by event_id % 9, and the features it has.
ODD = [
    ("/%2e%2e/x", ["traversal-encoded"]), ("/..%c0%af", ["invalid-utf8", "overlong-traversal", "overlong-utf8"]), ("/%zz", ["invalid-percent-escape"]), ("/../y", ["traversal"]), ("/%252e", ["double-encoding"]),
    ("/a%00\\b", ["backslash-path", "nul-byte"]), ("/..;/%0a", ["crlf", "path-parameter-traversal"]), ("/caf%c3%a9", []), ("", []),
]
CTES["odd"] = "odd AS (SELECT e.*, unnest([" + ", ".join(f"[{', '.join(repr(x) for x in f)}]" if f else "CAST([] AS VARCHAR[])" for _, f in ODD) + "][event_id % 9 + 1]) AS feature FROM e WHERE uri_path IS NOT NULL)"


def odd_paths(t):
    added = F.get(F.array(*[F.lit(x) for x, _ in ODD]), (F.col("event_id") % 9).cast("int"))
    return t.events.withColumn("uri_path", F.concat("uri_path", added))


@query("request_anomalies", "SELECT feature, count(*) AS requests, count(DISTINCT source_ip) AS peers, count(DISTINCT concat(uri_path, CAST(event_id % 9 AS VARCHAR))) AS paths, min(sec) AS first_seen, max(sec) AS last_seen, count(*) FILTER (status BETWEEN 200 AND 299) AS ok FROM odd GROUP BY 1", "e odd")
def _(t):
    return B.request_anomalies(odd_paths(t))


@query("request_features", "SELECT event_id, feature, 'path' AS part FROM odd", "e odd")
def _(t):
    return B.request_features(odd_paths(t)).select("event_id", "feature", "part")


@query("bot_range_check", f"SELECT 'examplebot' AS operator_id, count(*) AS declared, count(*) FILTER (inside) AS inside, count(*) FILTER (NOT inside) AS outside, count(DISTINCT source_ip) AS peers, count(DISTINCT source_ip) FILTER (NOT inside) AS outside_peers, count(*) FILTER (NOT inside) * 1.0 / count(*) AS outside_share FROM (SELECT source_ip, coalesce(num BETWEEN {_range('198.51.2.0/25')[0]} AND {_range('198.51.2.0/25')[1]} OR num BETWEEN {_range('198.51.4.0/24')[0]} AND {_range('198.51.4.0/24')[1]}, false) AS inside FROM e LEFT JOIN ipn ON ip = source_ip WHERE contains(user_agent, 'ExampleBot')) UNION ALL SELECT 'curl', count(*), NULL, NULL, count(DISTINCT source_ip), NULL, NULL FROM e WHERE contains(user_agent, 'curl/')", "e ipn")
def _(t):
    rows = [("examplebot", "ExampleBot", "198.51.2.0/25"), ("examplebot", "ExampleBot", "198.51.4.0/24"), ("curl", "curl/", None)]
    return B.bot_range_check(t.events, t.spark.createDataFrame(rows, "operator_id string, pattern string, network string"))


@query("consistency", "SELECT declared, outcome, reason, count(*) AS requests, count(DISTINCT source_ip) AS peers FROM (SELECT source_ip, declared, CASE WHEN ja4 IS NULL OR ja4 NOT IN ('t13d1','t13d2','t13d3') THEN 'unavailable' WHEN (ja4 = 't13d1' AND declared = 'firefox') OR (ja4 = 't13d2' AND declared IN ('chromium', 'firefox')) OR (ja4 = 't13d3' AND declared = 'safari') THEN 'match' ELSE 'mismatch' END AS outcome, CASE WHEN ja4 IS NULL THEN 'observed_value_missing' WHEN ja4 NOT IN ('t13d1','t13d2','t13d3') THEN 'reference_data_missing' END AS reason FROM (SELECT *, CASE WHEN contains(user_agent, 'Firefox/') THEN 'firefox' WHEN contains(user_agent, 'Chrome/') THEN 'chromium' WHEN contains(user_agent, 'Safari/') THEN 'safari' END AS declared FROM e) WHERE declared IS NOT NULL) GROUP BY 1, 2, 3")
def _(t):
    families = [("t13d1", "firefox"), ("t13d2", "chromium"), ("t13d2", "firefox"), ("t13d3", "safari")]
    return B.consistency(t.events, t.spark.createDataFrame(families, "ja4 string, family string"))


#: Two runs: the first and the second half of the month.
_B, _C = "ts < TIMESTAMP '2024-01-16'", "ts >= TIMESTAMP '2024-01-16'"


def _halves(df):
    return df.filter("ts < timestamp'2024-01-16'"), df.filter("ts >= timestamp'2024-01-16'")


@query("first_seen", f"SELECT source_ip, count(*) AS requests FROM e WHERE {_C} AND source_ip IS NOT NULL AND source_ip NOT IN (SELECT source_ip FROM e WHERE {_B} AND source_ip IS NOT NULL AND source_ip LIKE '%7') GROUP BY 1")
def _(t):
    b, c = _halves(t.events)
    return X.first_seen(c, b.filter("source_ip like '%7'").withColumn("source_ip", F.concat(F.lit("::ffff:"), "source_ip")), "source_ip")


@query("entity_difference", f"SELECT DISTINCT uri_path FROM e WHERE {_C} AND uri_path IS NOT NULL AND uri_path NOT IN (SELECT uri_path FROM e WHERE {_B} AND uri_path IS NOT NULL AND event_id % 20 = 0)")
def _(t):
    b, c = _halves(t.events)
    return X.entity_difference(c, b.filter("event_id % 20 = 0"), "uri_path")


@query("cve_diff", f"SELECT cve, coalesce(b, 0) AS baseline, coalesce(c, 0) AS current, CASE WHEN b IS NULL THEN 'new' WHEN c IS NULL THEN 'disappeared' ELSE 'common' END AS state, coalesce(c, 0) - coalesce(b, 0) AS delta FROM (SELECT cve, count(*) AS b FROM fc WHERE {_B} GROUP BY 1) FULL JOIN (SELECT cve, count(*) AS c FROM fc WHERE {_C} GROUP BY 1) USING (cve)", "e det det_cves fd fc")
def _(t):
    b, c = (x.groupBy("cve").agg(F.count("*").alias("requests")) for x in _halves(FD.by_cve(t.findings)))
    return X.cve_diff(b, c)


@query("volume_delta", "SELECT o_custkey, current, baseline, current * 1.0 / baseline AS ratio, CASE WHEN baseline IS NULL THEN 'new' WHEN baseline < 5 THEN 'low-baseline' WHEN current * 1.0 / baseline >= 1.5 THEN 'elevated' ELSE 'unchanged' END AS label FROM (SELECT o_custkey, count(*) AS current FROM orders WHERE o_orderkey % 2 = 1 GROUP BY 1) LEFT JOIN (SELECT o_custkey, count(*) AS baseline FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1) USING (o_custkey)", "")
def _(t):
    o = t.read("orders")
    b, c = (o.filter(f"o_orderkey % 2 = {k}").groupBy("o_custkey").agg(F.count("*").alias("requests")) for k in (0, 1))
    return X.volume_delta(b, c, "o_custkey", low=5, elevated=1.5)


_UNPIVOT = "UNPIVOT (SELECT CAST(requests AS DOUBLE) AS requests, CAST(peers AS DOUBLE) AS peers, CAST(paths AS DOUBLE) AS paths, CAST(fingerprints AS DOUBLE) AS fingerprints, share_2xx, share_4xx, share_5xx, CAST(bytes AS DOUBLE) AS bytes FROM ({})) ON requests, peers, paths, fingerprints, share_2xx, share_4xx, share_5xx, bytes INTO NAME metric VALUE value"


@query("daily_comparison", f"SELECT metric, b.value AS baseline, c.value AS current, c.value - b.value AS delta, c.value / nullif(b.value, 0) AS ratio, abs(c.value / nullif(b.value, 0) - 1) >= CASE metric WHEN 'requests' THEN 0.01 WHEN 'share_5xx' THEN 0.5 END AS crossed FROM ({_UNPIVOT.format(_DAILY + ' WHERE ' + _B)}) b FULL JOIN ({_UNPIVOT.format(_DAILY + ' WHERE ' + _C)}) c USING (metric)")
def _(t):
    b, c = _halves(t.events)
    return X.daily_comparison(C.daily_summary(b), C.daily_summary(c), {"requests": 0.01, "share_5xx": 0.5})


_MEASURES = """SELECT unnest(['total_requests', 'distinct_sources', 'top_path_share', 'top_path_requests_per_source', 'requests_per_source', 'success_share', 'client_closed_share', 'server_error_share']) AS metric, unnest([CAST(n AS DOUBLE), p, tn / n, tn / nullif(tp, 0), n / nullif(p, 0), ok / n, closed / n, failed / n]) AS value
    FROM (SELECT count(*) AS n, count(DISTINCT source_ip) AS p, count(*) FILTER (status BETWEEN 200 AND 299) AS ok, count(*) FILTER (status = 499) AS closed, count(*) FILTER (status BETWEEN 500 AND 599) AS failed FROM e WHERE {0}), (SELECT count(*) AS tn, count(DISTINCT source_ip) AS tp FROM e WHERE {0} AND uri_path IS NOT NULL GROUP BY uri_path ORDER BY count(*) DESC, uri_path LIMIT 1)"""
_POINTS = [("total_requests", "ratio", "at-least", 0.9), ("success_share", "delta", "at-most", -0.5), ("requests_per_source", "ratio", "at-least", 2.0)]


@query("compare_days", f"SELECT metric, b.value AS baseline, c.value AS current, c.value - b.value AS delta, c.value / nullif(b.value, 0) AS ratio, '' AS reasons, CASE metric WHEN 'total_requests' THEN c.value / b.value >= 0.9 WHEN 'success_share' THEN c.value - b.value <= -0.5 WHEN 'requests_per_source' THEN c.value / b.value >= 2.0 END AS crossed FROM ({_MEASURES.format(_B)}) b JOIN ({_MEASURES.format(_C)}) c USING (metric)")
def _(t):
    b, c = _halves(t.events)
    return X.compare_days(X.daily_measures(b), X.daily_measures(c), _POINTS)


@query("compare_days_without_sources", f"""SELECT metric, b.value AS baseline, CASE metric WHEN 'distinct_sources' THEN 0.0 WHEN 'top_path_requests_per_source' THEN NULL WHEN 'requests_per_source' THEN NULL ELSE c.value END AS current, CASE metric WHEN 'top_path_requests_per_source' THEN 'current: the top path has no source' WHEN 'requests_per_source' THEN 'current: no request has a source' ELSE '' END AS reasons FROM ({_MEASURES.format(_B)}) b JOIN ({_MEASURES.format(_C)}) c USING (metric)""")
def _(t):
    b, c = _halves(t.events)
    return X.compare_days(X.daily_measures(b), X.daily_measures(c.withColumn("source_ip", F.lit(None).cast("string")))).select("metric", "baseline", "current", "reasons")


CTES["runs"] = "runs AS (SELECT *, concat('run-', CAST(CAST(floor(sec / 604800) AS BIGINT) AS VARCHAR)) AS run_id FROM e WHERE ts IS NOT NULL)"


def _runs(t):
    return t.events.filter("ts is not null").withColumn("run_id", F.concat(F.lit("run-"), F.floor(W.epoch(F.col("ts")) / 604800).cast("string")))


@query("reference_distribution", "SELECT metric, count(*) AS runs, min(v) AS least, median(v) AS median, max(v) AS most, any_value(value) AS value, any_value(value) - median(v) AS delta, any_value(value) / nullif(median(v), 0) AS ratio FROM (SELECT run_id, unnest(['requests', 'peers']) AS metric, unnest([count(*), count(DISTINCT source_ip)]) * 1.0 AS v FROM runs GROUP BY run_id) JOIN (SELECT unnest(['requests', 'peers']) AS metric, unnest([count(*), count(DISTINCT source_ip)]) * 1.0 AS value FROM runs WHERE run_id = (SELECT max(run_id) FROM runs)) USING (metric) GROUP BY metric", "e runs")
def _(t):
    runs = _runs(t).groupBy("run_id").agg(F.count("*").cast("double").alias("requests"), F.countDistinct("source_ip").cast("double").alias("peers")).unpivot(["run_id"], ["requests", "peers"], "metric", "value")
    newest = runs.groupBy("metric").agg(F.max_by("value", "run_id").alias("value"))
    return X.reference_distribution(runs, newest)


_RANK = "SELECT run_id, uri_path, count(*) AS requests, row_number() OVER (PARTITION BY run_id ORDER BY count(*) DESC, uri_path) AS rank FROM runs WHERE uri_path IS NOT NULL GROUP BY 1, 2"


@query("path_rank", _RANK, "e runs")
def _(t):
    return X.path_rank(_runs(t))


@query("path_trend", f"SELECT run_id, r.requests, r.requests * 1.0 / n AS share, rank, r.requests * 1.0 / lag(r.requests) OVER (ORDER BY run_id) AS ratio FROM (SELECT run_id, count(*) AS n FROM runs GROUP BY 1) LEFT JOIN (SELECT * FROM ({_RANK}) WHERE uri_path = '/view/3') r USING (run_id)", "e runs")
def _(t):
    return X.path_trend(_runs(t), "/view/3")


_OBSERVED = "SELECT run_id, concat(split_part(source_ip,'.',1),'.',split_part(source_ip,'.',2),'.',split_part(source_ip,'.',3),'.0/24') AS entity, CAST(min(floor(sec / 60)) AS BIGINT) AS first_minute, CAST(max(floor(sec / 60)) AS BIGINT) AS last_minute FROM runs WHERE source_ip IS NOT NULL GROUP BY 1, 2"


@query("observation_store", f"SELECT entity, min(first_minute) AS first_minute, max(last_minute) AS last_minute, count(DISTINCT run_id) AS runs FROM ({_OBSERVED}) GROUP BY 1", "e runs")
def _(t):
    seen = X.observations(_runs(t))
    first = seen.filter("run_id <= 'run-2818'")
    return X.read_observation_store(first.unionByName(X.update_observation_store(first, seen)))


@query("observation_store_networks", f"SELECT run_id, concat('AS', asn) AS entity, CAST(min(floor(sec / 60)) AS BIGINT) AS first_minute, CAST(max(floor(sec / 60)) AS BIGINT) AS last_minute FROM runs JOIN ({_ASN}) ON ip = source_ip GROUP BY 1, 2 UNION ALL {_OBSERVED}", "e ipn nets runs")
def _(t):
    return X.observations(_runs(t), asn=X.asn_lookup(_ips(t), t.networks))


#: Dispositions derived from findings: every seventh event is expected, every eleventh needs review, the later entry counts.
CTES["disp"] = "disp AS (SELECT source_ip, template_id, upper(method) AS method, uri_path, uri_query, arg_max(disposition, recorded_at) AS disposition FROM (SELECT *, CASE WHEN event_id % 7 = 0 THEN 'expected' ELSE 'needs-review' END AS disposition, event_id AS recorded_at FROM fd WHERE (event_id % 7 = 0 OR event_id % 11 = 0) AND source_ip IS NOT NULL) GROUP BY 1, 2, 3, 4, 5)"


def _store(t):
    f = t.findings.filter("(event_id % 7 = 0 or event_id % 11 = 0) and source_ip is not null")
    return f.select("source_ip", "template_id", F.upper("method").alias("method"), "uri_path", "uri_query", F.when(F.col("event_id") % 7 == 0, "expected").otherwise("needs-review").alias("disposition"), F.col("event_id").alias("recorded_at"), F.lit(None).cast("timestamp").alias("review_after"))


@query("apply_dispositions", "SELECT event_id, fd.template_id, disposition FROM fd LEFT JOIN disp ON fd.source_ip = disp.source_ip AND fd.template_id = disp.template_id AND upper(fd.method) = disp.method AND fd.uri_path = disp.uri_path AND fd.uri_query IS NOT DISTINCT FROM disp.uri_query", "e det fd disp")
def _(t):
    return X.apply_dispositions(t.findings, _store(t)).select("event_id", "template_id", "disposition")


@query("disposition_counts", "SELECT count(*) AS findings, count(disposition) AS reviewed, count(*) FILTER (disposition = 'expected') AS expected, count(*) FILTER (disposition = 'needs-review') AS needs_review, count(*) FILTER (disposition IS NULL) AS unclassified, CAST(0 AS BIGINT) AS due FROM fd LEFT JOIN disp ON fd.source_ip = disp.source_ip AND fd.template_id = disp.template_id AND upper(fd.method) = disp.method AND fd.uri_path = disp.uri_path AND fd.uri_query IS NOT DISTINCT FROM disp.uri_query", "e det fd disp")
def _(t):
    return X.disposition_counts(t.findings, _store(t), "2024-02-01")


@query("latest_per_key", "SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY 1", "")
def _(t):
    return X.latest_per_key(t.read("events").select("user_id", "event_type", "event_id"), ["user_id"], "event_id").select("user_id", "event_type", "event_id")


@query("shared_input_files", "SELECT doc_id, source, md5(text) AS digest FROM documents WHERE md5(text) IN (SELECT md5(text) FROM documents GROUP BY 1 HAVING count(DISTINCT source) > 1)", "")
def _(t):
    files = t.read("documents").select("doc_id", F.col("source").alias("cohort"), F.md5("text").alias("sha256"))
    return X.shared_input_files(files).select("doc_id", F.col("cohort").alias("source"), F.col("sha256").alias("digest"))
