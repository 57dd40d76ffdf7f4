"""Queries of the concentration, stack and time operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from trailwork.functions import web as W
from trailwork.operators import compare as X
from trailwork.operators import concentration as C
from trailwork.plans.base import query

_CLASS = "CASE WHEN status IS NULL THEN 'unavailable' WHEN status = 499 THEN '499' WHEN status BETWEEN 100 AND 199 THEN '1xx' WHEN status BETWEEN 200 AND 299 THEN '2xx' WHEN status BETWEEN 300 AND 399 THEN '3xx' WHEN status BETWEEN 400 AND 498 THEN '4xx' WHEN status BETWEEN 500 AND 599 THEN '5xx' ELSE 'other' END"
_COUNTS = ", ".join(f"count(*) FILTER ({_CLASS} = '{c}') AS \"n_{c}\"" for c in C.CLASSES)
_SEG = "concat('/', split_part(uri_path, '/', 2))"
_BLOCK = "concat(split_part(source_ip,'.',1),'.',split_part(source_ip,'.',2),'.',split_part(source_ip,'.',3),'.0/24')"
_BYTES = "CAST(sum(response_bytes) AS BIGINT) AS bytes, count(response_bytes) AS bytes_available"
_DIVERSITY = f"SELECT source_ip, count(DISTINCT {_SEG}) AS segments, count(DISTINCT CASE WHEN status = 404 THEN {_SEG} END) AS segments_404, count(DISTINCT CASE WHEN status BETWEEN 400 AND 498 THEN {_SEG} END) AS segments_4xx FROM e WHERE source_ip IS NOT NULL AND uri_path IS NOT NULL GROUP BY 1"
_PAIRS = "SELECT source_ip, uri_path, count(*) AS requests FROM e WHERE source_ip IS NOT NULL AND uri_path IS NOT NULL GROUP BY 1, 2"
_TOP = f"SELECT source_ip, uri_path AS top_path, requests AS top_path_requests FROM ({_PAIRS}) QUALIFY row_number() OVER (PARTITION BY source_ip ORDER BY requests DESC, uri_path) = 1"


@query("time_filter", "SELECT count(*) FILTER (coalesce(ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20', false)) AS kept, count(*) FILTER (ts IS NOT NULL AND NOT ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20') AS outside, count(*) FILTER (ts IS NULL) AS undated FROM e")
def _(t):
    return C.time_filter_counts(t.events, "2024-01-05", "2024-01-20")


@query("field_availability", "SELECT count(*) AS requests, count(ts) AS has_ts, count(source_ip) AS has_source_ip, count(method) AS has_method, count(host) AS has_host, count(uri_path) AS has_uri_path, count(uri_query) AS has_uri_query, count(status) AS has_status, count(response_bytes) AS has_response_bytes, count(user_agent) AS has_user_agent, count(ja4) AS has_ja4, count(waf_action) AS has_waf_action, count(request_id) AS has_request_id, count(uri_fragment) AS has_uri_fragment, count(*) AS has_headers FROM e")
def _(t):
    return C.field_availability(t.events)


@query("path_concentration", f"""SELECT p.*, coalesce(k.query_keys, 0) AS query_keys, p.requests * 1.0 / (SELECT count(*) FROM e) AS share, CASE WHEN peers = 0 THEN 0.0 ELSE p.requests * 1.0 / peers END AS requests_per_peer
    FROM (SELECT uri_path, count(*) AS requests, count(DISTINCT source_ip) AS peers, {_COUNTS}, {_BYTES}, count(uri_query) AS with_query, count(DISTINCT uri_query) AS query_strings FROM e WHERE uri_path IS NOT NULL GROUP BY 1) p
    LEFT JOIN (SELECT uri_path, count(DISTINCT split_part(uri_query, '=', 1)) AS query_keys FROM e WHERE uri_path IS NOT NULL AND uri_query IS NOT NULL GROUP BY 1) k USING (uri_path)""")
def _(t):
    return C.path_concentration(t.events)


@query("source_concentration", f"SELECT s.*, m.top_path, m.top_path_requests, coalesce(segments, 0) AS segments, coalesce(segments_404, 0) AS segments_404, coalesce(segments_4xx, 0) AS segments_4xx FROM (SELECT source_ip, count(*) AS requests, {_COUNTS}, {_BYTES} FROM e WHERE source_ip IS NOT NULL GROUP BY 1) s LEFT JOIN ({_TOP}) m USING (source_ip) LEFT JOIN ({_DIVERSITY}) d USING (source_ip)")
def _(t):
    return C.source_concentration(t.events)


@query("source_path_pairs", _PAIRS)
def _(t):
    return C.source_path_pairs(t.events)


@query("most_requested_path", _TOP)
def _(t):
    return C.most_requested_path(t.events)


@query("segment_diversity", _DIVERSITY)
def _(t):
    return C.segment_diversity(t.events)


@query("segment_diversity_summary", f"SELECT count(*) AS peers, max(segments) AS max_segments, median(segments) AS median_segments, max(segments_404) AS max_404, median(CASE WHEN segments_404 > 0 THEN segments_404 END) AS median_positive_404 FROM ({_DIVERSITY})")
def _(t):
    return C.segment_diversity_summary(t.events)


@query("response_outcomes", "SELECT count(*) AS requests, " + ", ".join(f"count(*) FILTER ({_CLASS} = '{c}') * 1.0 / count(*) AS \"share_{c}\"" for c in C.CLASSES) + " FROM e")
def _(t):
    return C.response_outcomes(t.events)


@query("status_codes", "SELECT uri_path, status, count(*) AS requests FROM e WHERE uri_path IS NOT NULL GROUP BY 1, 2")
def _(t):
    return C.status_codes(t.events, "uri_path")


@query("top_paths", "SELECT uri_path, count(*) AS requests FROM e WHERE uri_path IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def _(t):
    return C.top_paths(t.events)


@query("top_sources", "SELECT source_ip, count(*) AS requests FROM e WHERE source_ip IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def _(t):
    return C.top_sources(t.events)


@query("top_shares", """SELECT n.requests, p.top_path, p.top_path_requests, p.n * 1.0 / n.requests AS top_paths_share, s.n * 1.0 / n.requests AS top_sources_share FROM (SELECT count(*) AS requests FROM e) n,
    (SELECT arg_min(uri_path, k) AS top_path, max(requests) AS top_path_requests, sum(requests) AS n FROM (SELECT uri_path, count(*) AS requests, row_number() OVER (ORDER BY count(*) DESC, uri_path) AS k FROM e WHERE uri_path IS NOT NULL GROUP BY 1) WHERE k <= 10) p,
    (SELECT sum(requests) AS n FROM (SELECT source_ip, count(*) AS requests, row_number() OVER (ORDER BY count(*) DESC, source_ip) AS k FROM e WHERE source_ip IS NOT NULL GROUP BY 1) WHERE k <= 10) s""")
def _(t):
    return C.top_shares(t.events)


@query("prefix_concentration", f"""SELECT a.*, coalesce(b.paths, 0) AS paths, coalesce(b.paths_once, 0) AS paths_once, b.top_path FROM (SELECT block, CAST(sum(n) AS BIGINT) AS requests, CAST(sum(b) AS BIGINT) AS bytes, count(*) AS peers, max(n) AS max_per_peer FROM (SELECT {_BLOCK} AS block, source_ip, count(*) AS n, sum(response_bytes) AS b FROM e WHERE source_ip IS NOT NULL GROUP BY 1, 2) GROUP BY 1) a
    LEFT JOIN (SELECT block, count(*) AS paths, count(*) FILTER (n = 1) AS paths_once, arg_min(uri_path, k) AS top_path FROM (SELECT *, row_number() OVER (PARTITION BY block ORDER BY n DESC, uri_path) AS k FROM (SELECT {_BLOCK} AS block, uri_path, count(*) AS n FROM e WHERE source_ip IS NOT NULL AND uri_path IS NOT NULL GROUP BY 1, 2)) GROUP BY 1) b USING (block)""")
def _(t):
    return C.prefix_concentration(t.events)


def _focus_sql(where: str) -> str:
    return f"SELECT *, requests * 1.0 / all_requests AS share FROM (SELECT count(*) AS requests, count(DISTINCT source_ip) AS peers, count(DISTINCT uri_path) AS paths, {_COUNTS}, {_BYTES} FROM e WHERE {where}), (SELECT count(*) AS all_requests FROM e)"


@query("focus_path", _focus_sql("uri_path = '/login'"))
def _(t):
    return C.focus_summary(t.events, path="/login")


@query("focus_subtree", _focus_sql("uri_path = '/click' OR starts_with(uri_path, '/click/')"))
def _(t):
    return C.focus_summary(t.events, path_prefix="/click")


@query("focus_sources", _focus_sql("source_ip IN ('198.51.3.17', '198.51.1.8', '198.51.4.4')"))
def _(t):
    return C.focus_summary(t.events, source_ips=["198.51.3.17", "198.51.1.8", "198.51.4.4"])


_FOCUSED = "SELECT * FROM e WHERE uri_path = '/click' OR starts_with(uri_path, '/click/')"


@query("focus_groups", f"""SELECT kind, name, requests, peers, requests / (SELECT count(*) FROM ({_FOCUSED})) AS share FROM (SELECT 'block' AS kind, concat(split_part(source_ip,'.',1),'.',split_part(source_ip,'.',2),'.',split_part(source_ip,'.',3),'.0/24') AS name, count(*) AS requests, count(DISTINCT source_ip) AS peers FROM ({_FOCUSED}) WHERE source_ip IS NOT NULL GROUP BY 1, 2
    UNION ALL SELECT CASE WHEN asn IS NULL THEN 'unresolved' ELSE 'asn' END, coalesce(CAST(asn AS VARCHAR), 'unresolved'), count(*), count(DISTINCT source_ip) FROM ({_FOCUSED}) LEFT JOIN (SELECT ip, arg_max(asn, bits) AS asn FROM ipn JOIN nets ON num BETWEEN lo AND hi WHERE bits > 16 GROUP BY ip) ON ip = source_ip GROUP BY 1, 2)""", "e ipn nets")
def _(t):
    asn = X.asn_lookup(t.events.select(F.col("source_ip").alias("ip")), t.networks.filter("network not like '%/16'"))
    return C.focus_groups(t.events, asn, path_prefix="/click")


@query("path_statuses", "SELECT uri_path, status, count(*) AS requests FROM e WHERE uri_path IS NOT NULL GROUP BY 1, 2")
def _(t):
    return C.path_statuses(t.events)


@query("path_waf_actions", "SELECT uri_path, CASE WHEN waf_action IS NULL THEN 'unavailable' WHEN upper(waf_action) IN ('ALLOW','BLOCK','COUNT','CAPTCHA','CHALLENGE') THEN upper(waf_action) ELSE 'other' END AS action, count(*) AS requests FROM e WHERE uri_path IS NOT NULL GROUP BY 1, 2")
def _(t):
    return C.path_waf_actions(t.events)


@query("request_rates", "SELECT width, count(*) AS buckets, max(n) AS peak, median(n) AS median, (SELECT count(*) FROM e WHERE ts IS NULL) AS undated, max(n) / median(n) AS peak_to_median FROM (SELECT width, CAST(floor(sec / width) AS BIGINT) AS b, count(*) AS n FROM e, (VALUES (60), (600), (3600), (86400)) w(width) WHERE ts IS NOT NULL GROUP BY 1, 2) GROUP BY 1")
def _(t):
    return C.request_rates(t.events)


@query("outcome_windows", """SELECT width, count(*) FILTER (able) AS eligible, count(*) FILTER (n < 20) AS below_floor, count(*) FILTER (n >= 20 AND known = 0) AS without_status, min(CASE WHEN able THEN ok * 1.0 / n END) AS min_2xx_share, arg_min(start, k2) FILTER (able) AS min_2xx_start, max(CASE WHEN able THEN bad * 1.0 / n END) AS max_5xx_share, arg_min(start, k5) FILTER (able) AS max_5xx_start, count(*) FILTER (able AND ok < 0.5 * n) AS below_threshold
    FROM (SELECT *, n >= 20 AND known > 0 AS able, row_number() OVER (PARTITION BY width ORDER BY ok * 1.0 / n, start) AS k2, row_number() OVER (PARTITION BY width ORDER BY bad * 1.0 / n DESC, start) AS k5 FROM (SELECT width, CAST(floor(sec / width) AS BIGINT) * width AS start, count(*) AS n, count(status) AS known, count(*) FILTER (status BETWEEN 200 AND 299) AS ok, count(*) FILTER (status BETWEEN 500 AND 599) AS bad FROM e, (VALUES (60), (600), (3600), (86400)) w(width) WHERE ts IS NOT NULL GROUP BY 1, 2)) GROUP BY 1""")
def _(t):
    return C.outcome_windows(t.events)


@query("minute_series", "SELECT CAST(floor(sec / 60) AS BIGINT) * 60 AS minute, count(*) AS requests FROM e WHERE ts IS NOT NULL GROUP BY 1")
def _(t):
    return C.minute_series(t.events)


@query("status_minute_series", f"SELECT CAST(floor(sec / 60) AS BIGINT) * 60 AS minute, {_CLASS} AS class, count(*) AS requests FROM e WHERE ts IS NOT NULL GROUP BY 1, 2")
def _(t):
    return C.status_minute_series(t.events)


_LONG = """long AS (SELECT source_ip, ts, sec, status, field, value FROM (
    SELECT *, unnest(['method','host','status','user-agent','ja4','path-extension','path-depth','query-key','header-name']) AS field,
      unnest([method, host, CAST(status AS VARCHAR), user_agent, ja4, CASE WHEN regexp_matches(split_part(uri_path, '/', -1), '^.+[.][^.]+$') THEN lower(split_part(uri_path, '.', -1)) WHEN uri_path IS NOT NULL THEN '(none)' END, CAST(len([x for x in string_split(uri_path, '/') if x <> '']) AS VARCHAR), nullif(split_part(uri_query, '=', 1), ''), CASE WHEN h1 IS NOT NULL OR h2 IS NOT NULL THEN 'x-debug' END]) AS value FROM e) WHERE value IS NOT NULL)"""
_STACK = f"SELECT field, value, count(*) AS requests, count(DISTINCT source_ip) AS peers, count(*) FILTER (source_ip IS NULL) AS without_peer, min(sec) AS first_seen, max(sec) AS last_seen, count(*) FILTER (ts IS NULL) AS undated, {_COUNTS} FROM long GROUP BY 1, 2"
from trailwork.plans.base import CTES  # noqa: E402

CTES["long"] = _LONG


@query("stack", _STACK, "e long")
def _(t):
    return C.stack(t.events)


@query("stack_histogram", "SELECT field, count(*) AS values, count(*) FILTER (n = 1) AS once, count(*) FILTER (n BETWEEN 2 AND 9) AS to_9, count(*) FILTER (n BETWEEN 10 AND 99) AS to_99, count(*) FILTER (n BETWEEN 100 AND 999) AS to_999, count(*) FILTER (n >= 1000) AS more FROM (SELECT field, value, count(*) AS n FROM long GROUP BY 1, 2) GROUP BY 1", "e long")
def _(t):
    return C.stack_histogram(t.events)


@query("stack_rarest", f"SELECT field, value, requests, peers, rank FROM (SELECT *, row_number() OVER (PARTITION BY field ORDER BY requests, peers NULLS LAST, value) AS rank FROM ({_STACK})) WHERE rank <= 5", "e long")
def _(t):
    return C.stack_ranked(t.events, 5, rarest=True)


@query("stack_top", f"SELECT field, value, requests, peers, rank FROM (SELECT *, row_number() OVER (PARTITION BY field ORDER BY requests DESC, peers DESC NULLS LAST, value) AS rank FROM ({_STACK})) WHERE rank <= 5", "e long")
def _(t):
    return C.stack_ranked(t.events, 5, rarest=False)


@query("waf_summary", "SELECT CASE WHEN waf_action IS NULL THEN 'unavailable' WHEN upper(waf_action) IN ('ALLOW','BLOCK','COUNT','CAPTCHA','CHALLENGE') THEN upper(waf_action) ELSE 'other' END AS action, count(*) AS requests, count(DISTINCT source_ip) AS peers, count(DISTINCT ja4) AS fingerprints FROM e GROUP BY 1")
def _(t):
    return C.waf_summary(t.events)


CTES["waf_long"] = """waf_long AS (SELECT source_ip, unnest(['ja4', 'country']) AS field, unnest([ja4, CASE event_id % 3 WHEN 0 THEN 'NL' WHEN 1 THEN 'JP' END]) AS value FROM e
    UNION ALL SELECT source_ip, 'label', unnest(CASE event_id % 4 WHEN 0 THEN ['bot', 'scanner'] WHEN 1 THEN ['bot'] ELSE [NULL] END) FROM e)"""


def _labelled(t):
    k = F.col("event_id")
    labels = F.when(k % 4 == 0, F.array(F.lit("bot"), F.lit("scanner"))).when(k % 4 == 1, F.array(F.lit("bot"))).when(k % 4 == 2, F.array().cast("array<string>"))
    return t.events.withColumns({"country": F.when(k % 3 == 0, "NL").when(k % 3 == 1, "JP"), "waf_labels": labels})


@query("waf_values", "SELECT field, value, count(*) AS requests FROM waf_long GROUP BY 1, 2", "e waf_long")
def _(t):
    return C.waf_values(_labelled(t))


@query("waf_value_summary", "SELECT source_ip, field, count(DISTINCT value) AS values, count(value) AS occurrences, count(*) FILTER (value IS NULL) AS without_value FROM waf_long WHERE source_ip IS NOT NULL GROUP BY 1, 2", "e waf_long")
def _(t):
    return C.waf_value_summary(_labelled(t), "source_ip")


@query("ja4_sources", "SELECT ja4, count(*) AS requests, count(DISTINCT source_ip) AS peers FROM e WHERE ja4 IS NOT NULL GROUP BY 1")
def _(t):
    return C.ja4_sources(t.events)


_DAILY = "SELECT count(*) AS requests, count(DISTINCT source_ip) AS peers, count(DISTINCT uri_path) AS paths, count(DISTINCT ja4) AS fingerprints, count(*) FILTER (status BETWEEN 200 AND 299) * 1.0 / count(*) AS share_2xx, count(*) FILTER (status BETWEEN 400 AND 498) * 1.0 / count(*) AS share_4xx, count(*) FILTER (status BETWEEN 500 AND 599) * 1.0 / count(*) AS share_5xx, CAST(sum(response_bytes) AS BIGINT) AS bytes FROM e"


@query("daily_summary", _DAILY)
def _(t):
    return C.daily_summary(t.events)


@query("url_split", """SELECT page_id, split_part(split_part(url, '#', 1), '?', 1) AS path, nullif(CASE WHEN contains(split_part(url, '#', 1), '?') THEN regexp_extract(split_part(url, '#', 1), '\\?(.*)$', 1) END, '') AS query, nullif(CASE WHEN contains(url, '#') THEN regexp_extract(url, '#(.*)$', 1) END, '') AS fragment,
    lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)) AS host, CAST(len([split_part(p, '=', 1) for p in string_split(coalesce(CASE WHEN contains(split_part(url, '#', 1), '?') THEN regexp_extract(split_part(url, '#', 1), '\\?(.*)$', 1) END, ''), '&') if split_part(p, '=', 1) <> '']) AS INT) AS n_keys FROM pages""", "")
def _(t):
    path, q, fragment = W.split_target(F.col("url"))
    return t.read("pages").select("page_id", path.alias("path"), q.alias("query"), fragment.alias("fragment"), F.lower(F.regexp_extract("url", r"^[a-z]+://([^/:?#]+)", 1)).alias("host"), F.size(W.query_keys(q)).alias("n_keys"))
