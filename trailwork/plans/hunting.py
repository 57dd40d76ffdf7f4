"""Queries of the matching, finding, triage and replay operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from trailwork.functions import web as W
from trailwork.functions.spelling import decoded
from trailwork.operators import compare as X
from trailwork.operators import findings as FD
from trailwork.operators import matching as M
from trailwork.operators import rules as R
from trailwork.plans.base import CTES, FRAGMENT, HEADER, query

_FD = "e det fd"
_FC = "e det det_cves fd fc"


@query("match_detections", "SELECT event_id, template_id, ordinal, specificity, distinctiveness, outcome FROM fd", _FD)
def _(t):
    return t.findings.select("event_id", "template_id", "ordinal", "specificity", "distinctiveness", "outcome")


@query("filter_findings", "SELECT event_id, template_id FROM fd WHERE outcome = 'not-blocked' AND NOT (distinctiveness = 'generic' AND specificity = 'response-unverified')", _FD)
def _(t):
    return M.filter_findings(t.findings, "not-blocked").select("event_id", "template_id")


_SUMMARY = """SELECT s.*, tt.template_ids, CASE WHEN blocked + not_blocked > 0 THEN not_blocked * 1.0 / (blocked + not_blocked) END AS protection_gap FROM (SELECT cve, count(*) AS requests, min(sec) AS first_seen, max(sec) AS last_seen, count(DISTINCT source_ip) AS peers, count(DISTINCT ja4) AS fingerprints, count(DISTINCT host) AS hosts,
    count(*) FILTER (outcome = 'blocked') AS blocked, count(*) FILTER (outcome = 'not-blocked') AS not_blocked, count(*) FILTER (outcome = 'unknown') AS unknown_outcome, count(*) FILTER (count_evidence) AS count_evidence, count(*) FILTER (status BETWEEN 200 AND 299) AS ok, count(*) FILTER (distinctiveness = 'distinctive') AS distinctive, count(*) FILTER (distinctiveness = 'generic') AS generic, ['unknown','info','low','medium','high','critical'][max(severity_rank)] AS severity, ['unknown','undetectable','low','medium','high'][max(detectability_rank)] AS detectability FROM fc GROUP BY cve) s
    JOIN (SELECT cve, string_agg(DISTINCT template_id, ';' ORDER BY template_id) AS template_ids FROM fd JOIN det_cves USING (template_id, ordinal) GROUP BY cve) tt USING (cve)"""


@query("cve_summary", _SUMMARY, _FC)
def _(t):
    return FD.cve_summary(t.findings)


@query("kev_flag", "SELECT cve, count(*) AS requests, cve IN ('CVE-2024-0001','CVE-2024-0004','CVE-1999-9999') AS kev FROM fc GROUP BY cve", _FC)
def _(t):
    return FD.kev_flag(FD.by_cve(t.findings).groupBy("cve").agg(F.count("*").alias("requests")), t.kev)


@query("severity_counts", "SELECT " + ", ".join(f"count(*) FILTER (severity = '{s}') AS {s}" for s in FD.SEVERITIES) + " FROM fd", _FD)
def _(t):
    return FD.severity_counts(t.findings)


@query("findings_by_waf_action", "SELECT CASE WHEN waf_action IS NULL THEN 'unavailable' WHEN upper(waf_action) IN ('ALLOW','BLOCK','COUNT','CAPTCHA','CHALLENGE') THEN upper(waf_action) ELSE 'other' END AS action, count(*) AS findings FROM fd GROUP BY 1", _FD)
def _(t):
    return FD.findings_by_waf_action(t.findings)


@query("explain_paths", "SELECT a.*, b.cves FROM (SELECT method, uri_path, count(*) AS matches, count(DISTINCT template_id) AS templates, any_value(distinctiveness) AS distinctiveness FROM fd GROUP BY 1, 2) a JOIN (SELECT method, uri_path, count(DISTINCT cve) AS cves FROM fd JOIN det_cves USING (template_id, ordinal) GROUP BY 1, 2) b USING (method, uri_path)", _FC)
def _(t):
    return FD.explain_paths(t.findings)


@query("sensitive_probe_success", "SELECT count(*) AS matches, count(*) FILTER (status BETWEEN 200 AND 299) AS ok, count(*) FILTER (status IS NULL) AS without_status, count(*) FILTER (status IS NOT NULL AND NOT status BETWEEN 200 AND 299) AS rest FROM fd WHERE template_id = 'tpl-env'", _FD)
def _(t):
    return FD.probe_success(t.findings, "tpl-env")


RULES = [
    {"rule_id": "env-get", "level": "high", "selections": [{"name": "p", "fields": [{"field": "cs-uri-stem", "values": ["/.ENV"]}]}, {"name": "m", "fields": [{"field": "cs-method", "values": ["get", "HEAD"]}]}, {"name": "ok", "fields": [{"field": "sc-status", "values": ["200"]}]}], "condition": [[("p", False), ("m", False)], [("p", False), ("ok", False)]]},
    {"rule_id": "pur-no-curl", "level": "low", "selections": [{"name": "p", "fields": [{"field": "uri_path", "contains": True, "values": ["/PUR", "/1"], "all": True}]}, {"name": "ua", "fields": [{"field": "cs-user-agent", "contains": True, "values": ["curl"]}]}], "condition": [[("p", False), ("ua", True)]]},
    {"rule_id": "word", "level": "info", "selections": [{"name": "k", "keywords": ["HEAD"]}, {"name": "h", "fields": [{"field": "cs-host", "values": ["shop.example.org"]}]}], "condition": [[("k", False), ("h", False)]]},
]
_RULES = """rules AS (SELECT event_id, 'env-get' AS rule_id, 'high' AS level FROM e WHERE lower(uri_path) = '/.env' AND (coalesce(lower(method) IN ('get','head'), false) OR coalesce(status = 200, false))
    UNION ALL SELECT event_id, 'pur-no-curl', 'low' FROM e WHERE contains(lower(uri_path), '/pur') AND contains(lower(uri_path), '/1') AND NOT coalesce(contains(lower(user_agent), 'curl'), false)
    UNION ALL SELECT event_id, 'word', 'info' FROM e WHERE (contains(lower(method), 'head') OR coalesce(contains(lower(host), 'head'), false)) AND coalesce(host = 'shop.example.org', false))"""
CTES["rules"] = _RULES


@query("match_rules", "SELECT * FROM rules", "e rules")
def _(t):
    return M.match_rules(t.events, RULES).select("event_id", "rule_id", "level")


_RANGE = "ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20'"


def _metrics(where: str) -> str:
    outside = f"count(*) FILTER (ts IS NOT NULL AND NOT ({where})) AS outside_range, count(*) FILTER (ts IS NULL AND NOT coalesce({where}, false)) AS undated_excluded"
    levels = ", ".join(f"count(*) FILTER (detectability_rank = {k}) AS {n}_confidence" for k, n in ((5, "high"), (4, "medium"), (3, "low")))
    outcomes = ", ".join(f"count(*) FILTER (outcome = '{o}') AS cve_{o.replace('-', '_')}" for o in ("blocked", "not-blocked", "unknown"))
    return f"""SELECT * FROM (SELECT count(*) AS requests, count(DISTINCT source_ip) AS peers, count(DISTINCT ja4) AS fingerprints, min(sec) AS earliest, max(sec) AS latest FROM e WHERE {where}), (SELECT {outside} FROM e), (SELECT CAST(3 AS BIGINT) AS rules_evaluated, count(*) AS rule_matches, count(DISTINCT event_id) AS rule_matched_requests, count(DISTINCT rule_id) AS rules_matched FROM rules JOIN e USING (event_id) WHERE {where}),
    (SELECT count(*) AS matches, count(DISTINCT event_id) AS matched_requests, count(*) FILTER (specificity = 'request-specific') AS request_specific, count(*) FILTER (distinctiveness = 'distinctive') AS distinctive, count(*) FILTER (severity IN ('high','critical')) AS high_or_critical, count(DISTINCT source_ip) AS matched_peers, count(DISTINCT template_id) AS templates FROM fd WHERE {where}),
    (SELECT count(*) AS cve_matches, count(DISTINCT cve) AS cves, count(*) FILTER (specific) AS cve_request_specific, count(*) FILTER (NOT specific) AS cve_response_unverified, {levels}, {outcomes}, count(*) FILTER (count_evidence) AS count_evidence FROM fc WHERE {where})"""


@query("hunt_metrics", _metrics("true"), _FC + " rules")
def _(t):
    return FD.hunt_metrics(t.events, t.findings, M.match_rules(t.events, RULES), len(RULES))


@query("hunt_metrics_in_range", _metrics(_RANGE), _FC + " rules")
def _(t):
    return FD.hunt_metrics(t.events, t.findings, M.match_rules(t.events, RULES), len(RULES), "2024-01-05", "2024-01-20")


@query("cve_statuses", "SELECT cve, status, count(*) AS requests FROM fc WHERE status IS NOT NULL GROUP BY 1, 2", _FC)
def _(t):
    return FD.cve_statuses(t.findings)


_HITS = """hits AS (SELECT event_id, indicator_id, 'source_ip' AS field FROM e JOIN ind ON type = 'ip' AND replace(value, '::ffff:', '') = source_ip
    UNION SELECT event_id, 9, 'url' FROM e WHERE host = 'www.example.org' AND uri_path = '/.env'
    UNION SELECT event_id, 11, 'source_ip' FROM e JOIN ipn ON ip = source_ip WHERE num BETWEEN 3325232384 AND 3325232511
    UNION SELECT event_id, indicator_id, 'source_ip' FROM e JOIN ipn ON ip = source_ip JOIN ind ON type = 'cidr' AND ((value = '198.51.4.0/25' AND num BETWEEN 3325232128 AND 3325232255) OR (value = '198.51.0.0/16' AND num BETWEEN 3325231104 AND 3325296639))
    UNION SELECT event_id, indicator_id, 'uri_path' FROM e JOIN ind ON (type = 'path' AND value = uri_path) OR (type = 'path-prefix' AND starts_with(uri_path, value))
    UNION SELECT event_id, indicator_id, 'user_agent' FROM e JOIN ind ON type = 'user-agent' AND value = user_agent
    UNION SELECT event_id, indicator_id, 'ja4' FROM e JOIN ind ON type = 'ja4' AND value = ja4
    UNION SELECT event_id, indicator_id, 'host' FROM e JOIN ind ON type = 'host' AND value = host)"""
CTES["hits"] = _HITS


#: Rules that name a log source, over requests of three.
SOURCED = [
    {"rule_id": "waf-only", "logsource": {"category": "WebServer", "product": "aws", "service": "WAF"}, "selections": [{"name": "p", "fields": [{"field": "uri_path", "values": ["/.env"]}]}], "condition": [[("p", False)]]},
    {"rule_id": "apache", "logsource": {"product": "apache_httpd", "service": "any"}, "selections": [{"name": "k", "keywords": ["head", "shop"]}], "condition": [[("k", False)]]},
    {"rule_id": "proxy", "logsource": {"category": "proxy"}, "selections": [{"name": "p", "fields": [{"field": "uri_path", "values": ["/.env"]}]}], "condition": [[("p", False)]]},
    {"rule_id": "anywhere", "logsource": {"category": "webserver"}, "selections": [{"name": "p", "fields": [{"field": "uri_path", "values": ["/login"]}]}], "condition": [[("p", False)]]},
]


def _three_sources():
    return F.element_at(F.array(*map(F.lit, ("aws-waf", "apache-combined", "aws-alb"))), (F.col("event_id") % 3 + 1).cast("int"))


@query("match_rules_by_source", "SELECT event_id, 'waf-only' AS rule_id FROM e WHERE event_id % 3 = 0 AND uri_path = '/.env' UNION ALL SELECT event_id, 'apache' FROM e WHERE event_id % 3 = 1 AND (method = 'HEAD' OR coalesce(contains(host, 'shop'), false)) UNION ALL SELECT event_id, 'anywhere' FROM e WHERE uri_path = '/login'")
def _(t):
    return M.match_rules(t.events.withColumn("log_source", _three_sources()), SOURCED).select("event_id", "rule_id")


@query("match_indicators", "SELECT event_id, indicator_id, string_agg(field, ';' ORDER BY field) AS fields FROM hits GROUP BY 1, 2", "e ipn ind hits")
def _(t):
    return M.match_indicators(t.events, t.indicators).select("event_id", "indicator_id", F.array_join("fields", ";").alias("fields"))


_VALID = "CASE WHEN ts IS NULL AND (valid_from IS NOT NULL OR valid_until IS NOT NULL) THEN 'unavailable' WHEN coalesce(ts >= CAST(valid_from AS TIMESTAMP), true) AND coalesce(ts < CAST(valid_until AS TIMESTAMP), true) THEN 'valid' ELSE 'outside' END"


@query("ioc_summary", f"SELECT indicator_id, type, count(*) AS matches, count(DISTINCT source_ip) AS peers, min(sec) AS first_seen, max(sec) AS last_seen, count(*) FILTER (v = 'outside') AS outside, count(*) FILTER (v = 'unavailable') AS unavailable FROM (SELECT h.indicator_id, type, source_ip, sec, {_VALID} AS v FROM (SELECT DISTINCT event_id, indicator_id FROM hits) h JOIN e USING (event_id) JOIN ind USING (indicator_id)) GROUP BY 1, 2", "e ipn ind hits")
def _(t):
    return M.ioc_summary(t.events, M.match_indicators(t.events, t.indicators), t.indicators)


@query("indicator_validity", f"SELECT indicator_id, {_VALID} AS validity, count(*) AS matches FROM (SELECT DISTINCT event_id, indicator_id FROM hits) h JOIN e USING (event_id) JOIN ind USING (indicator_id) GROUP BY 1, 2", "e ipn ind hits")
def _(t):
    rows = M.match_indicators(t.events, t.indicators).join(t.events.select("event_id", "ts"), "event_id").join(M.small(t.indicators), "indicator_id")
    return rows.groupBy("indicator_id", M.indicator_validity(F.col("ts"), F.col("valid_from"), F.col("valid_until")).alias("validity")).agg(F.count("*").alias("matches"))


@query("ioc_fields", "SELECT indicator_id, field, count(*) AS requests FROM hits GROUP BY 1, 2", "e ipn ind hits")
def _(t):
    return M.ioc_fields(M.match_indicators(t.events, t.indicators))


@query("ioc_totals", "SELECT (SELECT count(*) FROM e) AS requests, count(DISTINCT event_id) AS matched_requests, count(*) AS pairs, count(DISTINCT indicator_id) AS indicators_matched, (SELECT count(*) FROM ind) AS indicators FROM (SELECT DISTINCT event_id, indicator_id FROM hits)", "e ipn ind hits")
def _(t):
    return M.ioc_totals(t.events, M.match_indicators(t.events, t.indicators), t.indicators)


TREE = {"kind": "and", "conditions": [{"kind": "or", "conditions": [{"kind": "uri_starts_with", "value": "/click"}, {"kind": "uri_contains_ascii_case_insensitive", "value": "SIGN"}]}, {"kind": "not", "condition": {"kind": "query_contains", "value": "k=1"}}, {"kind": "not", "condition": {"kind": "host_equals", "value": "shop.example.org"}}]}
_TREE = "(coalesce(starts_with(uri_path, '/click'), false) OR coalesce(contains(lower(uri_path), 'sign'), false)) AND NOT coalesce(contains(uri_query, 'k=1'), false) AND NOT coalesce(host = 'shop.example.org', false)"


@query("eval_condition", f"SELECT event_id FROM e WHERE {_TREE}")
def _(t):
    return t.events.filter(M.condition(TREE, t.events.columns)).select("event_id")


@query("eval_header_condition", "SELECT event_id FROM e WHERE coalesce(contains(h1, 'yes'), false) OR coalesce(contains(h2, 'yes'), false) OR coalesce(h1 = 'no', false)")
def _(t):
    tree = {"kind": "or", "conditions": [{"kind": "header_contains", "name": "X-DEBUG", "value": "yes"}, {"kind": "header_equals", "name": "x-debug", "value": "no"}]}
    return t.events.filter(M.condition(tree, t.events.columns)).select("event_id")


@query("absent_condition_fields", "SELECT event_id FROM e WHERE uri_path IS NULL OR uri_query IS NULL OR host IS NULL")
def _(t):
    return t.events.filter(M.absent_condition_fields(TREE)).select("event_id")


_OBS = "coalesce('id:' || request_id, concat_ws('|', coalesce(CAST(sec AS VARCHAR), '-'), coalesce(host, '-'), coalesce(method, '-'), coalesce(uri_path, '-'), coalesce(uri_query, '-')))"
CTES["groups"] = f"""groups AS (SELECT o.*, w.templates, w.clients, w.peers, w.spread, c.cves, CASE WHEN with_outcome > 0 THEN unblocked * 1.0 / with_outcome END AS unblocked_share FROM
    (SELECT source_ip, count(*) AS observations, CAST(sum(records) AS BIGINT) AS records, CAST(sum(distinctive) AS BIGINT) AS distinctive_observations, CAST(sum(specific) AS BIGINT) AS specific_observations, count(*) FILTER (b + p = 1 AND p = 1) AS unblocked, count(*) FILTER (b + p = 1) AS with_outcome FROM
      (SELECT source_ip, {_OBS} AS o, count(*) AS records, max(CAST(distinctiveness = 'distinctive' AS INT)) AS distinctive, max(CAST(specificity = 'request-specific' AS INT)) AS specific, max(CAST(outcome = 'blocked' AS INT)) AS b, max(CAST(outcome = 'not-blocked' AS INT)) AS p FROM fd WHERE source_ip IS NOT NULL GROUP BY 1, 2) GROUP BY 1) o
    JOIN (SELECT source_ip, count(DISTINCT template_id) AS templates, CAST(0 AS BIGINT) AS clients, CAST(1 AS BIGINT) AS peers, count(DISTINCT host) AS spread FROM fd WHERE source_ip IS NOT NULL GROUP BY 1) w USING (source_ip)
    JOIN (SELECT source_ip, count(DISTINCT cve) AS cves FROM fd JOIN det_cves USING (template_id, ordinal) WHERE source_ip IS NOT NULL GROUP BY 1) c USING (source_ip))"""
_GROUPS = "e det det_cves fd groups"


@query("entity_groups", "SELECT * FROM groups", _GROUPS)
def _(t):
    return FD.entity_groups(t.findings)


CTES["scored"] = """scored AS (SELECT *, CAST(CASE WHEN specific_observations = 0 THEN least(total, 74) ELSE total END AS BIGINT) AS score FROM (SELECT *, floor((least(templates * 3, 24) + least(cves * 2, 16) + least(distinctive_observations + least(floor((observations - distinctive_observations) / 10.0), 2), 16) + least(distinctive_observations, 4) + least(spread * 2, 20) + coalesce(floor(unblocked_share * 15 + 0.5), 0)) * 100.0 / 100 + 0.5) AS total FROM groups))"""


@query("behavior_score", "SELECT source_ip, score, CASE WHEN score >= 75 THEN 'high' WHEN score >= 50 THEN 'medium' WHEN score >= 25 THEN 'low' ELSE 'info' END AS tier FROM scored", _GROUPS + " scored")
def _(t):
    return FD.behavior_score(FD.entity_groups(t.findings)).select("source_ip", "score", "tier")


CTES["seen"] = f"seen AS (SELECT source_ip, CAST(floor(epoch_us(ts) / 1000.0) AS BIGINT) AS ms, {_OBS} AS o, template_id, coalesce(method, '<method unavailable>') || ' ' || coalesce(uri_path, '<path unavailable>') || coalesce('?' || uri_query, '') AS pattern, distinctiveness FROM fd WHERE source_ip IS NOT NULL)"


CTES["once"] = "once AS (SELECT source_ip, o, min(ms) AS ms, any_value(pattern) AS pattern, any_value(distinctiveness) = 'distinctive' AS distinctive FROM seen GROUP BY 1, 2)"


@query("windowed_burst", """SELECT *, CASE WHEN breadth AND depth THEN 'windowed breadth + depth' WHEN breadth THEN 'windowed breadth' WHEN depth THEN 'windowed depth' END AS basis FROM (SELECT source_ip, width, max(n) AS max_observations, max(t) AS max_templates, bool_or(n >= 3 AND t >= 2) AS breadth, bool_or(n >= 10) AS depth FROM
    (SELECT a.source_ip, width, a.ms, count(DISTINCT b.o) AS n, count(DISTINCT b.template_id) AS t FROM (SELECT DISTINCT source_ip, ms FROM seen WHERE ms IS NOT NULL) a, (VALUES (3600), (86400)) w(width), seen b WHERE a.source_ip = b.source_ip AND b.ms BETWEEN a.ms - width * 1000 AND a.ms GROUP BY 1, 2, 3) GROUP BY 1, 2)""", "e det fd seen")
def _(t):
    return FD.windowed_burst(t.findings, (3600, 86400))


CTES["sequences"] = """sequences AS (SELECT t.*, max_patterns, max_distinctive_patterns, min_gap, median_gap FROM (SELECT source_ip, count(*) AS observations, count(*) FILTER (ms IS NULL) AS undated FROM once GROUP BY 1) t
    LEFT JOIN (SELECT source_ip, max(p) AS max_patterns, max(d) AS max_distinctive_patterns FROM (SELECT a.source_ip, a.ms, count(DISTINCT b.pattern) AS p, count(DISTINCT b.pattern) FILTER (b.distinctive) AS d FROM (SELECT DISTINCT source_ip, ms FROM once WHERE ms IS NOT NULL) a JOIN once b ON a.source_ip = b.source_ip AND b.ms BETWEEN a.ms - 86400000 AND a.ms GROUP BY 1, 2) GROUP BY 1) m USING (source_ip)
    LEFT JOIN (SELECT source_ip, min(gap) AS min_gap, median(gap) AS median_gap FROM (SELECT source_ip, (ms - lag(ms) OVER (PARTITION BY source_ip ORDER BY ms)) / 1000.0 AS gap FROM once WHERE ms IS NOT NULL) WHERE gap IS NOT NULL GROUP BY 1) g USING (source_ip))"""


@query("sequence_summary", "SELECT * FROM sequences", "e det fd seen once sequences")
def _(t):
    return FD.sequence_summary(t.findings, 86400)


CTES["view"] = """view AS (SELECT s.*, CASE WHEN score >= 75 THEN 'high' WHEN score >= 50 THEN 'medium' WHEN score >= 25 THEN 'low' ELSE 'info' END AS tier, CASE WHEN s.observations >= 3 AND templates >= 2 AND s.observations >= 10 THEN 'breadth + depth' WHEN s.observations >= 3 AND templates >= 2 THEN 'breadth' WHEN s.observations >= 10 THEN 'depth' END AS basis,
    CASE source_ip WHEN '198.51.3.17' THEN 95 WHEN '198.51.1.8' THEN 40 END AS reputation, source_ip LIKE '%7' AS first_seen, undated, max_patterns, max_distinctive_patterns FROM scored s LEFT JOIN sequences USING (source_ip))"""


def _view(t):
    reputation = t.reputation.filter("scope = 'ip'").select(F.concat(F.lit("::ffff:"), "value").alias("source_ip"), F.col("score").alias("reputation"))
    new = t.events.filter("source_ip like '%7'").select(F.concat(F.lit("::FFFF:"), "source_ip").alias("ip"))
    return FD.triage_view(FD.entity_groups(t.findings), reputation, new, FD.sequence_summary(t.findings, 86400))


@query("triage_view", "SELECT source_ip, score, tier, basis, reputation, first_seen, max_patterns, max_distinctive_patterns FROM view ORDER BY score DESC, reputation DESC NULLS LAST, first_seen DESC, source_ip LIMIT 25", "e det det_cves fd groups scored seen once sequences view")
def _(t):
    return _view(t).select("source_ip", "score", "tier", "basis", "reputation", "first_seen", "max_patterns", "max_distinctive_patterns").limit(25)


@query("triage_summary", "SELECT count(*) AS entities, count(basis) AS to_investigate, count(*) FILTER (first_seen) AS first_seen, " + ", ".join(f"count(*) FILTER (tier = '{t}') AS tier_{t}" for t in ("info", "low", "medium", "high")) + ", CAST(coalesce(sum(undated), 0) AS BIGINT) AS undated, coalesce(max(max_patterns), 0) AS max_patterns, coalesce(max(max_distinctive_patterns), 0) AS max_distinctive_patterns FROM view", "e det det_cves fd groups scored seen once sequences view")
def _(t):
    return FD.triage_summary(_view(t))


@query("entity_groups_ja4", "SELECT ja4, count(DISTINCT " + _OBS + ") AS observations, count(DISTINCT template_id) AS templates, count(DISTINCT source_ip) AS spread FROM fd WHERE ja4 IS NOT NULL GROUP BY 1", "e det fd")
def _(t):
    return FD.entity_groups(t.findings, "ja4", spread="senders").select("ja4", "observations", "templates", "spread")


@query("entity_groups_asn", "SELECT 'observed-peer' AS identity, asn, count(DISTINCT " + _OBS + ") AS observations, count(DISTINCT template_id) AS templates, count(DISTINCT source_ip) AS spread FROM fd JOIN (SELECT ip, arg_max(asn, bits) AS asn FROM ipn JOIN nets ON num BETWEEN lo AND hi GROUP BY ip) ON ip = source_ip GROUP BY 2", "e ipn nets det fd")
def _(t):
    asn = X.asn_lookup(t.events.select(F.col("source_ip").alias("ip")), t.networks)
    return FD.entity_groups(FD.with_asn(t.findings, asn), ("identity", "asn"), spread="senders").select("identity", "asn", "observations", "templates", "spread")


@query("ordered_sequence", "SELECT source_ip, ms, pattern, row_number() OVER (PARTITION BY source_ip ORDER BY ms, pattern) AS place FROM (SELECT DISTINCT source_ip, CAST(floor(epoch_us(ts) / 1000.0) AS BIGINT) AS ms, concat_ws(' ', method, uri_path) AS pattern FROM fd WHERE source_ip IS NOT NULL AND ts IS NOT NULL)", _FD)
def _(t):
    return FD.ordered_sequence(t.findings)


CTES["lad"] = f"""lad AS (SELECT *, r3 AND coalesce(lower(method) = lower(d_method), false) AND {FRAGMENT} AS r4, r3 AND coalesce(lower(method) = lower(d_method), false) AND {FRAGMENT} AND coalesce(d_query, d_fragment, d_header) IS NOT NULL AS r5 FROM
    (SELECT *, r2 AND {HEADER} AS r3 FROM (SELECT e.*, det.*, cve, true AS r1, d_query IS NULL OR coalesce(contains(uri_query, d_query), false) AS r2 FROM e JOIN det ON uri_path = d_path JOIN det_cves USING (template_id, ordinal))))"""
CTES["rungs"] = "rungs AS (" + " UNION ALL ".join(f"SELECT DISTINCT event_id, request_id, cve, '{name}' AS rung FROM lad WHERE r{i + 1}" for i, name in enumerate(FD.RUNGS)) + ")"
CTES["again"] = "again AS (SELECT DISTINCT event_id, request_id, cve, CASE upper(waf_action) WHEN 'BLOCK' THEN 'blocked' WHEN 'ALLOW' THEN 'not-blocked' WHEN 'COUNT' THEN 'not-blocked' ELSE 'unknown' END AS outcome FROM lad WHERE r4)"


@query("ablation", "SELECT rung, count(DISTINCT event_id) AS events, count(*) AS event_cves, (SELECT count(*) FROM e) AS all_requests, count(DISTINCT event_id) * 1.0 / (SELECT count(*) FROM e) AS share FROM rungs GROUP BY 1", "e det det_cves lad rungs")
def _(t):
    return FD.ablation(t.events, t.detections)


#: Findings of an earlier run: those of even events.
def _known(t):
    return FD.by_cve(t.findings).filter("event_id % 2 = 0").select("event_id", "cve", "request_id")


CTES["known"] = "known AS (SELECT event_id, cve, request_id FROM fc WHERE event_id % 2 = 0)"


@query("known_rereplay", "SELECT kind, count(*) AS matches FROM (SELECT CASE WHEN k.request_id IS NOT NULL THEN 'known' WHEN m.request_id IS NULL THEN 'other-without-id' ELSE 'other' END AS kind FROM again m LEFT JOIN (SELECT DISTINCT cve, request_id FROM known WHERE request_id IS NOT NULL) k USING (cve, request_id)) GROUP BY 1", "e det det_cves fd fc known lad again")
def _(t):
    return M.known_rereplay(FD.replayed(t.events, t.detections), _known(t)).groupBy("kind").agg(F.count("*").alias("matches"))


_OTHER = "count(*) AS other_matches, " + ", ".join(f"count(*) FILTER (outcome = '{o}') AS other_{o.replace('-', '_')}" for o in ("blocked", "not-blocked", "unknown"))


_REPLAY = f"""SELECT cve, coalesce(known, 0) AS known, coalesce(reobserved, 0) AS reobserved, coalesce(other_matches, 0) AS other_matches, coalesce(other_blocked, 0) AS other_blocked, coalesce(other_not_blocked, 0) AS other_not_blocked, coalesce(other_unknown, 0) AS other_unknown, greatest(coalesce(known, 0) - coalesce(reobserved, 0), 0) AS missed, CASE WHEN known > 0 THEN coalesce(reobserved, 0) * 1.0 / known END AS coverage
    FROM (SELECT cve, count(*) AS known FROM known GROUP BY 1) a FULL JOIN (SELECT cve, count(*) AS reobserved FROM (SELECT DISTINCT cve, request_id FROM known WHERE request_id IS NOT NULL INTERSECT SELECT DISTINCT cve, request_id FROM again) GROUP BY 1) b USING (cve)
    FULL JOIN (SELECT cve, {_OTHER} FROM again m WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.cve = m.cve AND k.request_id = m.request_id) GROUP BY 1) c USING (cve)"""


@query("historical_replay", _REPLAY, "e det det_cves fd fc known lad again")
def _(t):
    return FD.historical_replay(FD.replayed(t.events, t.detections), _known(t))


@query("replay_total", f"""SELECT count(*) AS cves, sum(known) AS known, sum(reobserved) AS reobserved, sum(missed) AS missed, sum(other_matches) AS other_matches, sum(other_blocked) AS other_blocked, sum(other_not_blocked) AS other_not_blocked, sum(other_unknown) AS other_unknown, sum(reobserved) / nullif(sum(known), 0) AS coverage FROM ({_REPLAY})""", "e det det_cves fd fc known lad again")
def _(t):
    return FD.replay_total(FD.historical_replay(FD.replayed(t.events, t.detections), _known(t)))


@query("count_hypotheses", "SELECT r.cve, r.rung, r.matches, r.reobserved, coalesce(k.n, 0) AS known_findings, CASE WHEN k.n > 0 THEN r.reobserved * 1.0 / k.n END AS coverage FROM (SELECT cve, rung, count(*) AS matches, count(DISTINCT CASE WHEN k.request_id IS NOT NULL THEN r.request_id END) AS reobserved FROM rungs r LEFT JOIN (SELECT DISTINCT cve, request_id FROM known WHERE request_id IS NOT NULL) k USING (cve, request_id) GROUP BY 1, 2) r LEFT JOIN (SELECT cve, count(*) AS n FROM known GROUP BY 1) k USING (cve)", "e det det_cves fd fc known lad rungs")
def _(t):
    return FD.count_hypotheses(t.events, t.detections, _known(t))


_CAND = "SELECT cve, method, uri_path, uri_query, count(DISTINCT event_id) AS requests, row_number() OVER (PARTITION BY cve ORDER BY method, uri_path, uri_query NULLS FIRST) AS number FROM fd JOIN det_cves USING (template_id, ordinal) WHERE coalesce(upper(waf_action), '') <> 'BLOCK' AND specificity = 'request-specific' GROUP BY 1, 2, 3, 4"


@query("build_candidates", _CAND, "e det det_cves fd")
def _(t):
    return FD.build_candidates(t.findings)


@query("rule_candidates", """SELECT rule_id, count(*) AS requests, min(sec) AS first_seen, max(sec) AS last_seen, row_number() OVER (ORDER BY rule_id) AS number, rule_id <> 'apache' AS translatable FROM (SELECT sec, waf_action, 'waf-only' AS rule_id FROM e WHERE event_id % 3 = 0 AND uri_path = '/.env'
    UNION ALL SELECT sec, waf_action, 'apache' FROM e WHERE event_id % 3 = 1 AND (method = 'HEAD' OR coalesce(contains(host, 'shop'), false)) UNION ALL SELECT sec, waf_action, 'anywhere' FROM e WHERE uri_path = '/login') WHERE coalesce(upper(waf_action), '') <> 'BLOCK' GROUP BY rule_id""")
def _(t):
    rules = R.rules_table(t.spark, SOURCED)
    return FD.rule_candidates(R.match_rules(t.events.withColumn("log_source", _three_sources()), rules), rules)


@query("candidate_exclusions", "SELECT CASE WHEN upper(waf_action) = 'BLOCK' THEN 'blocked' WHEN specificity <> 'request-specific' THEN 'uri-only' ELSE 'kept' END AS reason, count(*) AS findings FROM fd GROUP BY 1", _FD)
def _(t):
    return FD.candidate_exclusions(t.findings)


@query("replay_candidate", f"SELECT *, known - known_matched AS known_missed, matched - known_matched AS other_matches, CASE WHEN known > 0 THEN known_matched * 1.0 / known END AS coverage FROM (SELECT count(*) AS evaluated, count(*) FILTER ({_TREE}) AS matched FROM e), (SELECT count(*) AS known FROM (SELECT DISTINCT request_id FROM fd WHERE request_id IS NOT NULL)), (SELECT count(*) AS known_matched FROM (SELECT DISTINCT request_id FROM fd WHERE request_id IS NOT NULL INTERSECT SELECT request_id FROM e WHERE {_TREE}))", _FD)
def _(t):
    return FD.replay_candidate(t.events, M.condition(TREE, t.events.columns), t.findings)


@query("evaluate_candidate", f"SELECT CASE event_id % 2 WHEN 0 THEN 'a' ELSE 'b' END AS cohort, count(*) AS requests, count(*) FILTER ({_TREE}) AS matches, count(*) FILTER ({_TREE}) * 1.0 / count(*) AS share, count(*) FILTER (uri_path IS NULL OR uri_query IS NULL OR host IS NULL) AS absent_fields, count(DISTINCT source_ip) FILTER ({_TREE}) AS peers, count(DISTINCT uri_path) FILTER ({_TREE}) AS paths FROM e GROUP BY 1")
def _(t):
    corpora = t.events.withColumn("cohort", F.when(F.col("event_id") % 2 == 0, "a").otherwise("b"))
    return FD.evaluate_candidate(corpora, M.condition(TREE, corpora.columns), M.absent_condition_fields(TREE))


@query("candidate_tops", f"SELECT cohort, uri_path, matches, place FROM (SELECT *, row_number() OVER (PARTITION BY cohort ORDER BY matches DESC, uri_path) AS place FROM (SELECT CASE event_id % 2 WHEN 0 THEN 'a' ELSE 'b' END AS cohort, uri_path, count(*) AS matches FROM e WHERE {_TREE} AND uri_path IS NOT NULL GROUP BY 1, 2)) WHERE place <= 5")
def _(t):
    corpora = t.events.withColumn("cohort", F.when(F.col("event_id") % 2 == 0, "a").otherwise("b"))
    return FD.candidate_tops(corpora, M.condition(TREE, corpora.columns), "uri_path", 5)


@query("probe_evidence", "SELECT event_id, source_ip, method, uri_path, status FROM fd WHERE template_id = 'tpl-env' AND status BETWEEN 200 AND 299", _FD)
def _(t):
    return FD.probe_evidence(t.findings, "tpl-env").drop("ts")


@query("cves_of_texts", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'CVE-2024-0007;CVE-2024-12345' WHEN 1 THEN 'CVE-2021-44228' ELSE '' END AS cves FROM e")
def _(t):
    k = F.col("event_id") % 3
    text = F.when(k == 0, "cve-2024-12345, CVE-2024-0007 and CVE-2024-0007").when(k == 1, "tag cve.2021.44228").otherwise("CVE-24-1 cve")
    return t.events.select("event_id", F.array_join(W.cves_in(text), ";").alias("cves"))


@query("private_texts", "SELECT event_id, event_id % 4 IN (0, 1) AS secret, CASE event_id % 4 WHEN 3 THEN concat('a', chr(65533), 'b') ELSE NULL END AS shown FROM e")
def _(t):
    k = F.col("event_id") % 4
    text = F.when(k == 0, "Authorization: x").when(k == 1, "bearer abc").when(k == 2, "plain").otherwise("a\x07b")
    return t.events.select("event_id", W.secret_like(text).alias("secret"), F.when(k == 3, W.printable(text)).alias("shown"))


@query("decoded_texts", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'a b+%zz' WHEN 1 THEN 'a%20b' WHEN 2 THEN '%' ELSE 'plain' END AS once FROM e")
def _(t):
    k = F.col("event_id") % 4
    text = F.when(k == 0, "a%20b+%zz").when(k == 1, "a%2520b").when(k == 2, "%25").otherwise("plain")
    # Bytes from escapes stand in a range of their own.
    back = F.translate(decoded(text), "".join(chr(0xE000 + i) for i in range(256)), "".join(map(chr, range(256))))
    return t.events.select("event_id", back.alias("once"))


@query("evaluate_labels", """SELECT *, tp * 1.0 / nullif(tp + fn, 0) AS recall, tp * 1.0 / nullif(tp + fp, 0) AS precision, fp * 1.0 / nullif(fp + tn, 0) AS false_positive_rate FROM (SELECT count(*) FILTER (w > 0 AND g > 0) AS tp, count(*) FILTER (w > 0 AND g = 0) AS fn, count(*) FILTER (w = 0 AND g > 0) AS fp, count(*) FILTER (w = 0 AND g = 0) AS tn, CAST(sum(w - b) AS BIGINT) AS missed, CAST(sum(g - b) AS BIGINT) AS unexpected FROM
    (SELECT event_id, count(want.rule_id) AS w, (SELECT count(DISTINCT rule_id) FROM rules r WHERE r.event_id = x.event_id) AS g, count(*) FILTER (want.rule_id IN (SELECT rule_id FROM rules r WHERE r.event_id = x.event_id)) AS b FROM e x LEFT JOIN (SELECT event_id, 'env-get' AS rule_id FROM e WHERE uri_path = '/.env' UNION ALL SELECT event_id, 'word' FROM e WHERE event_id % 12 = 1) want USING (event_id) GROUP BY event_id))""", "e rules")
def _(t):
    e = t.events
    truth = e.select("event_id", F.explode(F.array(F.when(F.col("uri_path") == "/.env", "env-get"), F.when(F.col("event_id") % 12 == 1, "word"))).alias("rule_id"))
    return FD.evaluate_labels(M.match_rules(e, RULES).select("event_id", "rule_id"), truth)


@query("quality_labels", "SELECT count(*) AS labels, count(*) FILTER (toxic = 1) AS toxic, count(*) FILTER (quality = 1) AS good FROM labels", "")
def _(t):
    return t.read("labels").agg(F.count("*").alias("labels"), F.count_if(F.col("toxic") == 1).alias("toxic"), F.count_if(F.col("quality") == 1).alias("good"))


@query("request_context", "SELECT event_id, source_ip, greatest(n - 50, 0) AS omitted FROM (SELECT *, count(*) OVER () AS n, row_number() OVER (ORDER BY event_id) AS k FROM e WHERE source_ip IN (SELECT source_ip FROM fd WHERE template_id = 'tpl-click') AND ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20') WHERE k <= 50", _FD)
def _(t):
    return FD.request_context(t.events, t.findings.filter("template_id = 'tpl-click' and source_ip is not null"), "2024-01-05", "2024-01-20", 50).select("event_id", "source_ip", "omitted")


@query("evidence_examples", "SELECT template_id, event_id, place, greatest(n - 3, 0) AS omitted FROM (SELECT template_id, event_id, row_number() OVER (PARTITION BY template_id ORDER BY event_id) AS place, count(*) OVER (PARTITION BY template_id) AS n FROM fd) WHERE place <= 3", _FD)
def _(t):
    return FD.evidence_examples(t.findings, "template_id", 3).select("template_id", "event_id", "place", "omitted")
