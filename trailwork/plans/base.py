"""Tables of a folder, the web_events derivation, and the registry of queries with their SQL.

The driver's tables are no web logs, so one deterministic derivation of requests from ``events`` is shared by all queries:
the same SELECT runs in Spark (over a view) and, as a CTE, in every oracle.
"""

from __future__ import annotations

import ipaddress
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_EVENTS = """
SELECT event_id,
  CASE WHEN event_id % 53 = 0 THEN NULL ELSE CAST(ts AS TIMESTAMP) END AS ts,
  CASE WHEN user_id % 41 = 0 THEN NULL ELSE concat('198.51.', CAST(user_id % 7 AS VARCHAR(9)), '.', CAST(user_id % 250 AS VARCHAR(9))) END AS source_ip,
  CASE event_id % 4 WHEN 0 THEN 'POST' WHEN 1 THEN 'HEAD' ELSE 'GET' END AS method,
  CASE event_id % 3 WHEN 0 THEN 'www.example.org' WHEN 1 THEN 'shop.example.org' ELSE NULL END AS host,
  CASE WHEN event_id % 59 = 0 THEN NULL WHEN event_id % 11 = 0 THEN '/.env' WHEN event_id % 13 = 0 THEN '/login' WHEN event_id % 47 = 0 THEN '/wp-admin/setup.php' ELSE concat('/', event_type, '/', CAST(event_id % 37 AS VARCHAR(9))) END AS uri_path,
  CASE WHEN event_id % 3 = 0 THEN NULL ELSE concat('k=', regexp_extract(props, '([0-9]+)', 1)) END AS uri_query,
  CAST(CASE WHEN event_id % 29 = 0 THEN NULL WHEN event_id % 23 = 0 THEN 499 WHEN event_id % 7 = 0 THEN 404 WHEN event_id % 19 = 0 THEN 503 WHEN event_id % 5 = 0 THEN 302 ELSE 200 END AS INT) AS status,
  CAST(floor(value * 100) AS BIGINT) AS response_bytes,
  CASE user_id % 5 WHEN 0 THEN 'Mozilla/5.0 Firefox/128.0' WHEN 1 THEN 'Mozilla/5.0 Chrome/126.0 Safari/537.36' WHEN 2 THEN 'ExampleBot/2.1' WHEN 3 THEN 'curl/8.5' ELSE NULL END AS user_agent,
  CASE WHEN user_id % 6 = 0 THEN NULL ELSE concat('t13d', CAST(user_id % 9 AS VARCHAR(9))) END AS ja4,
  CASE event_id % 10 WHEN 0 THEN 'BLOCK' WHEN 1 THEN 'ALLOW' WHEN 2 THEN 'COUNT' WHEN 3 THEN NULL WHEN 4 THEN 'captcha' ELSE 'ALLOW' END AS waf_action,
  CASE WHEN event_id % 17 = 0 THEN NULL ELSE concat('r', CAST(event_id AS VARCHAR(20))) END AS request_id,
  CASE event_id % 5 WHEN 0 THEN 'top' WHEN 1 THEN 'end' ELSE NULL END AS uri_fragment,
  CASE event_id % 7 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' ELSE NULL END AS h1,
  CASE event_id % 8 WHEN 0 THEN 'YES' WHEN 4 THEN 'yes, no' ELSE NULL END AS h2
FROM events
"""
#: The same text; only the name of an unbounded string differs between the engines.
EVENTS_SPARK = _EVENTS.replace("VARCHAR(9)", "STRING").replace("VARCHAR(20)", "STRING")

#: template_id, ordinal, severity, method, path, query, cves, fragment, value of the header X-Debug
DETECTIONS = [
    ("tpl-env", 1, "high", "GET", "/.env", None, ["CVE-2024-0001"], None, None),
    ("tpl-env-any", 2, "medium", "POST", "/.env", None, ["CVE-2024-0001", "CVE-2024-0002"], None, None),
    ("tpl-login", 3, "low", "get", "/login", "k=1", ["CVE-2024-0003"], None, None),
    ("tpl-login", 4, "low", "get", "/login", "k=", ["CVE-2024-0003"], None, None),
    ("tpl-click", 5, "critical", "HEAD", "/click/5", "k=", ["CVE-2024-0004"], None, None),
    ("tpl-view", 6, "info", "GET", "/view/3", None, ["CVE-2024-0005"], None, None),
    ("tpl-wp", 7, "unknown", "GET", "/wp-admin/setup.php", "k=4", ["CVE-2024-0006"], None, None),
    ("tpl-none", 8, "high", "PUT", "/nowhere", None, ["CVE-2024-0007"], None, None),
    ("tpl-fragment", 9, "low", "GET", "/.env", None, ["CVE-2024-0008"], "top", None),
    ("tpl-header", 10, "medium", "post", "/login", None, ["CVE-2024-0009"], None, "Yes"),
    ("tpl-header", 11, "medium", "GET", "/.env", "k=", ["CVE-2024-0009", "CVE-2024-0001"], "end", "YES"),
]
KEV = ["CVE-2024-0001", " cve-2024-0004 ", "CVE-1999-9999"]
#: indicator_id, type, value, valid_from, valid_until
INDICATORS = [
    (1, "ip", "198.51.3.17", None, None),
    (2, "cidr", "198.51.4.0/25", "2024-01-05 00:00:00", "2024-01-20 00:00:00"),
    (3, "path", "/.env", None, "2024-01-15 00:00:00"),
    (4, "path-prefix", "/pur", None, None),
    (5, "user-agent", "curl/8.5", None, None),
    (6, "ja4", "t13d4", "2024-01-10 00:00:00", None),
    (7, "host", "shop.example.org", None, None),
    (8, "cidr", "198.51.0.0/16", None, None),
    (9, "url", "https://WWW.example.org:443/.env", None, None),
    (10, "ip", "::ffff:198.51.1.8", None, None),
    (11, "cidr", "::ffff:198.51.5.0/121", None, None),
]
#: network, asn
NETWORKS = [("198.51.0.0/16", 64500), ("198.51.2.0/24", 64501), ("198.51.2.128/25", 64502), ("198.51.5.64/26", 64503)]
#: start_ip, end_ip, asn
RANGES = [("198.51.0.0", "198.51.0.99", 64510), ("198.51.1.10", "198.51.3.200", 64511), ("198.51.6.0", "198.51.6.255", 64512)]
#: scope, value, score
REPUTATION = [("ip", "198.51.3.17", 95), ("ip", "198.51.1.8", 40), ("cidr", "198.51.2.0/24", 60), ("cidr", "198.51.3.0/24", 80), ("asn", "64503", 20), ("asn", "64500", 30)]


def _text(value) -> str:
    return "NULL" if value is None else str(value) if isinstance(value, int) else "'" + str(value).replace("'", "''") + "'"


def values_sql(name: str, columns: str, rows: list[tuple]) -> str:
    return f"{name}({columns}) AS (VALUES {', '.join('(' + ', '.join(map(_text, r)) + ')' for r in rows)})"


#: Every request has at most two headers, both named X-Debug in different case: h1 and h2. Values are compared without case.
HEADER = "(d_header IS NULL OR coalesce(lower(h1) = lower(d_header), false) OR coalesce(lower(h2) = lower(d_header), false))"
FRAGMENT = "(d_fragment IS NULL OR coalesce(uri_fragment = d_fragment, false))"

#: CTEs that an oracle may use: e, det, det_cves, fd (findings), fc (findings by CVE), ind, ipn (addresses as numbers), nets.
CTES = {
    "e": f"e AS (SELECT *, CAST(floor(epoch_us(ts) / 1000000.0) AS BIGINT) AS sec FROM ({_EVENTS.strip()}))",
    "det": values_sql("det", "template_id, ordinal, severity, d_method, d_path, d_query, d_fragment, d_header", [(*r[:6], *r[7:]) for r in DETECTIONS]),
    "det_cves": values_sql("det_cves", "template_id, ordinal, cve", [(r[0], r[1], c) for r in DETECTIONS for c in r[6]]),
    "fd": f"""fd AS (SELECT * EXCLUDE (rn) FROM (SELECT e.*, det.template_id, det.ordinal, det.severity, CASE WHEN coalesce(d_query, d_fragment, d_header) IS NULL THEN 'response-unverified' ELSE 'request-specific' END AS specificity,
        CASE WHEN uri_path = '/login' THEN 'generic' ELSE 'distinctive' END AS distinctiveness, CASE upper(waf_action) WHEN 'BLOCK' THEN 'blocked' WHEN 'ALLOW' THEN 'not-blocked' WHEN 'COUNT' THEN 'not-blocked' ELSE 'unknown' END AS outcome,
        row_number() OVER (PARTITION BY event_id, det.template_id ORDER BY det.ordinal) AS rn
        FROM e JOIN det ON uri_path = d_path AND lower(method) = lower(d_method) AND (d_query IS NULL OR contains(uri_query, d_query)) AND {HEADER} AND {FRAGMENT}) WHERE rn = 1)""",
    "fc": """fc AS (SELECT event_id, cve, any_value(ts) AS ts, any_value(sec) AS sec, any_value(source_ip) AS source_ip, any_value(ja4) AS ja4, any_value(host) AS host, any_value(status) AS status, any_value(outcome) AS outcome, any_value(request_id) AS request_id,
        max(list_position(['unknown','info','low','medium','high','critical'], severity)) AS severity_rank, max(3 + ordinal % 3) AS detectability_rank, bool_or(specificity = 'request-specific') AS specific, any_value(distinctiveness) AS distinctiveness, any_value(event_id % 6 = 0) AS count_evidence FROM fd JOIN det_cves USING (template_id, ordinal) GROUP BY event_id, cve)""",
    "ind": values_sql("ind", "indicator_id, type, value, valid_from, valid_until", INDICATORS),
    "ipn": "ipn AS (SELECT DISTINCT source_ip AS ip, CAST(split_part(source_ip,'.',1) AS BIGINT)*16777216 + CAST(split_part(source_ip,'.',2) AS BIGINT)*65536 + CAST(split_part(source_ip,'.',3) AS BIGINT)*256 + CAST(split_part(source_ip,'.',4) AS BIGINT) AS num FROM e WHERE source_ip IS NOT NULL)",
}


def _ends(cidr: str) -> tuple[int, int]:
    net = ipaddress.ip_network(cidr)
    return int(net.network_address), int(net.broadcast_address)


CTES["nets"] = values_sql("nets", "network, asn, bits, lo, hi", [(n, a, int(n.split("/")[1]), *_ends(n)) for n, a in NETWORKS])


def with_headers(events: DataFrame) -> DataFrame:
    """h1 and h2 as the headers they stand for."""
    one = lambda name, c: F.when(F.col(c).isNotNull(), F.struct(F.lit(name).alias("name"), F.col(c).alias("value")))
    return events.withColumn("headers", F.array_compact(F.array(one("X-Debug", "h1"), one("x-debug", "h2")))).drop("h1", "h2")


class Tables:
    """The tables of a folder, and those that the queries derive from them or hold as literals."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def events(self) -> DataFrame:
        # The view has a name of its own for each folder, so that queries over several folders don't meet.
        view = f"events_{abs(hash(self.folder))}"
        self.read("events").createOrReplaceTempView(view)
        return with_headers(self.spark.sql(EVENTS_SPARK.replace("FROM events", f"FROM {view}")))

    @cached_property
    def detections(self) -> DataFrame:
        rows = self.spark.createDataFrame(DETECTIONS, "template_id string, ordinal int, severity string, method string, path string, query string, cves array<string>, fragment string, header string")
        header = F.struct(F.lit("X-DEBUG").alias("name"), F.col("header").alias("value"))
        level = F.get(F.array(*map(F.lit, ("low", "medium", "high"))), F.col("ordinal") % 3)
        return rows.withColumns({"headers": F.when(F.col("header").isNotNull(), F.array(header)), "detectability": level}).drop("header")

    @cached_property
    def findings(self) -> DataFrame:
        from trailwork.operators.matching import match_detections

        found = match_detections(self.events, self.detections)
        return found.withColumn("waf_non_terminating_rule_ids", F.when(F.col("event_id") % 6 == 0, F.array(F.lit("count-rule"))).otherwise(F.array().cast("array<string>")))

    @cached_property
    def indicators(self) -> DataFrame:
        return self.spark.createDataFrame(INDICATORS, "indicator_id long, type string, value string, valid_from string, valid_until string").selectExpr("indicator_id", "type", "value", "cast(valid_from as timestamp) valid_from", "cast(valid_until as timestamp) valid_until")

    @cached_property
    def networks(self) -> DataFrame:
        return self.spark.createDataFrame(NETWORKS, "network string, asn long")

    @cached_property
    def ranges(self) -> DataFrame:
        return self.spark.createDataFrame(RANGES, "start_ip string, end_ip string, asn long")

    @cached_property
    def reputation(self) -> DataFrame:
        return self.spark.createDataFrame(REPUTATION, "scope string, value string, score long")

    @cached_property
    def kev(self) -> DataFrame:
        return self.spark.createDataFrame([(c,) for c in KEV], "cve_id string")

    @cached_property
    def catalog(self) -> DataFrame:
        from trailwork.operators.behaviour import DEFAULT_CATALOG

        return self.spark.createDataFrame(DEFAULT_CATALOG, "category string, mode string, pattern string")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, ctes: str = "e"):
    """Register make(tables) under a name, with DuckDB SQL over the named CTEs."""

    def register(make: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, folder: make(Tables(spark, folder))
        if sql:
            parts = [CTES.get(c, c) for c in ctes.split(" ") if c] if " AS (" not in ctes else [ctes]
            ORACLES[name] = (f"WITH {', '.join(parts)} " if parts else "") + sql
        return make

    return register
