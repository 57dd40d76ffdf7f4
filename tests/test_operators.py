import pytest
from pyspark.sql import functions as F

from trailwork.operators import behaviour as B
from trailwork.operators import compare as X
from trailwork.operators import concentration as C
from trailwork.operators import findings as FD
from trailwork.operators import matching as M
from trailwork.plans import Tables
from trailwork.streaming import streams

SCHEMA = "event_id long, ts string, source_ip string, method string, host string, uri_path string, uri_query string, status int, response_bytes long, user_agent string, ja4 string, waf_action string, request_id string"


def events(spark, *rows):
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    full = [tuple((dict(event_id=i + 1, method="GET") | r).get(n) for n in names) for i, r in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA).withColumn("ts", F.col("ts").cast("timestamp"))


def test_time_filter_is_inclusive_and_drops_undated(spark):
    e = events(spark, {"ts": "2024-01-01 00:00:00"}, {"ts": "2024-01-02 00:00:00"}, {"ts": "2024-01-03 00:00:00"}, {})
    assert [r.event_id for r in C.time_filter(e, "2024-01-01", "2024-01-02").collect()] == [1, 2]
    assert C.time_filter(e).count() == 4


def test_detection_rules_of_case(spark):
    d = spark.createDataFrame([("t", 1, "high", "get", "/A", "x=1", ["C"])], "template_id string, ordinal int, severity string, method string, path string, query string, cves array<string>")
    e = events(spark, {"uri_path": "/A", "uri_query": "x=12"}, {"uri_path": "/a", "uri_query": "x=1"}, {"uri_path": "/A"}, {"uri_path": "/A", "uri_query": "x=1", "method": None})
    assert [r.event_id for r in M.match_detections(e, d).collect()] == [1]


def test_ladder_is_monotonic(spark):
    t = Tables(spark, "/root/testdata/sf0.001")
    n = {r.rung: r.events for r in FD.ablation(t.events, t.detections).collect()}
    counts = [n[r] for r in FD.RUNGS]
    assert counts == sorted(counts, reverse=True) and counts[0] > counts[1] > counts[2] > counts[3] > counts[4] > 0


def test_ordered_sequence_is_whole(spark):
    at = F.timestamp_millis(F.lit(-7_200_000) + F.col("id") * 3_777)
    f = spark.range(2_500).select(F.lit("192.0.2.1").alias("source_ip"), at.alias("ts"), F.lit("GET").alias("method"), F.explode(F.array(F.lit("/b"), F.lit("/a"))).alias("uri_path"))
    got = sorted((r.place, r.ms, r.pattern) for r in FD.ordered_sequence(f).collect())
    assert got == [(i + 1, *x) for i, x in enumerate(sorted((-7_200_000 + i * 3_777, p) for i in range(2_500) for p in ("GET /a", "GET /b")))]
    assert FD.ordered_sequence(f, most=3).count() == 3


def test_condition_null_and_not(spark):
    e = events(spark, {"host": "a"}, {"host": None})
    has = {"kind": "host_equals", "value": "a"}
    assert [r.event_id for r in e.filter(M.condition({"kind": "not", "condition": has}, e.columns)).collect()] == [2]
    assert e.filter(M.condition({"kind": "and", "conditions": []}, e.columns)).count() == 0


def test_validity_end_is_exclusive(spark):
    rows = spark.createDataFrame([("2024-01-01", "2024-01-01", "2024-01-02"), ("2024-01-02", "2024-01-01", "2024-01-02"), (None, "2024-01-01", None), (None, None, None)], "t string, a string, b string")
    cols = [F.col(c).cast("timestamp") for c in "tab"]
    assert [r[0] for r in rows.select(M.indicator_validity(*cols)).collect()] == ["valid", "outside", "unavailable", "valid"]


def test_client_ip_needs_trusted_peer_and_parsed_hops(spark):
    rows = [("10.0.0.1", "203.0.113.9, 198.51.100.7, 10.0.0.2"), ("192.0.2.1", "203.0.113.9"), ("10.0.0.1", "bad, 203.0.113.9"), ("10.0.0.1", "10.0.0.3")]
    df = spark.createDataFrame(rows, "source_ip string, x string").withColumn("headers", F.array(F.struct(F.lit("X-Forwarded-For").alias("name"), F.col("x").alias("value"))))
    assert [r.client_ip for r in M.resolve_client_ip(df, ["10.0.0.0/8"]).collect()] == ["198.51.100.7", None, None, None]


def test_observation_with_both_outcomes_leaves_the_share(spark):
    base = {"uri_path": "/A", "source_ip": "192.0.2.1", "request_id": "r"}
    d = spark.createDataFrame([("t", 1, "high", "GET", "/A", None, ["C"])], "template_id string, ordinal int, severity string, method string, path string, query string, cves array<string>")
    f = M.match_detections(events(spark, base | {"waf_action": "BLOCK"}, base | {"waf_action": "ALLOW"}, base | {"waf_action": "ALLOW", "request_id": "s"}), d)
    r = FD.entity_groups(f).first()
    assert (r.observations, r.records, r.with_outcome, r.unblocked_share) == (2, 3, 1, 1.0)


def test_score_cap_without_request_evidence(spark):
    rows = [("a", 99, 99, 99, 99, 99, 1.0, 0), ("b", 99, 99, 99, 99, 99, 1.0, 1), ("c", 0, 0, 0, 0, 0, None, 0)]
    g = spark.createDataFrame(rows, "source_ip string, templates long, cves long, observations long, distinctive_observations long, spread long, unblocked_share double, specific_observations long")
    got = {r.source_ip: (r.score, r.tier) for r in FD.behavior_score(g, burst=F.lit(True)).collect()}
    assert got == {"a": (74, "medium"), "b": (100, "high"), "c": (5, "info")}


def test_success_must_be_strictly_later(spark):
    shaped = spark.createDataFrame([("192.0.2.1", True)], "source_ip string, probe_shaped boolean")
    rows = [{"ts": "2024-01-01 00:00:00", "source_ip": "192.0.2.1", "uri_path": "/x", "status": 404}, {"ts": "2024-01-01 00:00:00", "source_ip": "192.0.2.1", "uri_path": "/y", "status": 200}, {"ts": "2024-01-01 00:00:01", "source_ip": "192.0.2.1", "uri_path": "/z", "status": 200}]
    got = {r.path: r.preceded for r in B.rare_success(events(spark, *rows), shaped).collect()}
    assert got == {"/y": False, "/z": True}


def test_three_valued_criterion(spark):
    rows = spark.createDataFrame([(5.0, True), (5.0, False), (1.0, True), (1.0, False), (None, False)], "v double, i boolean")
    assert [r[0] for r in rows.select(B.met(F.col("v"), 3, F.col("i"))).collect()] == [True, True, None, False, None]


def test_catalog_skips_conventions(spark):
    e = events(spark, {"uri_path": "/robots.txt"}, {"uri_path": "/wp-admin"}, {"uri_path": "/wp-adminx"}, {"uri_path": "/a/cmd.php"}, {"uri_path": "/.well-known/cmd.php"})
    catalog = spark.createDataFrame([("w", "root-tree", "/wp-admin"), ("s", "basename", "cmd.php"), ("r", "exact", "/robots.txt")], "category string, mode string, pattern string")
    assert {(r.uri_path, r.category) for r in B.catalog_paths(e, catalog).collect()} == {("/wp-admin", "w"), ("/a/cmd.php", "s")}


def test_size_pairs(spark):
    base = {"host": "h", "source_ip": "192.0.2.1", "uri_path": "/q", "status": 200}
    asked = lambda x: f"q=hex(cast(({x})as char))"
    given = [("select 0x4f4b", 50, 9999), ("select 0x4f4b", 0, 2000), ("select value from site_settings", 1, 2000 + 18 + 38), ("select missing from items", 2, 2000 + 12 - 8), ("select blank from items", 3, 2000 + 10 - 4), ("select variable from items", 4, 2000 + 13 + 11)]
    rows = [base | {"ts": f"2024-01-01 00:00:{at:02d}", "uri_query": asked(x), "response_bytes": size} for x, at, size in given]
    rows += [base | change | {"ts": "2024-01-01 00:00:10", "uri_query": asked("select x from items"), "response_bytes": 2200} for change in ({"source_ip": "203.0.113.9"}, {"status": 403}, {"host": None}, {"uri_path": "/r"})]
    pairs = B.response_size_pairs(events(spark, *rows))
    got = {r.expression: (r.outcome, r.length) for r in pairs.collect()}
    assert got == {
        "select 0x4f4b": ("not_fitting", None), "select value from site_settings": ("length", 21), "select missing from items": ("negative_estimate", -2),
        "select blank from items": ("empty_or_null", 0), "select variable from items": ("not_fitting", None),
    }
    fit = B.host_fit(pairs).collect()
    assert [(r.host, r.fitting, r.not_fitting, r.fit_rate) for r in fit] == [("h", 3, 2, 0.6)]
    one = B.paired_expressions(pairs).filter("expression = 'select value from site_settings'").first()
    assert (one.requests, one.sources, one.lengths, one.longest) == (1, 1, 1, 21)


def test_size_pairs_of_clients_apart_from_peers(spark):
    row = {"host": "h", "source_ip": "192.0.2.1", "uri_path": "/q", "status": 200, "uri_query": "q=cast((select 1)as char)", "response_bytes": 10}
    e = events(spark, row | {"ts": "2024-01-01 00:00:00"}, row | {"ts": "2024-01-01 00:00:01"}, row | {"ts": "2024-01-01 00:00:02"}).withColumn("client_ip", F.when(F.second("ts") > 0, "192.0.2.1"))
    assert [(r.identity, r.source, r.length) for r in B.response_size_pairs(e).collect()] == [("validated-client", "192.0.2.1", 1)]


def test_range_lookup_ends_and_overlaps(spark):
    ranges = spark.createDataFrame([("10.0.0.0", "11.0.0.5", 1), ("11.0.0.9", "11.0.0.9", 2)], "start_ip string, end_ip string, asn long")
    ips = spark.createDataFrame([("10.255.0.1",), ("11.0.0.5",), ("11.0.0.6",), ("11.0.0.9",), ("9.9.9.9",)], "ip string")
    assert {(r.ip, r.asn) for r in X.range_lookup(ips, ranges).collect()} == {("10.255.0.1", 1), ("11.0.0.5", 1), ("11.0.0.9", 2)}
    assert X.range_overlaps(ranges).count() == 0


def test_first_seen_uses_canonical_addresses(spark):
    now, old = events(spark, {"source_ip": "::ffff:192.0.2.1"}, {"source_ip": "192.0.2.2"}), events(spark, {"source_ip": "192.0.2.1"})
    assert [r.source_ip for r in X.first_seen(now, old, "source_ip").collect()] == ["192.0.2.2"]


def test_store_update_is_idempotent(spark):
    run = spark.createDataFrame([("r1", "e", 1, 2)], "run_id string, entity string, first_minute long, last_minute long")
    assert X.update_observation_store(run, run).count() == 0


@pytest.mark.parametrize("n", [1, 8])
def test_partitions_do_not_matter(spark, n):
    e = Tables(spark, "/root/testdata/sf0.001").events.orderBy(F.rand(n)).repartition(n)
    assert C.most_requested_path(e).orderBy("source_ip").limit(3).collect() == C.most_requested_path(e.coalesce(1)).orderBy("source_ip").limit(3).collect()


def test_empty_tables(spark):
    e = events(spark).limit(0)
    assert C.path_concentration(e).count() == 0
    assert C.response_outcomes(e).first().share_2xx == 0.0
    assert C.stack(e).count() == 0


def test_streamed_store(spark, tmp_path):
    Tables(spark, "/root/testdata/sf0.001").events.repartition(2).write.parquet(str(tmp_path / "in"))
    source = streams.stream_table(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema)
    for _ in range(2):
        streams.stream_observation_store(source, str(tmp_path / "store")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    assert X.read_observation_store(spark.read.parquet(str(tmp_path / "store"))).count() == 7


def test_streamed_lines(spark, tmp_path):
    from trailwork.sources.logs import parse_combined

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.log").write_text('192.0.2.1 - - [10/Oct/2023:13:55:36 +0200] "GET /a HTTP/1.1" 200 12 "-" "x"\n')
    assert streams.run_available(streams.stream_events(spark, str(tmp_path / "in"), parse_combined)).first().uri_path == "/a"


def test_header_values_are_compared_without_case_and_by_any_header(spark):
    headers = "array<struct<name:string,value:string>>"
    events = spark.createDataFrame([(1, "GET", "/a", None, [("x", "no"), ("X", "YES")]), (2, "GET", "/a", None, [("x", "yes, no")]), (3, "GET", "/a", None, []), (4, "GET", "/a", None, None)], f"event_id long, method string, uri_path string, uri_query string, headers {headers}").withColumn("waf_action", F.lit("ALLOW"))
    detections = spark.createDataFrame([("t", 1, ["CVE-2024-1"], "get", "/a", None, [("X", "yes")]), ("none", 2, ["CVE-2024-2"], "get", "/a", None, None)], f"template_id string, ordinal int, cves array<string>, method string, path string, query string, headers {headers}")
    got = {(r.event_id, r.template_id, r.specificity) for r in M.match_detections(events, detections).collect()}
    assert got == {(1, "t", "request-specific"), *((i, "none", "response-unverified") for i in (1, 2, 3, 4))}
    holds = M.condition({"kind": "header_contains", "name": "X", "value": "YES"}, events.columns)
    assert [r.event_id for r in events.filter(holds).collect()] == [1]


def test_indicators_of_addresses_and_urls(spark):
    events = spark.createDataFrame([(1, "::ffff:192.0.2.1", "www.example.org", "/a"), (2, "2001:db8::5", "WWW.Example.org.:8443", "/a"), (3, "192.0.2.77", "www.example.org:443", "/"), (4, None, None, None), (5, "host.example", "[2001:db8::1]:80", "/b")], "event_id long, source_ip string, host string, uri_path string")
    rows = [(1, "ip", "192.0.2.1"), (2, "cidr", "2001:db8::/32"), (3, "url", "https://www.example.org/a"), (4, "url", "http://www.example.org:8443/a"), (5, "url", "https://www.example.org"), (6, "host", "www.example.org"), (7, "cidr", "192.0.2.0/24"), (8, "url", "ftp://www.example.org/a"), (9, "url", "http://[2001:DB8::1]/b")]
    found = M.match_indicators(events, spark.createDataFrame(rows, "indicator_id long, type string, value string")).collect()
    assert {(r.event_id, r.indicator_id, *r.fields) for r in found} == {(1, 1, "source_ip"), (1, 7, "source_ip"), (3, 7, "source_ip"), (2, 2, "source_ip"), (1, 3, "url"), (2, 4, "url"), (3, 5, "url"), (1, 6, "host"), (2, 6, "host"), (3, 6, "host"), (5, 9, "url")}


def test_client_behind_proxies_of_both_families(spark):
    header = lambda v: [("X-Forwarded-For", v)]
    rows = [(1, "10.0.0.9", header("192.0.2.1, 2001:DB8::1, 10.0.0.7")), (2, "2001:db8:ffff::1", header("192.0.2.5")), (3, "192.0.2.9", header("192.0.2.5")), (4, "10.0.0.9", header("unknown, 192.0.2.5")), (5, "10.0.0.9", header("10.0.0.1"))]
    events = spark.createDataFrame(rows, "event_id long, source_ip string, headers array<struct<name:string,value:string>>")
    got = {r.event_id: r.client_ip for r in M.resolve_client_ip(events, ["10.0.0.0/8", "2001:db8:ffff::/48"]).collect()}
    assert got == {1: "2001:db8::1", 2: "192.0.2.5", 3: None, 4: None, 5: None}


def test_dispositions_stay_in_their_corpus(spark):
    schema = "source_ip string, template_id string, method string, uri_path string, uri_query string, corpus_scope string"
    findings = spark.createDataFrame([("a", "t", "GET", "/", None, "one"), ("a", "t", "GET", "/", None, "two")], schema)
    store = spark.createDataFrame([("a", "t", "get", "/", None, "one", "expected", 1, None)], schema + ", disposition string, recorded_at long, review_after timestamp")
    assert {r.corpus_scope: r.disposition for r in X.apply_dispositions(findings, store).collect()} == {"one": "expected", "two": None}


def test_consecutive_ids_reads_64_bits_without_a_sign(spark):
    ids = ["18446744073709551614", "18446744073709551615", "18446744073709551616", "18446744073709551617"]
    rows = [(i, "192.0.2.1", "GET", "h", None, f"/a/{v}", None, 200, 5) for i, v in enumerate(ids)]
    e = spark.createDataFrame(rows, "event_id long, source_ip string, method string, host string, ts timestamp, uri_path string, uri_query string, status int, response_bytes long")
    got = B.consecutive_ids(e).collect()
    assert [(r.pairs, r.numeric_pairs, r.adjacent_pairs) for r in got] == [(3, 1, 1)]
    entry = B.identifier_access(e).collect()[0]
    # Everybody got the one size, so nothing is content and all are rejected; a corpus without times has no timestamp share.
    assert (entry.ids, entry.dominant_bytes, entry.content_ids, entry.rejected_ids, entry.timestamp_share) == (4, 5, 0, 4, None) and entry.beyond_64_bits == 2


def test_late_rows_are_counted_apart(spark, tmp_path):
    hour = lambda h: f"2024-01-01 {h:02d}:30:00"
    for i, hours in enumerate([[1, 2], [5, None], [1, 4, 5], [9]]):
        spark.createDataFrame([(None if h is None else hour(h),) for h in hours], "ts string").select(F.col("ts").cast("timestamp").alias("ts")).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/p={i}"))
    for _ in range(2):  # the second run finds nothing new
        for i in range(4):
            source = spark.readStream.schema("ts timestamp").parquet(str(tmp_path / f"in/p={i}"))
            streams.stream_rates_with_late(source, str(tmp_path / f"alone{i}")).option("checkpointLocation", str(tmp_path / f"state{i}")).trigger(availableNow=True).start().awaitTermination()
    assert sum(r.requests + r.late for i in range(4) for r in streams.read_stream_rates(spark, str(tmp_path / f"alone{i}")).collect()) == 8
    # Batches one after the other: after one with 5:30 and two hours of patience the window of 1:00 is over.
    (tmp_path / "one").mkdir()
    for i in range(4):
        for f in (tmp_path / f"in/p={i}").glob("*.parquet"):
            f.rename(tmp_path / "one" / f"{i}.parquet")
        source = spark.readStream.schema("ts timestamp").parquet(str(tmp_path / "one"))
        streams.stream_rates_with_late(source, str(tmp_path / "store")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    got = {r.start and r.start % 86400 // 3600: (r.requests, r.late) for r in streams.read_stream_rates(spark, str(tmp_path / "store")).collect()}
    assert got == {1: (1, 1), 2: (1, 0), 4: (1, 0), 5: (2, 0), 9: (1, 0), None: (1, 0)}


def test_streamed_lines_have_their_numbers(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, n in (("a.log", 3), ("b.log", 40)):
        (tmp_path / "in" / name).write_text("\n".join(f"{name} {i}" if i % 5 else "" for i in range(1, n + 1)) + "\n")
        streams.stream_numbered_events(spark, str(tmp_path / "in"), str(tmp_path / "out"), lambda x: x).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema("input_file string, line_number long, line string, batch long").parquet(str(tmp_path / "out")).collect()
    assert sorted((r.line, r.line_number) for r in rows) == sorted((f"{name} {i}", i) for name, n in (("a.log", 3), ("b.log", 40)) for i in range(1, n + 1) if i % 5)
