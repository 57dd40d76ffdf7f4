"""Whom requests are grouped by: validated clients, observed peers and host names, each request once."""

from pyspark.sql import functions as F

from trailwork.operators import behaviour as B
from trailwork.operators import compare as X
from trailwork.operators import concentration as C
from trailwork.operators import findings as FD

ROWS = [
    (1, "192.0.2.1", None, "/a", 404, "2024-01-01 00:00:00"), (2, "::ffff:192.0.2.1", None, "/b", 200, "2024-01-01 00:00:10"), (3, "192.0.2.1", "2001:DB8::1", "/b", 200, "2024-01-01 00:00:20"),
    (4, "192.0.2.9", "2001:db8::1", "/a", 404, "2024-01-01 00:00:05"), (5, "Host.Example.", "192.0.2.7", "/a", 404, None), (6, "192.0.2.1", "not an address", "/a", 200, None), (7, None, "192.0.2.7", "/a", 200, None), (8, "-", None, "/a", 200, None),
]
SCHEMA = "event_id long, source_ip string, client_ip string, uri_path string, status int, ts string"


def requests(spark):
    rest = {"method": F.lit("GET"), "host": F.lit("h"), "uri_query": F.lit(None).cast("string"), "user_agent": F.lit("x"), "response_bytes": F.lit(1).cast("long"), "ts": F.col("ts").cast("timestamp")}
    return spark.createDataFrame(ROWS, SCHEMA).withColumns(rest)


def test_each_request_has_one_source(spark):
    got = {r.event_id: (r.identity, r.source) for r in B.with_source(requests(spark)).collect()}
    observed, client = ("observed-peer", "192.0.2.1"), ("validated-client", "2001:db8::1")
    assert got == {1: observed, 2: observed, 3: client, 4: client, 5: ("hostname-peer", "host.example"), 6: (None, None), 7: (None, None), 8: (None, None)}


def test_probes_and_rare_successes_by_identity(spark):
    events = B.with_source(requests(spark))
    catalog = spark.createDataFrame([("c", "exact", "/a")], "category string, mode string, pattern string")
    probes = B.probe_sources(events, catalog, min_paths=1, min_error_share=0.1, min_catalog=1, key=B.SOURCE)
    assert {(r.identity, r.requests, r.distinct_paths, r.catalog_requests) for r in probes.collect()} == {("observed-peer", 2, 2, 1), ("validated-client", 2, 2, 1), ("hostname-peer", 1, 1, 1)}
    assert {(r.identity, r.category, r.requests, r.paths) for r in B.probe_categories(events, catalog, B.SOURCE).collect()} == {(k, "c", 1, 1) for k in ("observed-peer", "validated-client", "hostname-peer")}
    rare = B.rare_success(events.filter("identity is not null"), probes, key=B.SOURCE)
    row = rare.first()
    # Both sources got theirs after their first 404; the methods and times are those of all requests.
    assert rare.count() == 1 and (row.path, row.successful_sources, row.preceded, row.methods, row.last_seen - row.first_seen) == ("/b", 2, True, "GET", 10)
    assert {(r.identity, r.successes) for r in B.rare_success_sources(events, rare, B.SOURCE).collect()} == {("observed-peer", 1), ("validated-client", 1)}


def test_ranks_put_the_newest_first(spark):
    rows = [("/old", False, 1, 1, 5), ("/new", False, 1, 1, 9), ("/undated", False, 1, 1, None), ("/pre", True, 2, 2, 1), ("/a", False, 1, 1, 9)]
    ranked = B.rank_rare_success(spark.createDataFrame(rows, "path string, preceded boolean, successful_sources long, requesting_sources long, first_seen long"))
    assert [r.path for r in ranked.collect()] == ["/pre", "/a", "/new", "/old", "/undated"]


def findings(spark):
    return requests(spark).withColumns({"template_id": F.lit("t"), "cves": F.array(F.lit("CVE-2024-1")), "request_id": F.col("event_id").cast("string"), "distinctiveness": F.lit("distinctive"), "specificity": F.lit("request-specific"), "outcome": F.lit("unknown"), "ja4": F.lit("j")})


def test_groups_by_network_and_fingerprint(spark):
    asn = spark.createDataFrame([("192.0.2.1", 64500), ("2001:DB8:0::1", 64501)], "ip string, asn long")
    named = FD.with_asn(findings(spark), asn)
    by_asn = {(r.identity, r.asn): (r.observations, r.spread) for r in FD.entity_groups(named, ("identity", "asn"), spread="senders").collect()}
    assert by_asn == {("observed-peer", 64500): (2, 1), ("validated-client", 64501): (2, 1)}
    one = FD.entity_groups(findings(spark), "ja4", spread="senders").first()
    assert (one.observations, one.clients, one.peers, one.spread) == (8, 3, 2, 3)  # the larger of both, not their sum


def test_focus_groups_and_stored_networks(spark):
    asn = spark.createDataFrame([("192.0.2.1", 64500)], "ip string, asn long")
    got = {(r.kind, r.name): (r.requests, r.peers, r.share) for r in C.focus_groups(requests(spark), asn, path="/a").collect()}
    assert got == {("block", "192.0.2.0/24"): (3, 2, 0.5), ("asn", "64500"): (2, 1, 2 / 6), ("unresolved", "unresolved"): (4, 3, 4 / 6)}
    runs = requests(spark).withColumn("run_id", F.lit("r"))
    assert {r.entity for r in X.observations(runs, asn=asn).collect()} == {"192.0.2.0/24", "AS64500"}


def test_triage_order_and_histogram(spark):
    groups = FD.entity_groups(findings(spark).filter("source_ip like '192%'"))
    seen = spark.createDataFrame([("::ffff:192.0.2.9",)], "ip string")
    view = FD.triage_view(groups, None, seen, FD.sequence_summary(findings(spark)))
    rows = view.collect()
    assert [(r.source_ip, r.first_seen, r.basis) for r in rows] == [("192.0.2.1", False, None), ("192.0.2.9", True, None)] or rows[0].score == rows[1].score
    total = FD.triage_summary(view).first()
    assert (total.entities, total.first_seen, total.to_investigate) == (2, 1, 0) and total.tier_info + total.tier_low + total.tier_medium + total.tier_high == 2
    assert FD.triage_summary(FD.triage_view(groups.limit(0))).first().max_patterns == 0
