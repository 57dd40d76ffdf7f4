"""What the optimizer makes of operators whose cost lies in one expression."""

import pytest
from pyspark.sql import functions as F

from trailwork.sources import logs

GOOD = '192.0.2.1 - - [10/Oct/2023:13:55:36 +0200] "GET /a?b=1 HTTP/1.1" 200 12 "-" "x"'


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize(("parse", "patterns"), [(logs.parse_combined, 1), (logs.parse_vhost_combined, 1), (lambda x: logs.parse_vhost_combined(x, plain_first=True), 2), (logs.parse_nginx_postdata, 1)])
def test_a_line_is_matched_once(spark, tmp_path, parse, patterns):
    spark.createDataFrame([("f", 1, GOOD)], "input_file string, line_number long, line string").write.parquet(str(tmp_path / "lines"))
    events, errors = logs.split_errors(parse(spark.read.parquet(str(tmp_path / "lines"))))
    for plan in (optimized(events), optimized(errors), optimized(events.filter(F.col("status") == 200).select("uri_path"))):
        assert plan.count(r"\[([^\]]++)\]") == patterns
        assert plan.count("dd/MMM/yyyy") == 1


def test_spelling_and_identifiers_are_worked_out_once(spark, tmp_path):
    from trailwork.operators import behaviour as B

    spark.createDataFrame([(1, "/a/%2e%2e/7", "id=5", 200)], "event_id long, uri_path string, uri_query string, status int").write.parquet(str(tmp_path / "events"))
    events = spark.read.parquet(str(tmp_path / "events"))
    plan = optimized(B.request_features(events))
    assert plan.count("nul-byte") == 2  # of the path and of the query
    plan = optimized(B.identifiers(events))
    # The template in both parts of the union, the identifiers of the path (each of a bare segment and one with an extension), those of the query.
    assert plan.count("[0-9A-Fa-f]{8}") == 2 * 2 + 2 + 1


def test_only_requests_that_can_read_reach_python(spark, tmp_path):
    from trailwork.operators import behaviour as B

    row = ("192.0.2.1", "GET", "/a", "q=1", 200, 5)
    spark.createDataFrame([row], "source_ip string, method string, uri_path string, uri_query string, status int, response_bytes long").selectExpr("*", "1L as event_id", "'h' as host", "current_timestamp() as ts").write.parquet(str(tmp_path / "events"))
    plan = B.sql_reads(spark.read.parquet(str(tmp_path / "events")))._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("ArrowEvalPython") :]
    assert "Filter" in below and "%25" in below[below.index("Filter") :]  # the test of what can be decoded stands below the function


def test_a_cloudfront_line_is_looked_up_once(spark, tmp_path):
    rows = [("f", 1, "#Fields: date time c-ip cs-method"), ("f", 2, "2023-01-01\t00:00:01\t192.0.2.1\tGET")]
    spark.createDataFrame(rows, "input_file string, line_number long, line string").write.parquet(str(tmp_path / "lines"))
    events, errors = logs.split_errors(logs.parse_cloudfront(spark.read.parquet(str(tmp_path / "lines"))))
    for plan in (optimized(events), optimized(errors), optimized(events.filter(F.col("status") == 200).select("uri_path"))):
        assert plan.count("map_from_arrays") == 1
        assert plan.count("try_element_at") + plan.count("element_at(") <= 2 * 15  # each field once, however it is printed
    assert [(r.source_ip, r.method) for r in events.collect()] == [("192.0.2.1", "GET")]


def test_identifiers_of_entries_are_worked_out_once(spark, tmp_path):
    from trailwork.operators import behaviour as B

    row = (1, "192.0.2.1", "GET", "h", "/a/7", "id=5", 200, 5)
    spark.createDataFrame([row], "event_id long, source_ip string, method string, host string, uri_path string, uri_query string, status int, response_bytes long").selectExpr("*", "current_timestamp() as ts").write.parquet(str(tmp_path / "events"))
    access = B.identifier_access(spark.read.parquet(str(tmp_path / "events")))
    assert "[0-9A-Fa-f]{8}" not in optimized(access)  # they were written; what follows reads them
    assert sorted(r.position for r in access.collect()) == ["path:2", "query:id"]
