import gzip
import json

import pytest
from pyspark.sql import functions as F

from trailwork.sources import intel, logs, sinks


def lines(spark, *texts):
    return spark.createDataFrame([("f", i + 1, x) for i, x in enumerate(texts)], "input_file string, line_number long, line string")


GOOD = '192.0.2.1 - - [10/Oct/2023:13:55:36 +0200] "GET /a?b=1#c HTTP/1.1" 200 12 "-" "x \\"y\\""'


def test_combined(spark):
    bad = ["nonsense", GOOD.replace("GET /a", "GET"), GOOD.replace("/a?", "a?"), GOOD.replace("/a?", "/%zz?"), GOOD.replace("Oct", "Foo"), GOOD + "x" * logs.LONGEST_LINE, GOOD + " more"]
    rows = logs.parse_combined(lines(spark, GOOD, *bad))
    good, errors = logs.split_errors(rows)
    r = good.first()
    assert (r.source_ip, r.method, r.uri_path, r.uri_query, r.uri_fragment, r.status, r.response_bytes, r.referer, r.user_agent) == ("192.0.2.1", "GET", "/a", "b=1", "c", 200, 12, None, 'x "y"')
    assert good.select(F.unix_timestamp("ts")).first()[0] == 1696938936
    assert [r.reason for r in errors.orderBy("line_number").collect()] == ["not-combined", "request-line", "target", "percent-escape", "timestamp", "line-too-long", "not-combined"]


@pytest.mark.parametrize("size", [3_000, 8_000, 60_000, 70_000])
def test_long_lines_are_events_or_errors(spark, size):
    path = "/" + "a" * (size - 300)
    escaped = '/\\"' * ((size - 300) // 3)
    combined = GOOD.replace("/a?b=1#c", path)
    agent = GOOD.replace('x \\"y\\"', escaped)
    post = ' "text/plain" "-" "-" 0.1 postdata[' + "b" * (size // 2) + "]"
    alb = f'https 2023-01-01T00:00:00.1Z lb 192.0.2.1:99 - -1 -1 -1 200 200 0 5 "GET https://h:443{path} HTTP/1.1" "{escaped[: size // 4 * 3]}" - - - "-"'
    want = None if size < 65_000 else "line-too-long"
    for parse, texts in ((logs.parse_combined, [combined, agent]), (logs.parse_vhost_combined, ["h:80 " + combined, "h " + agent]), (logs.parse_nginx_postdata, [GOOD + post.replace("b" * 9, '/\\"')]), (logs.parse_alb, [alb])):
        rows = parse(lines(spark, *texts)).collect()
        assert [r.reason for r in rows if r.reason != "line-too-long"] == [None] * sum(r.reason is None for r in rows) and (want is None or parse is logs.parse_nginx_postdata or rows[0].reason == want)
    assert logs.parse_combined(lines(spark, combined)).first().uri_path == (path if want is None else path)
    assert {r.reason for r in logs.parse_combined(lines(spark, '"' * size, "\\" * size, GOOD[:-1] + "\\" * size)).collect()} <= {"not-combined", "line-too-long"}
    assert logs.detect_format(lines(spark, combined)).first().sources == ["nginx-combined", "apache-combined"]


def test_escapes_of_logs(spark):
    texts = ['a\\"b\\\\c\\n', "\\x41\\x0a\\xe9\\x4", "plain", None]
    got = [tuple(r) for r in lines(spark, *texts).select(logs.unescaped(F.col("line")), logs.log_text(F.col("line"))).collect()]
    assert got == [('a"b\\c\\n', 'a"b\\c\\n'), ("\\x41\\x0a\\xe9\\x4", "A\n\\xe9\\x4"), ("plain", "plain"), (None, None)]


def test_missing_status_is_null(spark):
    r = logs.parse_combined(lines(spark, GOOD.replace(" 200 12 ", " - - "))).first()
    assert r.status is None and r.response_bytes is None and r.reason is None


def test_waf_bad_json_is_one_error(spark):
    record = {"timestamp": 1, "httpRequest": {"clientIp": "192.0.2.1", "uri": "/a?x=1", "args": "y=2", "headers": [{"name": "HOST", "value": "h"}, {"name": "host", "value": "i"}]}}
    good, errors = logs.split_errors(logs.parse_waf_json(lines(spark, json.dumps(record), '{"timestamp": ')))
    r = good.first()
    assert (r.uri, r.uri_query, r.host, r.waf_labels) == ("/a?y=2", "y=2", "h", [])
    assert errors.count() == 1


def test_alb_without_request_keeps_peer(spark):
    text = 'http 2023-01-01T00:00:00.1Z lb [2001:db8::1]:99 - -1 -1 -1 400 - 0 5 "- - -" "-" - - - "-"'
    r = logs.parse_alb(lines(spark, text)).first()
    assert (r.source_ip, r.source_port, r.status, r.method, r.uri_path, r.reason) == ("2001:db8::1", 99, 400, None, None, None)


def test_cloudfront_follows_latest_header(spark):
    rows = lines(spark, "#Fields: date time c-ip cs-method", "2023-01-01\t00:00:01\t192.0.2.1\tGET", "#Fields: c-ip date time cs(User-Agent)", "192.0.2.2\t2023-01-01\t00:00:02\ta%20b+c")
    got = [(r.source_ip, r.method, r.user_agent) for r in logs.parse_cloudfront(rows).orderBy("line_number").collect()]
    assert got == [("192.0.2.1", "GET", None), ("192.0.2.2", None, "a b+c")]


def test_line_numbers_over_splits(spark, tmp_path):
    with open(tmp_path / "a.log", "w") as f:
        f.writelines(f"line {i}\n" if i % 10 else "\n" for i in range(1, 2001))
    with gzip.open(tmp_path / "b.log.gz", "wt") as f:
        f.write("x\n\ny\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = logs.read_log_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    a = {r.line_number: r.line for r in got if r.input_file.endswith("a.log")}
    assert len(a) == 1800 and all(text == f"line {n}" for n, text in a.items())
    assert sorted(r.line_number for r in got if r.input_file.endswith(".gz")) == [1, 3]


def test_discovery_and_manifest(spark, tmp_path):
    for name in ("a.log", "b.exe", "c.jsonl"):
        (tmp_path / name).write_text("x")
    got = {r.path.rsplit("/", 1)[1]: r.reason for r in logs.discover_inputs(spark, str(tmp_path)).collect()}
    assert got == {"a.log": None, "b.exe": "unsupported-extension", "c.jsonl": None}
    assert logs.corpus_manifest(spark, str(tmp_path)).select("sha256").distinct().count() == 1


def test_stix(spark, tmp_path):
    base = {"type": "indicator", "spec_version": "2.1", "valid_from": "2024-01-01T00:00:00Z"}
    objects = [base | {"id": "i1", "pattern": "[ipv4-addr:value = '192.0.2.1' OR ipv4-addr:value = '192.0.2.0/24']"}, base | {"id": "i2", "pattern": "[url:value = 'x']", "revoked": True}, base | {"id": "i3", "pattern": "[url:value = 'x'] FOLLOWEDBY [url:value = 'y']"}, base | {"id": "i4", "spec_version": "2.0", "pattern": "[url:value = 'x']"}]
    (tmp_path / "b.json").write_text(json.dumps({"type": "bundle", "objects": objects}))
    got = {(r.indicator_id, r.type, r.value, r.reason) for r in intel.read_indicators_stix(spark, str(tmp_path / "b.json")).collect()}
    assert got == {("i1", "ip", "192.0.2.1", None), ("i1", "cidr", "192.0.2.0/24", None), ("i2", None, None, "revoked"), ("i3", None, None, "pattern"), ("i4", None, None, "version")}


def test_address_set_truncates(spark):
    got = {(r.network, r.reason) for r in intel.parse_address_set(spark.createDataFrame([("192.0.2.9/24",), ("192.0.2.1/24 # x",), ("x",), ("",)], "line string")).collect()}
    assert got == {("192.0.2.0/24", None), (None, "invalid")}


def test_asn_last_row_wins(spark, tmp_path):
    (tmp_path / "a.csv").write_text("network,autonomous_system_number,autonomous_system_organization\n192.0.2.0/24,1,A\n192.0.2.0/24,2,B\n")
    assert [tuple(r) for r in intel.read_asn_networks(spark, str(tmp_path / "a.csv")).collect()] == [("192.0.2.0/24", 2, "B")]


def test_sinks_refuse_to_overwrite(spark, tmp_path):
    table = spark.createDataFrame([("CVE-1", ["a", "b"], 3)], "cve string, template_ids array<string>, requests long")
    sinks.write_findings(table, str(tmp_path / "f"))
    with pytest.raises(Exception, match="(?i)exist"):
        sinks.write_findings(table, str(tmp_path / "f"))
    sinks.write_findings(table, str(tmp_path / "c"), "csv")
    assert spark.read.csv(str(tmp_path / "c"), header=True).first().template_ids == "a;b"
    sinks.write_run("r1", {"t": table}, str(tmp_path / "run"))
    with pytest.raises(Exception, match="(?i)exist"):
        sinks.write_run("r1", {"t": table}, str(tmp_path / "run"))


def test_sanitized_tables_hold_no_raw_value(spark):
    table = spark.createDataFrame([("/secret", "192.0.2.1", 3, "high")], "uri_path string, source_ip string, requests long, severity string")
    assert sinks.sanitize(table).columns == ["requests", "severity"]


def test_export_is_stable(spark):
    summary = spark.createDataFrame([("CVE-1", 2), ("CVE-2", 1)], "cve string, requests long")
    assert sinks.export_stix(summary, "r").collect() == sinks.export_stix(summary.orderBy("requests"), "r").collect()
    assert sinks.export_misp(summary, "r").count() == 2


def test_discovery_tells_why_files_are_skipped(spark, tmp_path):
    for name in ("a.log", "b.LOG", "c.md", "d", "e.log.1", "f.GZ", ".secret.log", "g.jsonl"):
        (tmp_path / name).write_text("x\n")
    (tmp_path / ".hidden").mkdir()
    (tmp_path / ".hidden" / "h.log").write_text("x\n")
    (tmp_path / "inner").mkdir()
    (tmp_path / "inner" / "i.txt").write_text("x\n")
    (tmp_path / "link.log").symlink_to(tmp_path / "a.log")
    found = logs.discover_inputs(spark, str(tmp_path))
    got = {r.path.rsplit("/", 1)[1]: r.reason for r in found.collect()}
    want = {"a.log": None, "b.LOG": "unsupported-extension", "c.md": "unsupported-extension", "d": None, "e.log.1": None, "f.GZ": None, ".secret.log": "hidden", "g.jsonl": None, ".hidden": "hidden-directory", "i.txt": None}
    assert {k: v for k, v in got.items() if k != "link.log"} == want
    assert got["link.log"] in ("symlink", None)  # where the file system tells links
    assert {r.reason: r.skipped for r in logs.discovery_summary(found).filter("reason != 'symlink'").collect()} == {"unsupported-extension": 2, "hidden": 1, "hidden-directory": 1}
    waf = {r.path.rsplit("/", 1)[1]: r.reason for r in logs.discover_inputs(spark, str(tmp_path), "aws-waf").collect()}
    assert waf["a.log"] == "unsupported-extension" and waf["g.jsonl"] is None
    assert [r.reason for r in logs.discover_inputs(spark, str(tmp_path / ".secret.log")).collect()] == [None]


def test_ranges_that_overlap_are_an_error(spark, tmp_path):
    (tmp_path / "ok.tsv").write_text("192.0.2.0\t192.0.2.9\t64500\tZZ\tA\n192.0.2.10\t192.0.2.20\t0\tZZ\tNone\n192.0.2.10\t192.0.2.20\t64501\tZZ\tB\n")
    assert sorted(r.asn for r in intel.read_asn_ranges(spark, str(tmp_path / "ok.tsv")).collect()) == [64500, 64501]
    (tmp_path / "bad.tsv").write_text("192.0.2.0\t192.0.2.9\t64500\tZZ\tA\n192.0.2.9\t192.0.2.20\t64501\tZZ\tB\n")
    with pytest.raises(ValueError, match="overlap"):
        intel.read_asn_ranges(spark, str(tmp_path / "bad.tsv"))


def test_readers_of_reputation_and_catalog(spark, tmp_path):
    rows = [{"scope": "ip", "value": "192.0.2.1", "score": 95, "source": "a"}, {"scope": "host", "value": "x", "score": 1}, {"scope": "asn", "value": "64500", "score": 101}, {"scope": "cidr", "score": 5}]
    (tmp_path / "r.jsonl").write_text("\n".join(map(json.dumps, rows)))
    assert sorted((r.value or "", r.reason) for r in intel.read_reputation(spark, str(tmp_path / "r.jsonl")).collect() if r.reason) == [("", "value"), ("64500", "score"), ("x", "scope")]
    (tmp_path / "k.json").write_text(json.dumps({"vulnerabilities": [{"cveID": " cve-2024-1 ", "product": "p"}]}))
    assert intel.read_kev(spark, str(tmp_path / "k.json")).first().cve_id == "CVE-2024-1"
    (tmp_path / "b.json").write_text(json.dumps({"prefixes": [{"ipv4Prefix": "192.0.2.0/24"}, {"ipv6Prefix": "2001:db8::/32"}, {"ipv4Prefix": "192.0.2.0/24"}, {}]}))
    assert {r.network for r in intel.read_bot_ranges(spark, str(tmp_path / "b.json"), "o").collect()} == {"192.0.2.0/24", "2001:db8::/32"}


def test_address_lists_by_identity(spark, tmp_path):
    rows = [("observed-peer", "192.0.2.9"), ("observed-peer", "::ffff:192.0.2.1"), ("validated-client", "2001:DB8::1"), ("hostname-peer", "host.example")]
    sinks.write_address_list(spark.createDataFrame(rows, "identity string, source string"), str(tmp_path / "lists"), "source")
    got = {d.name: sorted(x for f in d.glob("*.txt") for x in f.read_text().split()) for d in (tmp_path / "lists").glob("identity=*")}
    assert got == {"identity=observed-peer": ["192.0.2.1", "192.0.2.9"], "identity=validated-client": ["2001:db8::1"]}
