import ipaddress
import random
import re

from pyspark.sql import functions as F

from trailwork.functions import network as N
from trailwork.functions import web as W
from trailwork.functions.expressions import held_length, innermost_select, may_hold_expression, read_request
from trailwork.functions.spelling import decoded, features


def values(spark, rows, schema, column):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_status_class(spark):
    got = values(spark, [(x,) for x in (None, 100, 204, 302, 404, 499, 500, 599, 600)], "status int", W.status_class(F.col("status")))
    assert got == ["unavailable", "1xx", "2xx", "3xx", "4xx", "499", "5xx", "5xx", "other"]


def test_bucket_floors_before_1970(spark):
    got = values(spark, [("1969-12-31 23:59:30",), ("1970-01-01 00:01:00",)], "t string", W.bucket(F.col("t").cast("timestamp"), 60))
    assert got == [-60, 60]


def test_path_distinctiveness(spark):
    cases = {"": "generic", "/": "generic", "/robots.txt": "generic", "/x/index.php": "generic", "/Login": "generic", "/api/v1": "generic", "/api/v1/x": "distinctive", "/api/..": "distinctive", "/admin/%2e": "distinctive", None: "generic"}
    assert values(spark, [(k,) for k in cases], "p string", W.path_distinctiveness(F.col("p"))) == list(cases.values())


def test_split_target(spark):
    rows = [("/a?b=1#c",), ("/a",), ("/a?",), ("/a#f",)]
    path, query, fragment = W.split_target(F.col("t"))
    got = [tuple(r) for r in spark.createDataFrame(rows, "t string").select(path, query, fragment).collect()]
    assert got == [("/a", "b=1", "c"), ("/a", None, None), ("/a", None, None), ("/a", None, "f")]


def test_query_keys(spark):
    assert values(spark, [("a&&=x&b=1&a=2",), (None,)], "q string", W.query_keys(F.col("q"))) == [["a", "b", "a"], []]


def test_identifier_template(spark):
    rows = [("/u/12/x",), ("/f/123.json",), ("/g/0f0e0d0c-0b0a-0908-0706-050403020100",), ("/n/123456789012345678901",), ("/a/b.jsonjsonjson",)]
    assert values(spark, rows, "p string", W.path_template(F.col("p"))) == ["/u/{num}/x", "/f/{num}.json", "/g/{uuid}", "/n/123456789012345678901", "/a/b.jsonjsonjson"]


def test_addresses(spark):
    rows = [("192.0.2.1",), ("::ffff:192.0.2.1",), ("2001:DB8::1",), ("host.example",), (None,), ("256.1.1.1",), ("-",)]
    assert values(spark, rows, "ip string", N.canonical_ip(F.col("ip"))) == ["192.0.2.1", "192.0.2.1", "2001:db8::1", None, None, None, None]
    assert values(spark, rows, "ip string", N.v4_number(F.col("ip"))) == [3221225985, None, None, None, None, None, None]
    assert values(spark, [("198.51.7.99",), (None,), ("x",)], "ip string", N.v4_block(F.col("ip"), 24)) == ["198.51.7.0/24", None, None]
    assert values(spark, [("10.1.2.3",), ("11.0.0.1",), (None,)], "ip string", N.in_any_v4(F.col("ip"), ["10.0.0.0/8"])) == [True, False, False]


def test_addresses_equal_the_standard_library(spark):
    rng = random.Random(3)
    texts = []
    for _ in range(300):
        groups = [rng.choice(["0", "0", "0", f"{rng.randrange(1 << 16):x}"]) for _ in range(8)]
        full = ":".join(groups)
        texts += [full, str(ipaddress.ip_address(full)), full.upper(), ipaddress.ip_address(full).exploded]
    texts += ["::", "::1", "1::", "1::8", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "1:2:3:4:5:6:7:8:9", "1:2:3:4:5:6:7", ":::", "1::2::3", ":1", "1:", "::ffff:1.2.3.4", "::1.2.3.4", "64:ff9b::1.2.3.4", "::ffff:1.2.3.256", "1:2:3:4:5:6:7:1.2.3.4", "g::", "12345::", "1.2.3", "01.2.3.4", "::ffff:102:304", "fe80::1%eth0"]

    def canonical(x):
        try:
            ip = ipaddress.ip_address(x)
        except ValueError:
            return None
        return None if "%" in x else str(getattr(ip, "ipv4_mapped", None) or ip)

    got = spark.createDataFrame([(t,) for t in texts], "ip string").select("ip", N.canonical_ip(F.col("ip")).alias("c"), F.hex(N.ip_bytes(F.col("ip"))).alias("h")).collect()
    for r in got:
        want = canonical(r.ip)
        assert (r.c is None) == (want is None) and (want is None or ipaddress.ip_address(r.c) == ipaddress.ip_address(want) and r.h.lower() == ipaddress.ip_address(want).packed.hex()), r
        assert want is None or "." in want or r.c == want, r


def test_source_key(spark):
    rows = [("192.0.2.1", None), ("::ffff:192.0.2.1", None), ("192.0.2.1", "2001:DB8::5"), ("192.0.2.1", "unknown"), ("Host.Example.", None), ("host.example", "192.0.2.9"), ("-", None), ("", None), (None, None), ("1234", None)]
    got = [r[0] and tuple(r[0]) for r in spark.createDataFrame(rows, "p string, c string").select(N.source_key(F.col("p"), F.col("c"))).collect()]
    assert got == [("observed-peer", "192.0.2.1")] * 2 + [("validated-client", "2001:db8::5"), None, ("hostname-peer", "host.example"), ("hostname-peer", "host.example"), None, None, None, None]


def test_networks_of_both_families(spark):
    rng = random.Random(4)
    nets = ["10.0.0.0/8", "10.1.0.0/15", "10.1.2.3", "0.0.0.0/0", "2001:db8::/32", "2001:db8:8000::/33", "2001:db8::7", "::/0", "::ffff:10.0.0.0/104", "2001:db8:1::/47", "bad", "10.0.0.0/33"]
    ips = ["10.1.2.3", "::ffff:10.1.2.3", "11.0.0.1", "2001:db8::7", "2001:DB8:8000::1", "2001:db9::", "::1", "x", None] + [f"10.{rng.randrange(4)}.0.{rng.randrange(256)}" for _ in range(20)] + [f"2001:db8:{rng.randrange(1 << 16):x}::1" for _ in range(20)]

    def holds(net, ip):
        try:
            n, a = ipaddress.ip_network(net, strict=False), ipaddress.ip_address(ip)
        except ValueError:
            return False
        mapped = getattr(a, "ipv4_mapped", None)
        plain = mapped or a
        if n.version == 6 and n.network_address.ipv4_mapped and n.prefixlen >= 96:
            n = ipaddress.ip_network(f"{n.network_address.ipv4_mapped}/{n.prefixlen - 96}")
        return (plain.version == n.version and plain in n) or (a.version == n.version and a in n)

    found = N.longest_prefix(spark.createDataFrame([(x,) for x in ips], "ip string"), spark.createDataFrame([(x,) for x in nets], "network string")).collect()
    assert sorted((r.ip, r.network) for r in found) == sorted({(a, n) for a in ips for n in nets if a and holds(n, a)})
    inside = spark.createDataFrame([(x,) for x in ips], "ip string").select("ip", N.in_any(F.col("ip"), ["10.0.0.0/15", "2001:db8:8000::/33"])).collect()
    assert all(got == bool(ip and (holds("10.0.0.0/15", ip) or holds("2001:db8:8000::/33", ip))) for ip, got in inside)
    assert values(spark, [("2001:db8:1:2::3",), ("198.51.7.9",), ("::ffff:198.51.7.9",), ("x",)], "ip string", N.block(F.col("ip"))) == ["2001:db8:1::/48", "198.51.7.0/24", "198.51.7.0/24", None]


def test_longest_prefix_ends(spark):
    ips = spark.createDataFrame([("10.0.0.0",), ("10.0.0.255",), ("10.0.1.0",)], "ip string")
    nets = spark.createDataFrame([("10.0.0.0/24", 1), ("0.0.0.0/0", 2), ("10.0.0.255/32", 3), ("2001:db8::/32", 4)], "network string, asn long")
    got = {(r.ip, r.asn) for r in N.longest_prefix(ips, nets).collect()}
    assert got == {("10.0.0.0", 1), ("10.0.0.0", 2), ("10.0.0.255", 1), ("10.0.0.255", 2), ("10.0.0.255", 3), ("10.0.1.0", 2)}


def test_cves(spark):
    assert values(spark, [("x cve-2021-44228 CVE.2021.44228 cve-2020-12",)], "t string", W.cves_in(F.col("t"))) == [["CVE-2021-44228"]]


def spelled(spark, *targets):
    rows = spark.createDataFrame([(i, *t) for i, t in enumerate(targets)], "i int, path string, query string").select("i", features(F.col("path"), F.col("query")).alias("f")).orderBy("i").collect()
    return [{(x.feature, x.part) for x in r.f} for r in rows]


def brute_decode(raw):
    return re.sub(rb"%([0-9A-Fa-f]{2})", lambda m: bytes([int(m[1], 16)]), raw)


def test_decoding_equals_bytes(spark):
    rng = random.Random(1)
    texts = ["%41+%zz%2", "%", "", "%25%32%35", "%2525"] + ["".join(rng.choice(["%", "2", "5", "e", "E", "f", "c0", "%2e", "a", "é"]) for _ in range(12)) for _ in range(200)]
    latin = F.decode(F.encode("t", "UTF-8"), "ISO-8859-1")
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", decoded(latin).alias("one"), decoded(decoded(latin)).alias("two")).collect()
    plain = lambda x: bytes(ord(c) & 255 for c in x)
    for r in rows:
        once = brute_decode(r.t.encode())
        assert plain(r.one) == once and plain(r.two) == brute_decode(once), r


def test_spelling(spark):
    cases = [
        (("/a/../b", ""), {("traversal", "path")}),
        (("/a/%2e%2e/b", ""), {("traversal-encoded", "path")}),
        (("/a%2f../b", None), {("traversal-encoded", "path")}),
        (("/a/..%5cb", ""), {("traversal-encoded", "path"), ("backslash-path", "path")}),
        (("/a/%252e%252e/b", ""), {("double-encoding", "path"), ("traversal-encoded", "path")}),
        (("/%c0%af", ""), {("overlong-utf8", "path"), ("invalid-utf8", "path")}),
        (("/..%c0%af/x", ""), {("overlong-utf8", "path"), ("invalid-utf8", "path"), ("overlong-traversal", "path")}),
        (("/.%c0%ae/x", ""), {("overlong-utf8", "path"), ("invalid-utf8", "path"), ("overlong-traversal", "path")}),
        (("/.%c0%2e/x", ""), {("invalid-utf8", "path"), ("overlong-traversal", "path")}),
        (("/%c0%ae%c0%aeabc", ""), {("overlong-utf8", "path"), ("invalid-utf8", "path")}),
        (("/", "a=%zz"), {("invalid-percent-escape", "query")}),
        (("/a%00", ""), {("nul-byte", "path")}),
        (("/a%0d%0a", "%7f"), {("crlf", "path"), ("control-char", "query")}),
        (("/a/..;/b", ""), {("path-parameter-traversal", "path")}),
        (("/a\\b", ""), {("backslash-path", "path")}),
        (("/%uff0e%u002e", ""), {("iis-unicode", "path"), ("iis-unicode-ascii", "path"), ("invalid-percent-escape", "path")}),
        (("/%u4e2d", ""), {("iis-unicode", "path"), ("invalid-percent-escape", "path")}),
        (("/caf%c3%a9/..x/x..", "é=1"), set()),
        (("/plain/path", "a=1"), set()),
        (("*", None), {("asterisk-form", "target")}),
        (("/" + "a" * 8192, None), {("long-target", "target")}),
        ((None, "x=%41"), set()),
    ]
    got = spelled(spark, *[c for c, _ in cases])
    assert [(c, g) for (c, want), g in zip(cases, got, strict=True) if g != want] == []


def test_request_lines(spark):
    cases = {"GET /a HTTP/1.1": set(), "": {"empty-request"}, " - ": {"empty-request"}, "GET /a": {"non-http-request-line"}, "\x16\x03 /x HTTP/1.1": {"non-http-request-line"}, "GET http://h/a HTTP/1.1": {"absolute-form"}, "CONNECT h:443 HTTP/1.1": {"authority-form"}, "OPTIONS * HTTP/1.1": {"asterisk-form"}, "GET a HTTP/1.1": {"non-http-request-line"}}
    rows = spark.createDataFrame([(k,) for k in cases], "r string").select("r", features(F.lit("/a"), F.lit(None).cast("string"), F.col("r")).alias("f")).collect()
    assert {r.r: {x.feature for x in r.f} for r in rows} == cases
