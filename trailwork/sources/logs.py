"""Log sources: physical lines, seven formats to web_events columns, rejected lines with reasons.

Every parser is a set of Column expressions over (input_file, line_number, line); rejected lines carry a stable reason.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from trailwork.functions import web as W
from trailwork.functions.tables import once, small, written

LONGEST_LINE = 64 * 1024
EXTENSIONS = ("log", "txt", "json", "jsonl")
#: A quoted value: runs without quotes and backslashes, and escaped characters. Possessive, so that no length of it recurses.
_QUOTED = r'"([^"\\]*+(?:\\.[^"\\]*+)*+)"'
#: The Combined format and what some formats put around it.
_COMBINED = rf'(\S++) \S++ \S++ \[([^\]]++)\] {_QUOTED} (\d{{3}}|-) (\d++|-) {_QUOTED} {_QUOTED}'
COMBINED = f"^{_COMBINED}$"
VHOST = rf"^(\S++) {_COMBINED}$"
POSTDATA = rf"^{_COMBINED} {_QUOTED} {_QUOTED} {_QUOTED} (\S++) postdata\[(.*)\]$"
POSTDATA_PREFIX = r"^\d{4} [A-Z][a-z]{2} \d{2} \d{2}:\d{2}:\d{2} \([^)]*+\) \S+->\S*/(?:([^/ ]+?)_access(?:_\d+)?\.log|[^/ ]*\.log) "
ERROR_LOG = r"^\d{4}/\d{2}/\d{2} \d{2}:\d{2}:\d{2} \[[a-z]+\] "
CLOUDFRONT_FIELDS = "date time x-edge-location sc-bytes c-ip cs-method cs(Host) cs-uri-stem sc-status cs(Referer) cs(User-Agent) cs-uri-query cs(Cookie) x-edge-result-type x-edge-request-id x-host-header cs-protocol cs-bytes time-taken".split()
#: Parts of a matched line are joined by this character; where a line has one itself, it is written as an escape before.
_MARK = "\x01"
#: Most file splits whose line counts are broadcast.
MOST_SPLITS = 500_000


def discover_inputs(spark: SparkSession, path: str, source: str | None = None) -> DataFrame:
    """(path, length, reason): NULL reason for inputs to read, else hidden-directory, hidden, symlink or unsupported-extension.

    Only names are listed, by the file system that the path belongs to; nothing is read, links aren't followed, and hidden
    directories are told but not entered. A file alone is an input whatever its name. Names without an extension, with gz or
    with digits only are inputs; others as ``source`` (aws-waf, another, or None for any) has them.
    """
    fs_of = spark._jvm.org.apache.hadoop.fs
    root = fs_of.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    told = lambda s, reason: (s.getPath().toString(), s.getLen(), reason)
    if fs.getFileStatus(root).isFile():
        return spark.createDataFrame([told(fs.getFileStatus(root), None)], "path string, length long, reason string")
    allowed = {None: EXTENSIONS, "aws-waf": ("json", "jsonl")}.get(source, ("log", "txt"))
    rows, open_folders = [], [root]
    while open_folders:
        for status in fs.listStatus(open_folders.pop()):
            name = status.getPath().getName()
            stem, dot, extension = name.rpartition(".")
            if fs.supportsSymlinks() and fs.getFileLinkStatus(status.getPath()).isSymlink():
                rows.append(told(status, "symlink"))
            elif status.isDirectory():
                if name.startswith("."):
                    rows.append(told(status, "hidden-directory"))
                else:
                    open_folders.append(status.getPath())
            elif name.startswith("."):
                rows.append(told(status, "hidden"))
            else:
                fit = not (dot and stem) or extension.lower() == "gz" or (extension.isascii() and extension.isdigit()) or extension in allowed
                rows.append(told(status, None if fit else "unsupported-extension"))
    return spark.createDataFrame(rows, "path string, length long, reason string")


def discovery_summary(found: DataFrame) -> DataFrame:
    """Skipped inputs by reason."""
    return found.filter("reason is not null").groupBy("reason").agg(F.count("*").alias("skipped"))


def corpus_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of every input file."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def raw_lines(reader) -> DataFrame:
    """line, input_file and block (where its split of the file begins) of a reader of text, batch or stream, that has its path."""
    return reader.select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("input_file"), F.col("_metadata.file_block_start").alias("block"))


def numbered_lines(raw: DataFrame, few_splits: bool = False) -> DataFrame:
    """(input_file, line_number, line) of ``raw_lines``: physical lines, blank ones counted but left out.

    A file's splits are read apart: each split's lines are numbered by their order in it, on top of the lines of the splits
    before, so no file has to fit one task but for the numbering of a split. Whole files only.
    """
    raw = raw.withColumn("row", F.monotonically_increasing_id())
    counts = raw.groupBy("input_file", "block").agg(F.count("*").alias("n"), F.min("row").alias("first"))
    ahead = Window.partitionBy("input_file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("ahead", F.coalesce(F.sum("n").over(ahead), F.lit(0))).drop("n")
    # Rows of one split follow each other, so their ids differ by one.
    numbered = raw.join(F.broadcast(offsets) if few_splits else offsets, ["input_file", "block"]).withColumn("line_number", F.col("ahead") + F.col("row") - F.col("first") + 1)
    return numbered.filter(F.trim("line") != "").select("input_file", "line_number", "line")


def read_log_lines(spark: SparkSession, path: str) -> DataFrame:
    """(input_file, line_number, line) of all files below a path; gzip by suffix. See ``numbered_lines``."""
    raw = raw_lines(spark.read.option("recursiveFileLookup", "true").text(path))
    splits = len(raw.inputFiles()) + raw.rdd.getNumPartitions()  # as many as there can be; nothing is read for it
    return numbered_lines(raw, splits <= MOST_SPLITS)


def clf_time(text: Column) -> Column:
    return F.try_to_timestamp(text, F.lit("dd/MMM/yyyy:HH:mm:ss Z"))


def _dash(value: Column) -> Column:
    return F.when((value == "-") | (value == ""), None).otherwise(value)


def _parts(line: Column, pattern: str, groups: int) -> Column:
    """The groups of a pattern that matches the whole line, in one pass; an array of another size where it doesn't."""
    marked = F.regexp_replace(F.replace(line, F.lit(_MARK), F.lit("\\x01")), pattern, _MARK.join(f"${i}" for i in range(1, groups + 1)))
    return F.split(marked, _MARK, -1)


def unescaped(text: Column) -> Column:
    """A quoted value with \\" and \\\\ as what they stand for; other escapes stay."""
    return F.when(text.contains("\\"), F.regexp_replace(text, r'\\(["\\])', "$1")).otherwise(text)


def log_text(text: Column) -> Column:
    """As unescaped, with \\xHH of ASCII characters undone too, as a server writes them that logs bytes."""
    pieces = F.regexp_extract_all(text, F.lit(r"(?s)\\x[0-7][0-9A-Fa-f]|\\.|[^\\]++|."), F.lit(0))
    one = lambda p: F.when(p.rlike(r"^\\x..$"), F.decode(F.unhex(F.substring(p, 3, 2)), "UTF-8")).when(p.rlike(r'^\\["\\]$'), F.substring(p, 2, 1)).otherwise(p)
    return F.when(text.contains("\\"), F.array_join(F.transform(pieces, one), "")).otherwise(text)


def _combined(rows: DataFrame, first: int, groups: int, reason: Column | None = None) -> tuple[DataFrame, dict[str, Column]]:
    """Rows with the parts of a line (``p``) read as Combined from place ``first`` on, and the columns of an event."""
    g = lambda i: F.get("p", F.lit(first + i))
    control = r"[\p{Cntrl}]"
    whole = F.size("p") == groups
    rows = once(rows, matched=whole, request=F.when(whole, g(2)), words=F.filter(F.split(unescaped(F.when(whole, g(2))), r"\s+"), lambda w: w != ""), ts=F.when(whole, clf_time(g(1))))
    rows = rows.withColumn("target", F.get("words", F.lit(1)))
    target = F.col("target")
    path, query, fragment = W.split_target(target)
    text = lambda c: F.when(~c.rlike(control), unescaped(F.nullif(c, F.lit("-"))))
    referer, agent = text(g(5)), text(g(6))
    why = F.when(F.octet_length("line") > LONGEST_LINE, "line-too-long")
    if reason is not None:
        why = F.coalesce(why, reason)
    why = F.coalesce(why, (
        F.when(~F.col("matched") | F.col("request").rlike(control), "not-combined").when(F.col("ts").isNull(), "timestamp")
        .when((F.size("words") != 3) | ~F.get("words", F.lit(2)).startswith("HTTP/"), "request-line").when(~target.startswith("/"), "target").when(~W.valid_percent_escapes(target), "percent-escape")
    ))
    header = lambda name, c: F.when(c.isNotNull(), F.struct(F.lit(name).alias("name"), c.alias("value")))
    return rows, {
        "source_ip": g(0), "ts": F.col("ts"), "method": F.get("words", F.lit(0)), "uri": target, "uri_path": path, "uri_query": query, "uri_fragment": fragment, "protocol": F.get("words", F.lit(2)), "request_line": F.col("request"),
        "status": _dash(g(3)).try_cast("int"), "response_bytes": _dash(g(4)).try_cast("long"), "referer": referer, "user_agent": agent, "headers": F.array_compact(F.array(header("Referer", referer), header("User-Agent", agent))), "reason": why,
    }


def _rows(lines: DataFrame, columns: dict[str, Column], source: str) -> DataFrame:
    return lines.select("input_file", "line_number", *[c.alias(n) for n, c in columns.items()], F.lit(source).alias("log_source"))


def split_errors(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events, errors): rows without and with a reason."""
    return rows.filter("reason is null").drop("reason"), rows.filter("reason is not null").select("input_file", "line_number", "reason")


def parse_combined(lines: DataFrame, source: str = "nginx") -> DataFrame:
    rows, columns = _combined(once(lines, p=_parts(F.col("line"), COMBINED, 7)), 0, 7)
    return _rows(rows, columns, source)


def parse_vhost_combined(lines: DataFrame, plain_first: bool = False) -> DataFrame:
    """Combined with ``host[:port]`` or a dash before it; with plain_first each line is tried as plain Combined before."""
    with_host = _parts(F.col("line"), VHOST, 8)
    if plain_first:
        rows = once(lines, plain=_parts(F.col("line"), COMBINED, 7))
        with_host = F.when(F.size("plain") == 7, F.concat(F.array(F.lit("-")), "plain")).otherwise(with_host)
    rows, columns = _combined(once(rows if plain_first else lines, p=with_host), 1, 8)
    host = F.regexp_replace(_dash(F.get("p", F.lit(0))), r"(?<=.):\d{1,5}$", "")
    return _rows(rows, columns | {"host": host}, "apache")


def parse_nginx_postdata(lines: DataFrame) -> DataFrame:
    """Combined with content type, TLS, cipher, seconds and body; an optional transport prefix gives the host by its file name.

    Bytes that the server logged as \\xHH stay as they are in all parts.
    """
    rows = once(lines, bare=F.regexp_replace("line", POSTDATA_PREFIX, ""))
    rows = once(rows, p=_parts(F.col("bare"), POSTDATA, 12))
    g = lambda i: F.nullif(F.get("p", F.lit(i)), F.lit("-"))
    seconds = F.get("p", F.lit(10))
    special = F.when(F.col("bare").rlike(ERROR_LOG), "error-log").when(F.col("bare").contains("postdata[") & ~F.col("bare").endswith("]"), "truncated")
    bad_time = F.when((F.size("p") == 12) & (seconds != "-") & ~F.coalesce(seconds.try_cast("double").between(0.0, 1e300), F.lit(False)), "request-time")
    rows, columns = _combined(rows, 0, 12, F.coalesce(special, bad_time))
    host = F.nullif(F.regexp_extract("line", POSTDATA_PREFIX, 1), F.lit(""))
    return _rows(rows, columns | {"host": host, "content_type": g(7), "tls_protocol": g(8), "tls_cipher": g(9), "request_time_seconds": seconds.try_cast("double"), "request_body": F.nullif(F.get("p", F.lit(11)), F.lit(""))}, "nginx-postdata")


WAF_SCHEMA = T.StructType().add("timestamp", T.LongType()).add("action", T.StringType()).add("terminatingRuleId", T.StringType()).add("terminatingRuleType", T.StringType()).add("responseCodeSent", T.IntegerType()).add("ja3Fingerprint", T.StringType()).add("ja4Fingerprint", T.StringType())
WAF_SCHEMA = WAF_SCHEMA.add("labels", T.ArrayType(T.StructType().add("name", T.StringType()))).add("nonTerminatingMatchingRules", T.ArrayType(T.StructType().add("ruleId", T.StringType()).add("action", T.StringType())))
_HEADERS = T.ArrayType(T.StructType().add("name", T.StringType()).add("value", T.StringType()))
WAF_SCHEMA = WAF_SCHEMA.add("httpRequest", T.StructType().add("clientIp", T.StringType()).add("country", T.StringType()).add("headers", _HEADERS).add("uri", T.StringType()).add("args", T.StringType()).add("httpMethod", T.StringType()).add("httpVersion", T.StringType()).add("requestId", T.StringType()).add("fragment", T.StringType())).add("_bad", T.StringType())


def parse_waf_json(lines: DataFrame) -> DataFrame:
    """One JSON object a line; args win over a query inside uri."""
    rows = lines.withColumn("w", F.from_json("line", WAF_SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    r = lambda n: F.col(f"w.httpRequest.{n}")
    path, inner, fragment = W.split_target(r("uri"))
    query = F.coalesce(_dash(r("args")), inner)
    headers = F.coalesce(r("headers"), F.array().cast(_HEADERS))
    columns = {
        "ts": F.timestamp_millis(F.col("w.timestamp")), "source_ip": r("clientIp"), "country": r("country"), "host": W.header_value(headers, "host"), "method": r("httpMethod"), "uri": F.when(query.isNotNull(), F.concat(path, F.lit("?"), query)).otherwise(path), "uri_path": path, "uri_query": query, "uri_fragment": F.coalesce(r("fragment"), fragment),
        "user_agent": W.header_value(headers, "user-agent"), "referer": W.header_value(headers, "referer"), "protocol": r("httpVersion"), "request_id": r("requestId"), "status": F.col("w.responseCodeSent"), "ja3": F.col("w.ja3Fingerprint"), "ja4": F.col("w.ja4Fingerprint"), "waf_action": F.col("w.action"), "waf_rule_id": F.col("w.terminatingRuleId"), "waf_rule_type": F.col("w.terminatingRuleType"),
        "headers": headers, "waf_labels": F.transform(F.coalesce("w.labels", F.array().cast(WAF_SCHEMA["labels"].dataType)), lambda x: x["name"]), "waf_non_terminating_rule_ids": F.transform(F.coalesce("w.nonTerminatingMatchingRules", F.array().cast(WAF_SCHEMA["nonTerminatingMatchingRules"].dataType)), lambda x: x["ruleId"]),
        "reason": F.when(F.col("w._bad").isNotNull() | F.col("w").isNull(), "json"),
    }
    return _rows(rows, columns, "aws-waf")


def _address(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r":\d+$", ""), r"[\[\]]", "")


def parse_alb(lines: DataFrame) -> DataFrame:
    """Space-separated with quotes: type, time, balancer, client, target, three times, two codes, two sizes, request, agent, cipher, protocol, group, trace."""
    fields = F.transform(F.regexp_extract_all("line", F.lit(r'"[^"\\]*+(?:\\.[^"\\]*+)*+"|\S++'), F.lit(0)), lambda x: F.regexp_replace(x, r'^"|"$', ""))
    f = lambda i: F.get(fields, F.lit(i))
    parts = F.split(f(12), " ")
    url = F.get(parts, F.lit(1))
    none = f(12).startswith("- ")
    host = F.regexp_extract(url, r"^[a-z]+://(\[[^\]]*\]|[^/:?#]*)", 1)
    target = F.regexp_replace(url, r"^[a-z]+://[^/?#]*", "")
    path, query, fragment = W.split_target(F.when(target.startswith("/"), target).otherwise(F.concat(F.lit("/"), target)))
    keep = lambda c: F.when(~none, c)
    columns = {
        "ts": F.try_to_timestamp(f(1)), "source_ip": _address(f(3)), "source_port": F.regexp_extract(f(3), r":(\d+)$", 1).try_cast("int"), "host": keep(_dash(host)), "method": keep(F.get(parts, F.lit(0))), "uri": keep(url), "uri_path": keep(path), "uri_query": keep(query), "uri_fragment": keep(fragment), "protocol": keep(F.get(parts, F.lit(2))),
        "status": _dash(f(8)).try_cast("int"), "response_bytes": _dash(f(11)).try_cast("long"), "user_agent": _dash(f(13)), "tls_cipher": _dash(f(14)), "tls_protocol": _dash(f(15)), "request_id": _dash(f(17)),
        "reason": F.when(F.octet_length("line") > LONGEST_LINE, "line-too-long").when(F.size(fields) < 18, "too-few-fields").when(F.try_to_timestamp(f(1)).isNull(), "timestamp"),
    }
    return _rows(lines, columns, "aws-alb")


def parse_cloudfront(lines: DataFrame) -> DataFrame:
    """Tab-separated by the latest #Fields: line of the same file, else the default order; cookies are never kept."""
    header = F.split(F.trim(F.regexp_replace("line", "^#Fields:", "")), r"\s+")
    # The few header lines become intervals of line numbers.
    after = F.lead("line_number").over(Window.partitionBy("input_file").orderBy("line_number"))
    # Written, so that finding them takes one pass however often they are looked at.
    found = written(lines.filter(F.col("line").startswith("#Fields:")).select("input_file", "line_number", "line"), "fields")
    headers = found.select(F.col("input_file").alias("__file"), F.col("line_number").alias("__from"), F.coalesce(after, F.lit((1 << 63) - 1)).alias("__to"), header.alias("__names"))
    inside = (F.col("input_file") == F.col("__file")) & (F.col("line_number") > F.col("__from")) & (F.col("line_number") < F.col("__to"))
    rows = lines.filter(~F.col("line").startswith("#")).join(small(headers), inside, "left")
    rows = rows.withColumn("names", F.coalesce("__names", F.array(*map(F.lit, CLOUDFRONT_FIELDS)))).withColumn("cells", F.split("line", "\t"))
    enough = F.size("cells") >= F.size("names")
    named = F.when(enough, F.map_from_arrays("names", F.slice("cells", F.lit(1), F.size("names"))))
    # The map of a line and the look-ups in it are worked out once.
    used = ["date", "time", "c-ip", "x-host-header", "cs(Host)", "cs-method", "cs-uri-stem", "cs-uri-query", "sc-status", "sc-bytes", "cs(Referer)", "cs(User-Agent)", "x-edge-request-id", "cs-protocol-version", "time-taken"]
    rows = once(once(rows, m=named, enough=enough), **{f"__{n}": F.try_element_at("m", F.lit(n)) for n in used})
    m = lambda n: _dash(F.col(f"`__{n}`"))
    decoded = lambda c: F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))
    columns = {
        "ts": F.try_to_timestamp(F.concat_ws(" ", m("date"), m("time"))), "source_ip": m("c-ip"), "host": F.coalesce(m("x-host-header"), m("cs(Host)")), "method": m("cs-method"), "uri_path": m("cs-uri-stem"), "uri_query": m("cs-uri-query"), "status": m("sc-status").try_cast("int"), "response_bytes": m("sc-bytes").try_cast("long"),
        "referer": decoded(m("cs(Referer)")), "user_agent": decoded(m("cs(User-Agent)")), "request_id": m("x-edge-request-id"), "protocol": m("cs-protocol-version"), "request_time_seconds": m("time-taken").try_cast("double"), "reason": F.when(~F.col("enough"), "too-few-fields"),
    }
    return _rows(rows, columns, "aws-cloudfront")


#: What a line of each format looks like. Two servers write Combined alike, so it can't be told whose it is.
FORMATS = {"combined": COMBINED, "vhost": VHOST, "nginx-postdata": POSTDATA, "waf": r"^\s*\{.*\"httpRequest\"", "alb": r"^(http|https|h2|ws|wss|grpcs) \d{4}-\d\d-\d\dT", "cloudfront": r"^#(Version|Fields):"}
SERVERS = {"combined": ["nginx-combined", "apache-combined"], "vhost": ["apache-vhost-combined"], "nginx-postdata": ["nginx-postdata"], "waf": ["aws-waf"], "alb": ["aws-alb"], "cloudfront": ["aws-cloudfront"]}


def detect_format(lines: DataFrame, sample: int = 1000) -> DataFrame:
    """Per file which formats any of its lines numbered up to ``sample`` shows, and which sources may have written them; ambiguous where more than one format does."""
    bare = F.regexp_replace("line", POSTDATA_PREFIX, "")
    votes = lines.filter(F.col("line_number") <= sample).groupBy("input_file").agg(*[F.bool_or(bare.rlike(p)).alias(n) for n, p in FORMATS.items()])
    names = F.array_compact(F.array(*[F.when(F.col(n), F.lit(n)) for n in FORMATS]))
    servers = F.flatten(F.array_compact(F.array(*[F.when(F.col(n), F.array(*map(F.lit, SERVERS[n]))) for n in FORMATS])))
    return votes.select("input_file", F.when(F.size(names) == 1, names[0]).when(F.size(names) > 1, "ambiguous").otherwise("unknown").alias("format"), servers.alias("sources"))


def parse_error_summary(errors: DataFrame) -> DataFrame:
    return errors.groupBy("reason").agg(F.count("*").alias("lines"))


def corpus_union(parts: list[DataFrame]) -> DataFrame:
    """Events of several files or formats as one table; a column that a format lacks is NULL in its rows."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


PARSERS = {"combined": parse_combined, "vhost": parse_vhost_combined, "nginx-postdata": parse_nginx_postdata, "waf": parse_waf_json, "alb": parse_alb, "cloudfront": parse_cloudfront}
