"""Readers of indicator, network, reputation, bot-range and detection files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trailwork.functions import network as N

TYPES = ("ip", "cidr", "path", "path-prefix", "user-agent", "ja3", "ja4", "host", "url")


def _kept_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim(F.regexp_replace("value", "#.*$", "")).alias("line")).filter("line != ''")


def parse_indicators(lines: DataFrame) -> DataFrame:
    """type, value, label, reason (NULL: usable) of tab-separated lines; equal atoms stay once."""
    cells = F.split("line", "\t")
    rows = lines.filter((F.trim("line") != "") & ~F.col("line").startswith("#")).select(F.lower(F.trim(F.get(cells, F.lit(0)))).alias("type"), F.trim(F.get(cells, F.lit(1))).alias("value"), F.get(cells, F.lit(2)).alias("label"))
    v = F.col("value")
    reason = F.when(~F.col("type").isin(*TYPES), "unknown-type").when(v.isNull() | (v == ""), "empty-value").when((F.col("type") == "ip") & N.canonical_ip(v).isNull(), "invalid-ip").when((F.col("type") == "cidr") & ~v.rlike(r"^[0-9A-Fa-f:.]+/\d{1,3}$"), "invalid-cidr").when(F.col("type").startswith("path") & ~v.startswith("/"), "invalid-path")
    url = F.col("type") == "url"
    reason = reason.when(url & v.contains("?"), "url-query-unsupported").when(url & v.contains("#"), "url-fragment-unsupported").when(url & ~v.rlike("^https?://"), "unsupported-url").when(url & ~v.rlike(r"^https?://[^/@\s]+(/.*)?$"), "invalid-value")
    return rows.withColumn("reason", reason).dropDuplicates(["type", "value"])


def read_indicators_tsv(spark: SparkSession, path: str) -> DataFrame:
    return parse_indicators(spark.read.text(path).select(F.col("value").alias("line")))


STIX = "objects array<struct<type:string,id:string,spec_version:string,revoked:boolean,pattern:string,valid_from:string,valid_until:string>>"
#: Object paths of a pattern and the atoms they give.
STIX_ATOMS = {"ipv4-addr:value": "ip", "ipv6-addr:value": "ip", "domain-name:value": "host", "url:value": "url"}


def read_indicators_stix(spark: SparkSession, path: str) -> DataFrame:
    """indicator_id, type, value, valid_from, valid_until, reason: an atom a row of one-observation OR patterns of equalities."""
    objects = spark.read.schema(STIX).json(path, multiLine=True).select(F.explode("objects").alias("o")).select("o.*").filter("type = 'indicator'")
    atoms = F.regexp_extract_all("pattern", F.lit(r"([a-z0-9-]+:[a-z_]+)\s*=\s*'([^']*)'"), F.lit(0))
    reason = F.when(F.col("revoked"), "revoked").when(F.col("spec_version") != "2.1", "version").when(F.col("pattern").rlike(r"\]\s*\S") | F.col("pattern").rlike(r"(?i)\b(AND|FOLLOWEDBY|NOT|LIKE|MATCHES)\b"), "pattern").when(F.size(atoms) == 0, "pattern")
    rows = objects.select(F.col("id").alias("indicator_id"), F.to_timestamp("valid_from").alias("valid_from"), F.to_timestamp("valid_until").alias("valid_until"), reason.alias("reason"), F.explode_outer(F.when(reason.isNull(), atoms)).alias("atom"))
    kind = F.create_map(*[F.lit(x) for pair in STIX_ATOMS.items() for x in pair])[F.regexp_extract("atom", r"^([a-z0-9-]+:[a-z_]+)", 1)]
    value = F.regexp_extract("atom", r"'([^']*)'", 1)
    typed = F.when(kind.isin("ip") & value.contains("/"), "cidr").otherwise(kind)
    return rows.select("indicator_id", typed.alias("type"), F.when(F.col("atom").isNotNull(), value).alias("value"), "valid_from", "valid_until", F.when(F.col("reason").isNull() & F.col("atom").isNotNull() & kind.isNull(), "object-path").otherwise(F.col("reason")).alias("reason"))


def read_asn_networks(spark: SparkSession, path: str) -> DataFrame:
    """network, asn, org of a CIDR table; a later row replaces an earlier one of the same network."""
    rows = spark.read.csv(path, header=True).select("network", F.col("autonomous_system_number").cast("long").alias("asn"), F.col("autonomous_system_organization").alias("org"), F.monotonically_increasing_id().alias("row"))
    return rows.filter("asn is not null").groupBy("network").agg(F.max_by(F.struct("asn", "org"), "row").alias("x")).select("network", "x.*")


def normalize_ranges(lines: DataFrame) -> DataFrame:
    """start_ip, end_ip, asn, org, reason of tab-separated ranges: NULL for a range of an ASN, else unassigned (ASN 0) or why it is none."""
    cell = lambda i: F.trim(F.get(F.split("line", "\t"), F.lit(i)))
    rows = lines.filter(F.trim("line") != "").select(cell(0).alias("start_ip"), cell(1).alias("end_ip"), cell(2).try_cast("long").alias("asn"), cell(4).alias("org"))
    first, last = N.ip_hex(F.col("start_ip")), N.ip_hex(F.col("end_ip"))
    why = F.when(first.isNull() | last.isNull() | (F.length(first) != F.length(last)), "address").when(first > last, "order").when(F.col("asn").isNull() | (F.col("asn") < 0), "asn").when(F.col("asn") == 0, "unassigned")
    return rows.withColumn("reason", why)


def read_asn_ranges(spark: SparkSession, path: str) -> DataFrame:
    """start_ip, end_ip, asn, org of a range table; ranges that overlap are an error, since an address would have two networks."""
    ranges = normalize_ranges(spark.read.text(path).select(F.col("value").alias("line"))).filter("reason is null").drop("reason")
    from trailwork.operators.compare import range_overlaps

    if not range_overlaps(ranges).isEmpty():
        raise ValueError(f"ranges of {path} overlap")
    return ranges


def read_reputation(spark: SparkSession, path: str) -> DataFrame:
    """scope, value, score, source, categories, as_of, reason (NULL: usable)."""
    rows = spark.read.schema("scope string, value string, score long, source string, categories array<string>, as_of string").json(path)
    return rows.withColumn("reason", F.when(~F.col("scope").isin("ip", "cidr", "asn"), "scope").when(F.col("score").isNull() | ~F.col("score").between(0, 100), "score").when(F.col("value").isNull(), "value"))


#: Scores of the public lists.
FEED_SCORES = {"drop": 95, "netset": 90, "addresses": 85, "scanners": 80}


def normalize_blocklist(lines: DataFrame, feed: str) -> DataFrame:
    """scope, value, score, source of a list text: the first token of each line, what follows ; or # is a comment."""
    token = F.regexp_extract("line", r"^\s*([0-9A-Fa-f:.]+(?:/\d{1,3})?)\s*(?:[;#].*)?$", 1)
    rows = lines.select(token.alias("value")).filter("value != ''").distinct()
    return rows.select(F.when(F.col("value").contains("/"), "cidr").otherwise("ip").alias("scope"), "value", F.lit(FEED_SCORES[feed]).cast("long").alias("score"), F.lit(feed).alias("source"))


def read_bot_ranges(spark: SparkSession, path: str, operator_id: str) -> DataFrame:
    """operator_id, network of a prefixes document, distinct."""
    rows = spark.read.schema("prefixes array<struct<ipv4Prefix:string,ipv6Prefix:string>>").json(path, multiLine=True).select(F.explode("prefixes").alias("p"))
    return rows.select(F.lit(operator_id).alias("operator_id"), F.coalesce("p.ipv4Prefix", "p.ipv6Prefix").alias("network")).filter("network is not null").distinct()


def parse_address_set(lines: DataFrame) -> DataFrame:
    """network (truncated to its length, canonical), reason; comments and blanks are gone, duplicates stay once."""
    text = F.trim(F.regexp_replace("line", "#.*$", ""))
    rows = lines.select(text.alias("text")).filter("text != ''").distinct()
    known = N.networks(rows, "text").select("text", F.concat(N.hex_text(F.rpad("base", F.when(F.col("family") == 4, 8).otherwise(32), F.lit("0"))), F.lit("/"), "prefix_len").alias("network"))
    return rows.join(known, "text", "left").select("network", F.when(F.col("network").isNull(), "invalid").alias("reason")).distinct()


def read_address_set(spark: SparkSession, path: str) -> DataFrame:
    return parse_address_set(spark.read.text(path).select(F.col("value").alias("line")))


DETECTION = "template_id string, ordinal int, cves array<string>, detectability string, severity string, tags array<string>, vendor string, products array<string>, method string, path string, query string, fragment string, headers array<struct<name:string,value:string>>, conversion_status string, validation_status string"


def read_detections(spark: SparkSession, path: str) -> DataFrame:
    """Detections of a JSON file, the CVEs of each sorted and once each."""
    return spark.read.schema(DETECTION).json(path).withColumn("cves", F.array_sort(F.array_distinct("cves")))


def select_detections(detections: DataFrame) -> DataFrame:
    """Converted, validated and with a CVE."""
    return detections.filter((F.col("conversion_status") == "converted") & (F.col("validation_status") == "passed") & (F.size("cves") > 0))


def read_kev(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema("vulnerabilities array<struct<cveID:string,vendorProject:string,product:string,dateAdded:string,dueDate:string,knownRansomwareCampaignUse:string>>").json(path, multiLine=True)
    return rows.select(F.explode("vulnerabilities").alias("v")).select(F.upper(F.trim("v.cveID")).alias("cve_id"), "v.vendorProject", "v.product", "v.dateAdded", "v.dueDate", "v.knownRansomwareCampaignUse")


def text_lines(column: Column | str) -> Column:
    return F.explode(F.split(column, "\n"))
