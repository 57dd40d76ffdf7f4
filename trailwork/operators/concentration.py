"""How requests concentrate on paths, peers, blocks and time buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trailwork.functions import network as N
from trailwork.functions import web as W

CLASSES = ("1xx", "2xx", "3xx", "4xx", "499", "5xx", "other", "unavailable")
WIDTHS = (60, 600, 3600, 86400)


def _class_counts() -> list[Column]:
    found = W.status_class(F.col("status"))
    return [F.count_if(found == c).alias(f"n_{c}") for c in CLASSES]


def _bytes() -> list[Column]:
    return [F.sum("response_bytes").alias("bytes"), F.count("response_bytes").alias("bytes_available")]


def path_concentration(events: DataFrame) -> DataFrame:
    """Per path: requests, share, peers, requests a peer, classes, bytes, query use. The total comes from the same groups."""
    keys = events.filter("uri_path is not null").select("uri_path", F.explode(W.query_keys(F.col("uri_query"))).alias("key")).groupBy("uri_path").agg(F.countDistinct("key").alias("query_keys"))
    per = events.filter("uri_path is not null").groupBy("uri_path").agg(
        F.count("*").alias("requests"), F.countDistinct("source_ip").alias("peers"), *_class_counts(), *_bytes(),
        F.count("uri_query").alias("with_query"), F.countDistinct("uri_query").alias("query_strings"),
    )
    total = events.agg(F.count("*").alias("all_requests"))
    joined = per.join(keys, "uri_path", "left").withColumn("query_keys", F.coalesce("query_keys", F.lit(0))).join(F.broadcast(total))
    return joined.withColumns({"share": W.share(F.col("requests"), F.col("all_requests")), "requests_per_peer": W.share(F.col("requests"), F.col("peers"))}).drop("all_requests")


def source_path_pairs(events: DataFrame) -> DataFrame:
    return events.filter("source_ip is not null and uri_path is not null").groupBy("source_ip", "uri_path").agg(F.count("*").alias("requests"))


def most_requested_path(events: DataFrame) -> DataFrame:
    """Per peer the path with most requests, the smallest of equals; an aggregate, so hot peers combine before the shuffle."""
    best = F.min_by("uri_path", F.struct(-F.col("requests"), "uri_path"))
    return source_path_pairs(events).groupBy("source_ip").agg(best.alias("top_path"), F.max("requests").alias("top_path_requests"))


def segment_diversity(events: DataFrame) -> DataFrame:
    """Per peer: distinct first segments of all requests, of 404s and of 400 to 498."""
    seg = W.first_segment(F.col("uri_path"))
    some = events.filter("source_ip is not null and uri_path is not null")
    return some.groupBy("source_ip").agg(F.countDistinct(seg).alias("segments"), F.countDistinct(F.when(F.col("status") == 404, seg)).alias("segments_404"), F.countDistinct(F.when(F.col("status").between(400, 498), seg)).alias("segments_4xx"))


def segment_diversity_summary(events: DataFrame) -> DataFrame:
    per = segment_diversity(events)
    return per.agg(F.count("*").alias("peers"), F.max("segments").alias("max_segments"), F.expr("percentile(segments, 0.5)").alias("median_segments"), F.max("segments_404").alias("max_404"), F.expr("percentile(case when segments_404 > 0 then segments_404 end, 0.5)").alias("median_positive_404"))


def source_concentration(events: DataFrame) -> DataFrame:
    """Per peer: requests, most requested path, classes, bytes, segment diversity."""
    per = events.filter("source_ip is not null").groupBy("source_ip").agg(F.count("*").alias("requests"), *_class_counts(), *_bytes())
    out = per.join(most_requested_path(events), "source_ip", "left").join(segment_diversity(events), "source_ip", "left")
    return out.fillna(0, ["segments", "segments_404", "segments_4xx"])


def response_outcomes(events: DataFrame) -> DataFrame:
    """Shares over all requests, those without a status included; 499 is no ordinary 4xx."""
    n = events.agg(F.count("*").alias("requests"), *_class_counts())
    return n.select("requests", *[W.share(F.col(f"n_{c}"), F.col("requests")).alias(f"share_{c}") for c in CLASSES])


def status_codes(events: DataFrame, key: str) -> DataFrame:
    """Exact code counts of each entity, in long form."""
    return events.filter(F.col(key).isNotNull()).groupBy(key, "status").agg(F.count("*").alias("requests"))


def top_k(counts: DataFrame, key: str, k: int) -> DataFrame:
    return counts.orderBy(F.desc("requests"), key).limit(k)


def top_paths(events: DataFrame, k: int = 10) -> DataFrame:
    return top_k(events.filter("uri_path is not null").groupBy("uri_path").agg(F.count("*").alias("requests")), "uri_path", k)


def top_sources(events: DataFrame, k: int = 10) -> DataFrame:
    return top_k(events.filter("source_ip is not null").groupBy("source_ip").agg(F.count("*").alias("requests")), "source_ip", k)


def top_shares(events: DataFrame, k: int = 10) -> DataFrame:
    """Top path, and the shares of the k top paths and peers among all requests."""
    paths, peers = top_paths(events, k), top_sources(events, k)
    p = paths.agg(F.min_by("uri_path", F.struct(-F.col("requests"), "uri_path")).alias("top_path"), F.max("requests").alias("top_path_requests"), F.sum("requests").alias("p"))
    s = peers.agg(F.sum("requests").alias("s"))
    n = events.agg(F.count("*").alias("requests"))
    return n.join(F.broadcast(p)).join(F.broadcast(s)).select("requests", "top_path", "top_path_requests", W.share(F.col("p"), F.col("requests")).alias("top_paths_share"), W.share(F.col("s"), F.col("requests")).alias("top_sources_share"))


def prefix_concentration(events: DataFrame, bits: int = 24, asn: DataFrame | None = None, v6_bits: int = 48) -> DataFrame:
    """Per block of v4 or v6 addresses: requests, bytes, peers, most requests of one peer, top path, distinct paths, paths requested once."""
    e = events.withColumn("block", N.block(F.col("source_ip"), bits, v6_bits)).filter("block is not null")
    per_peer = e.groupBy("block", "source_ip").agg(F.count("*").alias("n"), F.sum("response_bytes").alias("b"))
    peers = per_peer.groupBy("block").agg(F.sum("n").alias("requests"), F.sum("b").alias("bytes"), F.count("*").alias("peers"), F.max("n").alias("max_per_peer"))
    per_path = e.filter("uri_path is not null").groupBy("block", "uri_path").agg(F.count("*").alias("n"))
    paths = per_path.groupBy("block").agg(F.count("*").alias("paths"), F.count_if(F.col("n") == 1).alias("paths_once"), F.min_by("uri_path", F.struct(-F.col("n"), "uri_path")).alias("top_path"))
    out = peers.join(paths, "block", "left").fillna(0, ["paths", "paths_once"])
    if asn is not None:
        known = per_peer.join(asn.select(F.col("ip").alias("source_ip"), "asn"), "source_ip", "left").groupBy("block").agg(F.countDistinct("asn").alias("asns"), F.count_if(F.col("asn").isNull()).alias("peers_without_asn"))
        out = out.join(known, "block")
    return out


def focus(events: DataFrame, path: str | None = None, path_prefix: str | None = None, source_ips: list[str] | None = None) -> DataFrame:
    """The requests of an exact path, a subtree by whole segments, or some addresses; the measures above apply to them."""
    out = events
    if path is not None:
        out = out.filter(F.col("uri_path") == path)
    if path_prefix is not None:
        out = out.filter(W.in_subtree(F.col("uri_path"), path_prefix))
    if source_ips is not None:
        out = out.filter(N.canonical_or_raw(F.col("source_ip")).isin(source_ips))
    return out


def focus_summary(events: DataFrame, **what) -> DataFrame:
    """One row of measures of a focus against the whole."""
    part = focus(events, **what).agg(F.count("*").alias("requests"), F.countDistinct("source_ip").alias("peers"), F.countDistinct("uri_path").alias("paths"), *_class_counts(), *_bytes())
    return part.join(F.broadcast(events.agg(F.count("*").alias("all_requests")))).withColumn("share", W.share(F.col("requests"), F.col("all_requests")))


def focus_groups(events: DataFrame, asn: DataFrame | None = None, bits: int = 24, v6_bits: int = 48, **what) -> DataFrame:
    """Requests, share and peers of a focus by address block, and with ``asn`` (ip, asn) by network: (kind, name, requests, peers, share).

    Sources that are no address or have no known network are one group of the kind ``unresolved``; shares are of the focus.
    """
    sources = focus(events, **what).groupBy(N.canonical_ip(F.col("source_ip")).alias("ip"), F.col("source_ip").isNull().alias("nobody")).agg(F.count("*").alias("n"), F.countDistinct("source_ip").alias("raw"))
    total = sources.agg(F.sum("n").alias("all_requests"))  # one row
    placed = [sources.filter("ip is not null").select(F.lit("block").alias("kind"), N.block(F.col("ip"), bits, v6_bits).alias("name"), "n", F.lit(1).alias("sources"))]
    if asn is not None:
        known = asn.select(N.canonical_ip(F.col("ip")).alias("ip"), "asn").groupBy("ip").agg(F.max("asn").alias("asn"))
        named = sources.join(known, "ip", "left")
        placed.append(named.select(F.when(F.col("asn").isNull(), "unresolved").otherwise("asn").alias("kind"), F.coalesce(F.col("asn").cast("string"), F.lit("unresolved")).alias("name"), "n", F.when(F.col("ip").isNotNull(), 1).otherwise(F.col("raw")).alias("sources")))
    rows = placed[0] if len(placed) == 1 else placed[0].unionByName(placed[1])
    per = rows.groupBy("kind", "name").agg(F.sum("n").alias("requests"), F.sum("sources").alias("peers"))
    return per.join(F.broadcast(total)).withColumn("share", W.share(F.col("requests"), F.col("all_requests"))).drop("all_requests")


def path_statuses(events: DataFrame) -> DataFrame:
    """Exact status codes of each path, in long form."""
    return status_codes(events, "uri_path")


def path_waf_actions(events: DataFrame) -> DataFrame:
    """What the firewall did on each path: (uri_path, action, requests)."""
    return events.filter("uri_path is not null").groupBy("uri_path", W.waf_action_name(F.col("waf_action")).alias("action")).agg(F.count("*").alias("requests"))


def time_filter(events: DataFrame, start=None, end=None) -> DataFrame:
    """Inclusive at both ends; rows without a time stay only where both bounds are absent."""
    if start is None and end is None:
        return events
    keep = F.lit(True)
    if start is not None:
        keep &= F.col("ts") >= F.lit(start).cast("timestamp")
    if end is not None:
        keep &= F.col("ts") <= F.lit(end).cast("timestamp")
    return events.filter(F.coalesce(keep, F.lit(False)))


def time_filter_counts(events: DataFrame, start, end) -> DataFrame:
    inside = F.coalesce(F.col("ts").between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")), F.lit(False))
    return events.agg(F.count_if(inside).alias("kept"), F.count_if(~inside & F.col("ts").isNotNull()).alias("outside"), F.count_if(F.col("ts").isNull()).alias("undated"))


def field_availability(events: DataFrame) -> DataFrame:
    return events.agg(F.count("*").alias("requests"), *[F.count(c).alias(f"has_{c}") for c in events.columns if c != "event_id"])


def request_rates(events: DataFrame, widths: tuple[int, ...] = WIDTHS) -> DataFrame:
    """Per width: peak, median and their ratio over non-empty buckets, and the requests without a time, which are in no bucket."""
    wide = events.select(W.epoch(F.col("ts")).alias("at"), F.explode(F.array(*map(F.lit, widths))).alias("width"))
    buckets = wide.groupBy("width", F.floor(F.col("at") / F.col("width")).alias("bucket")).agg(F.count("*").alias("n"))
    dated = F.when(F.col("bucket").isNotNull(), F.col("n"))
    out = buckets.groupBy("width").agg(F.count("bucket").alias("buckets"), F.max(dated).alias("peak"), F.percentile(dated, 0.5).alias("median"), F.coalesce(F.sum(F.when(F.col("bucket").isNull(), F.col("n"))), F.lit(0)).alias("undated"))
    return out.withColumn("peak_to_median", W.share(F.col("peak"), F.col("median"), None))


def outcome_windows(events: DataFrame, widths: tuple[int, ...] = WIDTHS, min_requests: int = 20, threshold: float = 0.5) -> DataFrame:
    """Per width over buckets with enough requests: least 2xx and most 5xx share with its earliest bucket, buckets strictly below the threshold."""
    s = F.col("status")
    wide = events.filter("ts is not null").select(W.epoch(F.col("ts")).alias("at"), "status", F.explode(F.array(*map(F.lit, widths))).alias("width"))
    per = wide.groupBy("width", (F.floor(F.col("at") / F.col("width")) * F.col("width")).alias("start")).agg(F.count("*").alias("n"), F.count("status").alias("known"), F.count_if(s.between(200, 299)).alias("ok"), F.count_if(s.between(500, 599)).alias("bad"))
    able = (F.col("n") >= min_requests) & (F.col("known") > 0)
    ok, bad = F.when(able, F.col("ok") / F.col("n")), F.when(able, F.col("bad") / F.col("n"))
    return per.groupBy("width").agg(
        F.count_if(able).alias("eligible"), F.count_if(F.col("n") < min_requests).alias("below_floor"), F.count_if((F.col("n") >= min_requests) & (F.col("known") == 0)).alias("without_status"),
        F.min(ok).alias("min_2xx_share"), F.min(F.when(able, F.struct(ok, F.col("start"))))["start"].alias("min_2xx_start"),
        F.max(bad).alias("max_5xx_share"), F.min(F.when(able, F.struct(-bad, F.col("start"))))["start"].alias("max_5xx_start"),
        F.count_if(able & (F.col("ok") < threshold * F.col("n"))).alias("below_threshold"),
    )


def minute_series(events: DataFrame) -> DataFrame:
    return events.filter("ts is not null").groupBy(W.bucket(F.col("ts"), 60).alias("minute")).agg(F.count("*").alias("requests"))


def status_minute_series(events: DataFrame) -> DataFrame:
    return events.filter("ts is not null").groupBy(W.bucket(F.col("ts"), 60).alias("minute"), W.status_class(F.col("status")).alias("class")).agg(F.count("*").alias("requests"))


#: The fields that can be stacked.
STACK_FIELDS = ("content-type", "country", "header-name", "host", "ja3", "ja4", "method", "path-depth", "path-extension", "protocol", "query-key", "status", "tls-cipher", "tls-protocol", "user-agent")


def _stack_values(field: str, have: set[str]) -> Column | None:
    """The values of a field in one request as an array, or None where no column of the events can hold it."""
    path = F.col("uri_path")
    header = lambda test, value: F.transform(F.filter(F.coalesce("headers", F.array()), test), value)
    if field == "path-depth":
        return F.array(F.when(path != "", W.path_depth(path).cast("string")))
    if field == "path-extension":
        found = F.regexp_extract(W.last_segment(path), r"(?s)^.+\.([^.]+)$", 1)
        return F.array(F.when(path != "", F.when(found == "", "(none)").otherwise(F.lower(found))))
    if field == "query-key":
        return W.query_keys(F.col("uri_query")) if "uri_query" in have else None
    if field == "header-name":
        return header(lambda h: F.lit(True), lambda h: F.lower(h["name"])) if "headers" in have else None
    column = field.replace("-", "_")
    found = [F.array(F.col(column).cast("string"))] if column in have else []
    if field == "content-type" and "headers" in have:
        found.append(header(lambda h: F.lower(h["name"]) == field, lambda h: h["value"]))
    return F.concat(*found) if found else None


def _named(field: str, values: Column) -> Column:
    return F.transform(values, lambda v: F.struct(F.lit(field).alias("field"), v.alias("value")))


def stack_long(events: DataFrame, fields: tuple[str, ...] = STACK_FIELDS) -> DataFrame:
    """(field, value) of every request in long form; a value that a request repeats counts once, empty values and a dash not at all."""
    have = set(events.columns)
    made = {f: v for f in fields if (v := _stack_values(f, have)) is not None}
    recorded = lambda values: F.filter(F.array_distinct(F.coalesce(values, F.array())), lambda v: v.isNotNull() & ~v.isin("", "-"))
    pairs = F.concat(*[_named(f, recorded(v)) for f, v in made.items()])
    keep = [c for c in ("source_ip", "client_ip", "ts", "status") if c in have]
    return events.select(*keep, F.explode(pairs).alias("x")).select(*keep, "x.field", "x.value")


def stack(events: DataFrame, fields: tuple[str, ...] = STACK_FIELDS) -> DataFrame:
    """Per field value: requests, distinct peers (and clients, where resolved), first and last seen (epoch seconds), undated, status classes."""
    at, rows = W.epoch(F.col("ts")), stack_long(events, fields)
    clients = [F.countDistinct("client_ip").alias("clients")] if "client_ip" in rows.columns else []
    return rows.groupBy("field", "value").agg(F.count("*").alias("requests"), F.countDistinct("source_ip").alias("peers"), *clients, F.count_if(F.col("source_ip").isNull()).alias("without_peer"), F.min(at).alias("first_seen"), F.max(at).alias("last_seen"), F.count_if(F.col("ts").isNull()).alias("undated"), *_class_counts())


def stack_histogram(events: DataFrame) -> DataFrame:
    """Per field: distinct values, and how many occur 1, 2 to 9, 10 to 99, 100 to 999 and 1000 or more times."""
    n = F.col("requests")
    per = stack_long(events).groupBy("field", "value").agg(F.count("*").alias("requests"))
    return per.groupBy("field").agg(F.count("*").alias("values"), F.count_if(n == 1).alias("once"), F.count_if(n.between(2, 9)).alias("to_9"), F.count_if(n.between(10, 99)).alias("to_99"), F.count_if(n.between(100, 999)).alias("to_999"), F.count_if(n >= 1000).alias("more"))


def stack_ranked(events: DataFrame, k: int, rarest: bool) -> DataFrame:
    """The k rarest or most frequent values of each field, by requests, peers (unknown last), then value."""
    order = [F.asc("requests"), F.asc_nulls_last("peers")] if rarest else [F.desc("requests"), F.desc_nulls_last("peers")]
    rank = F.row_number().over(Window.partitionBy("field").orderBy(*order, "value"))
    return stack(events).select("field", "value", "requests", "peers").withColumn("rank", rank).filter(F.col("rank") <= k)


def waf_summary(events: DataFrame) -> DataFrame:
    return events.groupBy(W.waf_action_name(F.col("waf_action")).alias("action")).agg(F.count("*").alias("requests"), F.countDistinct("source_ip").alias("peers"), F.countDistinct("ja4").alias("fingerprints"))


#: The value counts kept beside the firewall's actions, and the columns that hold them.
WAF_VALUES = {"ja3": "ja3", "ja4": "ja4", "label": "waf_labels", "country": "country"}


def waf_values(events: DataFrame, key: str | None = None) -> DataFrame:
    """Requests by value of fingerprints, labels and countries, of the corpus or of each key; the value is NULL for requests that have none."""
    have = set(events.columns)
    several = {f for f, c in WAF_VALUES.items() if c in have and events.schema[c].dataType.typeName() == "array"}
    lists = {f: F.when(F.size(c) > 0, F.col(c)).otherwise(F.array(F.lit(None).cast("string"))) if f in several else F.array(F.col(c)) for f, c in WAF_VALUES.items() if c in have}
    pairs = F.concat(*[_named(f, v) for f, v in lists.items()])
    by = [key] if key else []
    rows = events.filter(F.col(key).isNotNull()) if key else events
    return rows.select(*by, F.explode(pairs).alias("x")).groupBy(*by, F.col("x.field").alias("field"), F.col("x.value").alias("value")).agg(F.count("*").alias("requests"))


def waf_value_summary(events: DataFrame, key: str | None = None) -> DataFrame:
    """Per field (and key): distinct values, their occurrences, and observations without a value."""
    there = F.col("value").isNotNull()
    n = lambda test: F.coalesce(F.sum(F.when(test, F.col("requests"))), F.lit(0))
    return waf_values(events, key).groupBy(*([key] if key else []), "field").agg(F.count("value").alias("values"), n(there).alias("occurrences"), n(~there).alias("without_value"))


def ja4_sources(events: DataFrame) -> DataFrame:
    return events.filter("ja4 is not null").groupBy("ja4").agg(F.count("*").alias("requests"), F.countDistinct("source_ip").alias("peers"))


def daily_summary(events: DataFrame) -> DataFrame:
    s = F.col("status")
    return events.agg(
        F.count("*").alias("requests"), F.countDistinct("source_ip").alias("peers"), F.countDistinct("uri_path").alias("paths"), F.countDistinct("ja4").alias("fingerprints"),
        W.share(F.count_if(s.between(200, 299)), F.count("*")).alias("share_2xx"), W.share(F.count_if(s.between(400, 498)), F.count("*")).alias("share_4xx"), W.share(F.count_if(s.between(500, 599)), F.count("*")).alias("share_5xx"), F.sum("response_bytes").alias("bytes"),
    )
