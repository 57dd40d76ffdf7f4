"""Shapes of what sources request: probes, rare successes, identifiers, request spelling, response sizes, declared identity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trailwork.functions import network as N
from trailwork.functions import web as W
from trailwork.functions.expressions import may_hold_expression, sql_read
from trailwork.functions.spelling import features
from trailwork.functions.tables import once, small, written
from trailwork.operators.ordering import with_previous

#: Public conventions, which never count as probes.
CONVENTIONS = ["/robots.txt", "/favicon.ico", "/sitemap.xml", "/.well-known"]
#: Category, mode, pattern of the default catalog of names (the longer list of web shells comes as a table).
DEFAULT_CATALOG = [
    *[("wordpress-paths", "root-tree", p) for p in ("/wp-admin", "/wp-content", "/wp-includes", "/wp-login.php", "/xmlrpc.php")],
    *[("config-or-secret-files", "exact", p) for p in ("/.env", "/.git/config", "/.aws/credentials", "/.ssh/id_rsa", "/wp-config.php", "/terraform.tfstate", "/.npmrc", "/.docker/config.json")],
    *[("admin-or-installer-paths", "root-tree", p) for p in ("/admin", "/administrator", "/install", "/setup", "/phpmyadmin")],
]


def catalog_paths(paths: DataFrame, catalog: DataFrame) -> DataFrame:
    """(uri_path, category) of distinct paths: exact, last segment, or whole-segment subtree, each an equi-join.

    A subtree pattern has a fixed number of segments, so a path is cut at the numbers of segments that occur.
    """
    p = paths.select("uri_path").filter("uri_path is not null").distinct().filter(~F.col("uri_path").isin(CONVENTIONS) & ~F.col("uri_path").startswith("/.well-known/"))
    exact = p.join(small(catalog.filter("mode = 'exact'")), F.col("uri_path") == F.col("pattern"))
    base = p.join(small(catalog.filter("mode = 'basename'")), W.last_segment(F.col("uri_path")) == F.col("pattern"))
    trees = catalog.filter("mode = 'root-tree'").withColumn("parts", F.size(F.split("pattern", "/")))
    depths = trees.select("parts").distinct()
    cut = F.concat_ws("/", F.slice(F.split("uri_path", "/"), F.lit(1), F.col("parts")))
    tree = p.join(small(depths), F.size(F.split("uri_path", "/")) >= F.col("parts")).withColumn("cut", cut).join(small(trees.withColumnRenamed("parts", "tree_parts")), (F.col("cut") == F.col("pattern")) & (F.col("parts") == F.col("tree_parts")))
    return exact.select("uri_path", "category").unionByName(base.select("uri_path", "category")).unionByName(tree.select("uri_path", "category")).distinct()


def met(value: Column, minimum: float, incomplete: Column) -> Column:
    """True at the minimum even when incomplete, else NULL if incomplete or unavailable, else false."""
    return F.when(value >= minimum, True).when(value.isNull() | incomplete, F.lit(None).cast("boolean")).otherwise(False)


def with_source(events: DataFrame) -> DataFrame:
    """Add identity and source, whom a request is grouped by: validated-client, observed-peer or hostname-peer; NULL for nobody.

    A request has one identity, so grouping by both counts nothing twice.
    """
    key = N.source_key(F.col("source_ip"), F.col("client_ip") if "client_ip" in events.columns else None)
    return events.withColumn("__key", key).select(*events.columns, F.col("__key.identity").alias("identity"), F.col("__key.source").alias("source"))


SOURCE = ("identity", "source")


def _keys(key: str | tuple[str, ...]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def _known(keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])


def probe_sources(events: DataFrame, catalog: DataFrame, min_paths: int = 20, min_error_share: float = 0.5, min_catalog: int = 3, min_unserved: float = 0.8, key: str | tuple[str, ...] = "source_ip") -> DataFrame:
    """Per source: requests, distinct and catalog paths, error shares, unserved share, active days, peak a minute, criteria, label.

    ``key`` is a column, or ``SOURCE`` for events that ``with_source`` gave an identity. Unserved paths are those no source
    got a 2xx for; without any status the share is unavailable.
    """
    s, keys = F.col("status"), _keys(key)
    e = events.filter(_known(keys))
    per = e.groupBy(*keys).agg(
        F.count("*").alias("requests"), F.count_if(F.col("uri_path").isNull()).alias("paths_unavailable"), F.count("status").alias("with_status"), F.count_if(s.between(400, 498)).alias("client_errors"), F.count_if(s == 404).alias("not_found"),
        F.countDistinct("method").alias("methods"), F.countDistinct("user_agent").alias("user_agents"), F.count("uri_query").alias("query_requests"), F.countDistinct(F.floor(W.epoch(F.col("ts")) / 86400)).alias("active_days"), F.min(W.epoch(F.col("ts"))).alias("earliest"), F.max(W.epoch(F.col("ts"))).alias("latest"),
    )
    minutes = e.filter("ts is not null").groupBy(*keys, F.floor(W.epoch(F.col("ts")) / 60).alias("minute")).agg(F.count("*").alias("n")).groupBy(*keys).agg(F.max("n").alias("peak_per_minute"))
    served = events.filter(s.between(200, 299) & F.col("uri_path").isNotNull()).select("uri_path").distinct().withColumn("served", F.lit(True))
    listed = catalog_paths(events, catalog).select("uri_path").distinct().withColumn("listed", F.lit(True))
    pairs = e.filter("uri_path is not null").groupBy(*keys, "uri_path").agg(F.count("*").alias("n")).join(served, "uri_path", "left").join(listed, "uri_path", "left")
    paths = pairs.groupBy(*keys).agg(F.count("*").alias("distinct_paths"), F.count_if(F.col("served").isNull()).alias("unserved"), F.count("listed").alias("catalog_paths"), F.sum(F.when(F.col("listed"), F.col("n")).otherwise(0)).alias("catalog_requests"))
    out = per.join(minutes, keys, "left").join(paths, keys, "left").fillna(0, ["distinct_paths", "unserved", "catalog_paths", "catalog_requests"])
    has_status = F.col("with_status") > 0
    out = out.withColumns({
        "client_error_share": F.when(has_status, W.share(F.col("client_errors"), F.col("requests"))), "not_found_share": F.when(has_status, W.share(F.col("not_found"), F.col("requests"))),
        "unserved_share": F.when(has_status & (F.col("paths_unavailable") == 0) & (F.col("distinct_paths") > 0), W.share(F.col("unserved"), F.col("distinct_paths"))), "query_share": W.share(F.col("query_requests"), F.col("requests")),
    })
    incomplete = F.col("paths_unavailable") > 0
    out = out.withColumns({"met_paths": met(F.col("distinct_paths"), min_paths, incomplete), "met_errors": met(F.col("client_error_share"), min_error_share, F.lit(False)), "met_catalog": met(F.col("catalog_paths"), min_catalog, incomplete), "met_unserved": met(F.col("unserved_share"), min_unserved, F.lit(False))})
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    return out.withColumn("probe_shaped", yes("met_paths") & (~has_status | yes("met_errors")) & (yes("met_catalog") | yes("met_unserved")))


def probe_categories(events: DataFrame, catalog: DataFrame, key: str | tuple[str, ...] = "source_ip") -> DataFrame:
    """Per source and catalog category: requests and distinct paths. A path of two categories counts in both."""
    keys = _keys(key)
    pairs = events.filter(_known(keys) & F.col("uri_path").isNotNull()).groupBy(*keys, "uri_path").agg(F.count("*").alias("n"))
    return pairs.join(catalog_paths(events, catalog).distinct(), "uri_path").groupBy(*keys, "category").agg(F.sum("n").alias("requests"), F.count("*").alias("paths"))


def rare_success(events: DataFrame, probes: DataFrame, max_sources: int = 2, max_requesting: int = 5, key: str | tuple[str, ...] = "source_ip") -> DataFrame:
    """Identifier-collapsed paths with few successful and requesting sources: methods, sizes, first and last time of all their requests.

    preceded: a probe-shaped source got a 2xx strictly after its first 4xx. ``key`` as for ``probe_sources``.
    """
    ok, keys = F.col("status").between(200, 299), _keys(key)
    at = W.epoch(F.col("ts"))
    e = events.filter("uri_path is not null").withColumn("path", W.path_template(F.col("uri_path")))
    pairs = e.groupBy("path", *keys).agg(F.count("*").alias("n"), F.count_if(ok).alias("ok"), F.max(F.when(ok, at)).alias("last_ok"))
    failures = events.filter(F.col("status").between(400, 498) & _known(keys)).groupBy(*keys).agg(F.min(at).alias("first_failure"))
    shaped = probes.filter("probe_shaped").select(*keys).join(failures, keys)
    judged = pairs.join(shaped, keys, "left").withColumn("preceded", F.coalesce((F.col("ok") > 0) & (F.col("last_ok") > F.col("first_failure")), F.lit(False)))
    known = _known(keys)
    per = judged.groupBy("path").agg(
        F.sum("n").alias("requests"), F.sum("ok").alias("successes"), F.count_if(known).alias("requesting_sources"), F.count_if((F.col("ok") > 0) & known).alias("successful_sources"), F.count_if(~known).alias("without_source"),
        F.max(F.col("preceded").cast("int")).alias("preceded"),
    )
    sizes = e.groupBy("path").agg(F.min("response_bytes").alias("min_bytes"), F.max("response_bytes").alias("max_bytes"), F.array_join(F.sort_array(F.collect_set("method")), ";").alias("methods"), F.min(at).alias("first_seen"), F.max(at).alias("last_seen"))
    out = per.filter((F.col("successes") > 0) & (F.col("without_source") == 0) & (F.col("successful_sources") <= max_sources) & (F.col("requesting_sources") <= max_requesting))
    return out.join(sizes, "path").withColumn("preceded", F.col("preceded") == 1).drop("without_source")


def rank_rare_success(rows: DataFrame) -> DataFrame:
    """Preceded ones first, then few successful and requesting sources, the newest, the path."""
    return rows.orderBy(F.desc("preceded"), "successful_sources", "requesting_sources", F.desc_nulls_last("first_seen"), "path")


def rare_success_sources(events: DataFrame, rare: DataFrame, key: str | tuple[str, ...] = "source_ip") -> DataFrame:
    """The successful sources of rare paths: successes, first and last one."""
    keys, at = _keys(key), W.epoch(F.col("ts"))
    e = events.filter(F.col("status").between(200, 299) & F.col("uri_path").isNotNull() & _known(keys)).withColumn("path", W.path_template(F.col("uri_path")))
    return e.join(rare.select("path").distinct(), "path", "left_semi").groupBy("path", *keys).agg(F.count("*").alias("successes"), F.min(at).alias("first_success"), F.max(at).alias("last_success"))


def peer_key(columns: list[str]) -> Column:
    """(identity, source) of whom a request came from: the validated client, else the observed peer, in canonical spelling; NULL for nobody."""
    named = lambda kind, c: F.when(~F.coalesce(F.col(c).isin("", "-"), F.lit(False)), F.struct(F.lit(kind).alias("identity"), N.canonical_or_raw(F.col(c)).alias("source")))
    peer = F.when(F.col("source_ip").isNotNull(), named("observed-peer", "source_ip"))
    return F.when(F.col("client_ip").isNotNull(), named("validated-client", "client_ip")).otherwise(peer) if "client_ip" in columns else peer


def identifiers(events: DataFrame, exclude: list[str] = ()) -> DataFrame:
    """A row for each identifier of a request: template, position (path:i or query:name), value. A repeated parameter counts once."""
    parts = F.split("uri_path", "/")
    e = events.filter("uri_path is not null").withColumn("template", W.path_template(F.col("uri_path")))
    keep = [c for c in ("event_id", "source_ip", "identity", "source", "method", "host", "ts", "status", "response_bytes", "template") if c in e.columns]
    # Outer, so that the optimizer doesn't work the arrays out once more to see whether they are empty.
    in_path = e.select(*keep, F.posexplode_outer(F.transform(parts, lambda s: W.path_id(s)[0])).alias("i", "value")).filter("value is not null").select(*keep, F.concat(F.lit("path:"), F.col("i")).alias("position"), "value")
    pair = lambda p: F.struct(F.split_part(p, F.lit("="), F.lit(1)).alias("name"), F.regexp_extract(p, "(?s)=(.*)$", 1).alias("value"))
    named = F.transform(F.filter(F.split(F.coalesce("uri_query", F.lit("")), "&"), lambda p: p.contains("=")), pair)
    named = F.filter(named, lambda p: W.id_kind(p["value"]).isNotNull() & ~p["name"].isin(list(exclude)))
    # Of several parameters of a name the first counts, which is found within the row.
    names = F.transform("__named", lambda p: p["name"])
    in_query = once(e.filter("uri_query like '%=%'"), __named=named).select(*keep, F.explode_outer(F.filter("__named", lambda p, i: F.array_position(names, p["name"]) == i + 1)).alias("p")).filter("p is not null")
    return in_path.unionByName(in_query.select(*keep, F.concat(F.lit("query:"), F.col("p.name")).alias("position"), F.col("p.value").alias("value")))


ENTRY = ["identity", "source", "method", "host", "template", "position"]
PAIRS = ("pairs", "numeric_pairs", "adjacent_pairs", "prefix_pairs")
#: Requests of an entry that are put in physical order together: so many event numbers.
ORDER_BUCKET = 1 << 16
WRITES = ("POST", "PUT", "PATCH", "DELETE")
#: Path segments by which a caller means itself.
SELF = ("me", "my", "self", "mine", "current")


def entry_identifiers(events: DataFrame) -> DataFrame:
    """Identifiers of requests that have a peer and a method, with their entry's key."""
    known = events.withColumn("__peer", peer_key(events.columns)).filter("__peer is not null and method is not null")
    return identifiers(known.select(*events.columns, "__peer.*"))


def _unsigned(name: str) -> Column:
    """The digits of a column as a number; NULL beyond 64 bits without a sign."""
    n = F.when(F.col(name).rlike("^[0-9]{1,20}$"), F.col(name)).try_cast("decimal(20,0)")
    return F.when(n <= F.lit("18446744073709551615").cast("decimal(20,0)"), n)


def _with_pairs(rows: DataFrame) -> DataFrame:
    """What each identifier is to the one before it in the physical order of its entry: 0 or 1 in each column of PAIRS.

    The order is taken in buckets of event numbers with the last identifier of the bucket before carried over.
    """
    rows = with_previous(rows, ENTRY, F.floor(F.col("event_id") / ORDER_BUCKET), "event_id", "value")
    gap = F.abs(_unsigned("before") - _unsigned("value"))
    extends = (F.col("before") != F.col("value")) & (F.col("before").startswith(F.col("value")) | F.col("value").startswith(F.col("before")))
    told = (F.col("before").isNotNull(), gap.isNotNull(), gap.between(1, 2), extends)
    return rows.withColumns({c: F.coalesce(t, F.lit(False)).cast("int") for c, t in zip(PAIRS, told, strict=True)})


def consecutive_ids(events: DataFrame) -> DataFrame:
    """In physical order within an entry: pairs, numeric pairs, pairs 1 or 2 apart, pairs where one extends the other."""
    return _with_pairs(entry_identifiers(events)).groupBy(*ENTRY).agg(*[F.sum(c).alias(c) for c in PAIRS]).filter("pairs > 0")


def _null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join on keys that may be NULL; the right side's keys are dropped."""
    renamed = right.withColumnsRenamed({k: f"__{k}" for k in keys})
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
    return left.join(renamed, on, how).drop(*[f"__{k}" for k in keys])


def prior_writes(rows: DataFrame) -> DataFrame:
    """(identity, source, value, entry, has_other, written_at): whether a peer wrote an identifier under another entry too, and when first.

    Of the entries that wrote it the two earliest are enough to leave out any one; undated ones come last.
    """
    entry = F.struct("method", "host", "template", "position")
    wrote = rows.filter(F.col("method").isin(*WRITES)).groupBy("identity", "source", "value", entry.alias("entry")).agg(F.min(F.unix_micros("ts")).alias("at"))
    rank = F.struct(F.col("at").isNull().alias("undated"), "at", "entry")
    first = wrote.groupBy("identity", "source", "value").agg(F.min(rank).alias("first"))
    rest = wrote.join(first, ["identity", "source", "value"]).filter(~F.col("entry").eqNullSafe(F.col("first.entry"))).groupBy("identity", "source", "value").agg(F.min(rank).alias("second"))
    both = first.join(rest, ["identity", "source", "value"], "left")
    mine = rows.select("identity", "source", "value", entry.alias("entry")).distinct().join(both, ["identity", "source", "value"])
    other = F.when(F.col("entry").eqNullSafe(F.col("first.entry")), F.col("second")).otherwise(F.col("first"))
    return mine.select("identity", "source", "value", "entry", other.alias("other")).filter("other is not null").select("identity", "source", "value", "entry.*", F.lit(True).alias("has_other"), F.col("other.at").alias("written_at"))


def identifier_access(events: DataFrame, min_ids: int = 1) -> DataFrame:
    """Per (peer, method, host, template, position) how its identifiers were answered; requests without peer or method are left out.

    An entry's dominant size is the 2xx size that most of its identifiers got, two at least, the smallest of equals. Content
    is a 2xx of another size; an identifier without content was rejected if it got a 2xx or 400 to 599, and is redirect-only
    if it got 100 to 399 and nothing else. Content seen twice repeats, in one size only it is stable. Where a 2xx has no
    size, or no request of the entry a status, these counts are NULL. The timestamp share is the part of numeric requests
    whose identifier, as seconds or milliseconds, lies within a day of the corpus's times. written_ids were also written by
    the same peer under another entry; of those, written_before_content strictly before their first content.

    What an entry has in common comes from aggregates that are joined back, so no entry has to fit one task.
    """
    s = F.col("status")
    ok = s.between(200, 299)
    rows = written(entry_identifiers(events), "identifiers")  # read five times below
    got = {"answered": ok | s.between(400, 599), "redirected": s.between(100, 199) | s.between(300, 399), "odd": ~s.between(100, 599)}
    by_size = _with_pairs(rows).withColumn("size", F.when(ok, F.col("response_bytes"))).groupBy(*ENTRY, "value", "size").agg(
        F.count("*").alias("n"), *[F.bool_or(F.coalesce(c, F.lit(False))).alias(k) for k, c in got.items()], F.count("status").alias("known"), F.count("ts").alias("dated"),
        F.count_if(ok & F.col("response_bytes").isNull()).alias("unsized"), F.min("ts").alias("first"), F.max("ts").alias("last"), *[F.sum(c).alias(c) for c in PAIRS],
    )
    held = by_size.groupBy(*ENTRY, "size").agg(F.count("*").alias("holders"), F.sum("unsized").alias("unsized"))
    common = held.groupBy(*ENTRY).agg(F.min(F.when(F.col("size").isNotNull() & (F.col("holders") >= 2), F.struct(-F.col("holders"), "size"))).alias("most"), F.sum("unsized").alias("entry_unsized"))
    common = common.select(*ENTRY, F.when(F.col("entry_unsized") == 0, F.col("most")["size"]).alias("dominant"))
    content = F.col("size").isNotNull() & ~F.col("size").eqNullSafe(F.col("dominant"))
    ids = _null_safe(by_size, common, ENTRY).groupBy(*ENTRY, "value").agg(
        F.sum("n").alias("n"), F.count_if(content).alias("sizes"), F.sum(F.when(content, F.col("n"))).alias("content_n"), *[F.bool_or(k).alias(k) for k in got], F.sum("unsized").alias("unsized"), F.sum("dated").alias("dated"),
        F.sum("known").alias("known"), F.max("dominant").alias("dominant"), F.min("first").alias("first"), F.max("last").alias("last"), F.min(F.when(content, F.unix_micros("first"))).alias("content_at"), F.bool_or(content & (F.col("dated") < F.col("n"))).alias("content_undated"), *[F.sum(c).alias(c) for c in PAIRS],
    )
    ids = _null_safe(ids, prior_writes(rows), [*ENTRY, "value"], "left")
    corpus = F.broadcast(events.agg((F.unix_millis(F.min("ts")) - 86_400_000).alias("earliest"), (F.unix_millis(F.max("ts")) + 86_400_000).alias("latest")))  # one row
    has, number = F.col("sizes") > 0, F.when(F.col("value").rlike("^[0-9]{1,20}$"), F.col("value")).cast("decimal(24,0)")
    near = lambda v: v.between(F.col("earliest"), F.col("latest"))
    repeats = has & (F.col("content_n") >= 2)
    other = F.coalesce("has_other", F.lit(False))
    per = ids.join(corpus).groupBy(*ENTRY).agg(
        F.sum("n").alias("requests"), F.count("*").alias("ids"), F.count_if(has).alias("content_ids"), F.count_if(~has & F.col("answered")).alias("rejected_ids"),
        F.count_if(~has & ~F.col("answered") & F.col("redirected") & ~F.col("odd")).alias("redirect_only_ids"), F.count_if(repeats).alias("repeated_ids"), F.count_if(repeats & (F.col("sizes") == 1)).alias("stable_ids"),
        F.max("dominant").alias("dominant_bytes"), F.sum(F.when(number.isNotNull(), F.col("n"))).alias("numeric"), F.sum(F.when(near(number) | near(number * 1000), F.col("n")).otherwise(0)).alias("timely"),
        F.sum("known").alias("known"), F.sum("unsized").alias("unsized"), F.sum("dated").alias("dated"), F.min("first").alias("first"), F.max("last").alias("last"), F.max("earliest").alias("earliest"), *[F.sum(c).alias(c) for c in PAIRS],
        F.sum(F.when(number.isNotNull() & _unsigned("value").isNull(), F.col("n")).otherwise(0)).alias("beyond_64_bits"), F.count_if(other).alias("written_ids"), F.count_if(other & has & ~F.col("content_undated") & (F.col("written_at") < F.col("content_at"))).alias("written_before_content"),
    )
    measured = (F.col("unsized") == 0) & (F.col("known") > 0)
    counts = [F.when(measured, F.col(c)).alias(c) for c in ("content_ids", "rejected_ids", "redirect_only_ids", "repeated_ids", "stable_ids", "written_before_content")]
    answered = F.col("content_ids") + F.col("rejected_ids")
    before = F.when(F.col("position").startswith("path:"), F.slice(F.split("template", "/"), F.lit(1), F.substring("position", 6, 10).cast("int"))).otherwise(F.split("template", "/"))
    itself = F.try_element_at(F.filter(before, lambda x: F.lower(x).isin(*SELF)), F.lit(-1))
    return per.filter(F.col("ids") >= min_ids).select(
        *ENTRY, "requests", "ids", *counts, "written_ids", F.when(measured & (answered > 0), F.col("rejected_ids") / answered).alias("rejected_share"), "dominant_bytes", F.col("unsized").alias("ok_without_bytes"),
        (F.col("requests") - F.col("known")).alias("without_status"), (F.col("requests") - F.col("dated")).alias("undated"), F.when(F.col("earliest").isNotNull() & (F.col("numeric") > 0), F.col("timely") / F.col("numeric")).alias("timestamp_share"), *PAIRS, "beyond_64_bits",
        W.share(F.col("adjacent_pairs"), F.col("numeric_pairs"), None).alias("adjacent_share"), W.share(F.col("prefix_pairs"), F.col("pairs"), None).alias("prefix_share"), itself.alias("self_reference"), W.epoch(F.col("first")).alias("first_seen"), W.epoch(F.col("last")).alias("last_seen"),
    )


def writes_before_read(events: DataFrame, writes: tuple[str, ...] = WRITES) -> DataFrame:
    """Per (peer, id): earliest write under another entry, strictly before the first content response under this one."""
    rows = identifiers(events).filter("source_ip is not null and ts is not null").withColumns({"entry": F.concat_ws("|", "template", "position"), "at": F.unix_micros("ts")})
    reads = rows.filter(F.col("status").between(200, 299) & ~F.col("method").isin(*writes)).groupBy("source_ip", "value", "entry").agg(F.min("at").alias("read_at"))
    wrote = rows.filter(F.col("method").isin(*writes)).groupBy("source_ip", "value", F.col("entry").alias("write_entry")).agg(F.min("at").alias("write_at"))
    both = reads.join(wrote, ["source_ip", "value"]).filter("entry != write_entry and write_at < read_at")
    return both.groupBy("source_ip", "value", "entry").agg(F.min("write_at").alias("write_at"), F.first("read_at").alias("read_at"))


def request_features(events: DataFrame) -> DataFrame:
    """(feature, part) of every request whose spelling is unusual, its request line included where the events have one."""
    line = F.col("request_line") if "request_line" in events.columns else None
    # Outer, as the optimizer would test the array of an inner explode before it, by working the features out once more.
    found = events.select("*", F.explode_outer(features(F.col("uri_path"), F.col("uri_query"), line)).alias("__x")).filter("__x is not null")
    return found.select(*events.columns, F.col("__x.feature").alias("feature"), F.col("__x.part").alias("part"))


def request_anomalies(events: DataFrame) -> DataFrame:
    """Per feature: requests, peers, paths, first and last time, successes; a request counts once a feature."""
    at = W.epoch(F.col("ts"))
    rows = request_features(events).dropDuplicates(["event_id", "feature"])
    return rows.groupBy("feature").agg(F.count("*").alias("requests"), F.countDistinct("source_ip").alias("peers"), F.countDistinct("uri_path").alias("paths"), F.min(at).alias("first_seen"), F.max(at).alias("last_seen"), F.count_if(F.col("status").between(200, 299)).alias("ok"))


def anomaly_sources(events: DataFrame) -> DataFrame:
    rows = request_features(events).filter("source_ip is not null")
    return rows.groupBy("source_ip").agg(F.countDistinct("event_id").alias("requests_with_features"), F.countDistinct("feature").alias("features")).orderBy(F.desc("requests_with_features"), "source_ip")


def _read_texts(events: DataFrame) -> tuple[Column, Column, Column]:
    """(target, body, whether a read can be in them): the target is ``uri`` where the events have it, else put together."""
    none = F.lit(None).cast("string")
    has = lambda c: F.col(c) if c in events.columns else none
    after = lambda mark, c: F.coalesce(F.concat(F.lit(mark), has(c)), F.lit(""))
    target, body = F.coalesce(has("uri"), F.concat("uri_path", after("?", "uri_query"), after("#", "uri_fragment"))), has("request_body")
    return target, body, F.coalesce(may_hold_expression(target), F.lit(False)) | F.coalesce(may_hold_expression(body), F.lit(False))


def sql_reads(events: DataFrame) -> DataFrame:
    """Requests that may have a read by size or by character, with it in a struct ``read`` (see ``read_request``) and their ``peer``.

    ``peer`` is (identity, source): the validated client, else the observed peer, in canonical spelling. Requests that can't
    have one are left out before any text is decoded: a Python function is run on every row that reaches its plan.
    """
    target, body, possible = _read_texts(events)
    content_type = F.col("content_type") if "content_type" in events.columns else F.lit(None).cast("string")
    # Nondeterministic only so that filters on the result don't run the function a second time.
    return events.filter(possible).withColumn("read", sql_read.asNondeterministic()(target, body, content_type)).withColumn("peer", peer_key(events.columns))


def _complete(reads: DataFrame, kind: str) -> DataFrame:
    needed = " and ".join(f"{c} is not null" for c in ("peer", "method", "uri_path", "status", "response_bytes", "ts"))
    return reads.filter((F.col("read.kind") == kind) & F.expr(needed))


def read_outcomes(events: DataFrame) -> DataFrame:
    """Requests by what became of them: size, character, incomplete (a field is missing), multiple, undecodable, none."""
    reads = sql_reads(events)
    whole = F.expr(" and ".join(f"{c} is not null" for c in ("peer", "method", "uri_path", "status", "response_bytes", "ts")))
    kind = F.coalesce("read.kind", F.lit("none"))
    told = reads.select(F.when(kind.isin("size", "character") & ~whole, "incomplete").otherwise(kind).alias("kind"))
    without = events.filter(~_read_texts(events)[2]).select(F.lit("none").alias("kind"))
    return told.unionByName(without).groupBy("kind").agg(F.count("*").alias("requests"))


SIZE_GROUP = ["host", "identity", "source", "method", "path", "status", "target_shape", "body_shape", "multiplier"]


def response_size_pairs(events: DataFrame) -> DataFrame:
    """Reads of CAST((expression) AS CHAR), also inside HEX(..), against a constant control of the same group.

    A group is host, peer, method, path, status, the decoded target and body without the expression, and the multiplier: 2
    inside HEX, else 1. Its earliest constant (time, then physical order) is the control, every other row a read, constants
    too. The length that a read fits is (response difference - request difference) / multiplier + the control's length.
    Requests with several reads, or that lack a field, are left out. Lengths are told, never content.
    """
    reads = _complete(sql_reads(events), "size").select("event_id", "host", "peer.*", "method", F.lower("uri_path").alias("path"), "status", "read.*", "response_bytes", "ts").drop("kind", "position")
    order = F.struct("ts", "event_id")
    control = reads.filter("constant is not null").groupBy(*SIZE_GROUP).agg(F.min_by(F.struct("response_bytes", "request_bytes", "constant", "event_id", "ts"), order).alias("control"))
    on = reduce(lambda a, b: a & b, [F.col(f"r.{c}").eqNullSafe(F.col(f"c.{c}")) for c in SIZE_GROUP])
    pairs = reads.alias("r").join(control.alias("c"), on).filter("r.event_id != control.event_id").select("r.*", "control")
    pairs = pairs.withColumns({"more": F.col("response_bytes") - F.col("control.response_bytes"), "asked": F.col("request_bytes") - F.col("control.request_bytes")})
    rest = F.col("more") - F.col("asked")
    length = F.when(F.pmod(rest, "multiplier") == 0, F.expr("(more - asked) div multiplier") + F.col("control.constant"))
    outcome = F.when(F.col("length").isNull(), "not_fitting").when(F.col("length") < 0, "negative_estimate").when(F.col("length") == 0, "empty_or_null").otherwise("length")
    return pairs.select("event_id", *SIZE_GROUP, "expression", "ts", F.col("control.ts").alias("control_ts"), F.col("control.constant").alias("control_length"), "more", "asked", length.alias("length")).withColumn("outcome", outcome)


def paired_expressions(pairs: DataFrame) -> DataFrame:
    """Per (host, expression): reads, sources, distinct lengths and the longest, the other outcomes, first and last time."""
    at, is_length = W.epoch(F.col("ts")), F.col("outcome") == "length"
    count = lambda name: F.count_if(F.col("outcome") == name).alias(name)
    return pairs.groupBy("host", "expression").agg(
        F.count("*").alias("requests"), F.countDistinct("identity", "source").alias("sources"), F.countDistinct(F.when(is_length, F.col("length"))).alias("lengths"), F.max(F.when(is_length, F.col("length"))).alias("longest"),
        count("negative_estimate"), count("empty_or_null"), count("not_fitting"), F.min(at).alias("first_seen"), F.max(at).alias("last_seen"),
    )


def host_fit(pairs: DataFrame) -> DataFrame:
    """Per host: reads of multiplier 2 whose difference is even (fitting) or odd, their rate, and reads that parity can't check."""
    two, fits = F.col("multiplier") == 2, F.col("outcome") != "not_fitting"
    per = pairs.groupBy("host").agg(F.count_if(two & fits).alias("fitting"), F.count_if(two & ~fits).alias("not_fitting"), F.count_if(~two).alias("parity_unchecked"))
    return per.withColumn("fit_rate", W.share(F.col("fitting"), F.col("fitting") + F.col("not_fitting"), None))


def bot_range_check(events: DataFrame, operators: DataFrame) -> DataFrame:
    """Per operator: requests that declare it in the user agent, inside and outside its published v4 networks, outside share (NULL without ranges).

    operators: operator_id, pattern, network (NULL where none is known), one row a combination.
    """
    from trailwork.functions.network import longest_prefix

    agents = events.select("user_agent").filter("user_agent is not null").distinct()
    patterns = operators.select("operator_id", "pattern").distinct()
    # A pattern begins with one of a few pieces: agents are cut at every place where such a piece stands and joined on the cut.
    lengths = [r.n for r in patterns.select(F.length("pattern").alias("n")).distinct().collect()]  # a handful of lengths
    pieces = F.flatten(F.array(*[F.transform(F.sequence(F.lit(1), F.greatest(F.length("user_agent") - (n - 1), F.lit(1))), lambda i: F.substring("user_agent", i, F.lit(n))) for n in lengths])) if lengths else F.array().cast("array<string>")
    declared = agents.select("user_agent", F.explode(F.array_distinct(pieces)).alias("pattern")).join(small(patterns), "pattern").select("user_agent", "operator_id").distinct()
    rows = events.select("event_id", "user_agent", "source_ip").join(declared, "user_agent")
    inside = longest_prefix(events.select(F.col("source_ip").alias("ip")), operators.filter("network is not null").select("operator_id", "network").distinct()).select(F.col("ip").alias("source_ip"), "operator_id").distinct().withColumn("inside", F.lit(True))
    known = operators.groupBy("operator_id").agg(F.count("network").alias("networks"))
    per = rows.join(inside, ["source_ip", "operator_id"], "left").groupBy("operator_id").agg(F.count("*").alias("declared"), F.count("inside").alias("inside"), F.countDistinct("source_ip").alias("peers"), F.countDistinct(F.when(F.col("inside").isNull(), F.col("source_ip"))).alias("outside_peers"))
    out = per.join(small(known), "operator_id")
    has = F.col("networks") > 0
    return out.select("operator_id", "declared", F.when(has, F.col("inside")).alias("inside"), F.when(has, F.col("declared") - F.col("inside")).alias("outside"), "peers", F.when(has, F.col("outside_peers")).alias("outside_peers"), F.when(has, W.share(F.col("declared") - F.col("inside"), F.col("declared"), None)).alias("outside_share"))


def browser_family(agent: Column) -> Column:
    return F.when(agent.contains("Firefox/"), "firefox").when(agent.contains("Chrome/") | agent.contains("Chromium/"), "chromium").when(agent.contains("Safari/"), "safari")


def consistency(events: DataFrame, families: DataFrame) -> DataFrame:
    """Declared browser family against the families a fingerprint is known for: match, mismatch or unavailable with its reason.

    families: ja4, family. Where nothing of the log source has a fingerprint its telemetry doesn't expose one; otherwise
    without a fingerprint the observed value is missing. An unlisted fingerprint lacks reference data.
    """
    f = families.select(F.col("ja4").alias("__ja4"), "family").distinct()
    known = f.groupBy("__ja4").agg(F.collect_set("family").alias("families"))
    source = F.col("log_source") if "log_source" in events.columns else F.lit("log")
    exposed = events.groupBy(source.alias("__source")).agg((F.count("ja4") > 0).alias("exposed"))  # one row a log source
    rows = events.withColumn("declared", browser_family(F.col("user_agent"))).filter("declared is not null").join(small(known), F.col("ja4") == F.col("__ja4"), "left").join(small(exposed), source.eqNullSafe(F.col("__source")))
    outcome = F.when(F.col("ja4").isNull() | F.col("families").isNull(), "unavailable").when(F.array_contains("families", F.col("declared")), "match").otherwise("mismatch")
    reason = F.when(~F.col("exposed"), "telemetry_does_not_expose").when(F.col("ja4").isNull(), "observed_value_missing").when(F.col("families").isNull(), "reference_data_missing")
    return rows.groupBy("declared", outcome.alias("outcome"), reason.alias("reason")).agg(F.count("*").alias("requests"), F.countDistinct("source_ip").alias("peers"))


def unserved_paths(events: DataFrame) -> DataFrame:
    """(source_ip, uri_path) that a source asked for and nobody got a 2xx for."""
    asked = events.filter("source_ip is not null and uri_path is not null").select("source_ip", "uri_path").distinct()
    served = events.filter(F.col("status").between(200, 299) & F.col("uri_path").isNotNull()).select("uri_path").distinct()
    return asked.join(served, "uri_path", "left_anti")


def character_reads(events: DataFrame) -> DataFrame:
    """Requests whose decoded target and body have exactly one ascii(substr((select ...), position, 1)), with expression and position.

    ord, substring and mid count too, and spaces and case don't matter. Requests with another read beside it, or that lack a
    peer, method, path, status, size or time, are left out.
    """
    return _complete(sql_reads(events), "character").select(*events.columns, "peer", "read.expression", "read.position")


def char_position_reads(events: DataFrame) -> DataFrame:
    """Per (host, expression): reads of character positions, distinct ones, the last, sources, first and last time."""
    at = W.epoch(F.col("ts"))
    return character_reads(events).groupBy("host", "expression").agg(F.count("*").alias("reads"), F.countDistinct("position").alias("positions"), F.max("position").alias("last_position"), F.countDistinct("peer").alias("sources"), F.min(at).alias("first_seen"), F.max(at).alias("last_seen"))


def char_position_sizes(events: DataFrame, most: int = 3) -> DataFrame:
    """The commonest response sizes of each (host, expression, status), ties by size; a report of the first ``most``."""
    sizes = character_reads(events).groupBy("host", "expression", "status", "response_bytes").agg(F.count("*").alias("requests"))
    rank = F.row_number().over(Window.partitionBy("host", "expression", "status").orderBy(F.desc("requests"), "response_bytes"))
    return sizes.withColumn("rank", rank).filter(F.col("rank") <= most)
