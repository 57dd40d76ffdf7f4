"""Comparison of runs, trends, reference data, stores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trailwork.functions import network as N
from trailwork.functions import web as W
from trailwork.operators.ordering import numbered


def asn_lookup(ips: DataFrame, networks: DataFrame) -> DataFrame:
    """(ip, asn, prefix_len): longest prefix that holds each distinct address. networks: network, asn."""
    return N.longest_prefix(ips, networks).groupBy("ip").agg(F.max_by("asn", F.struct("prefix_len", "asn")).alias("asn"), F.max("prefix_len").alias("prefix_len"))


def range_lookup(ips: DataFrame, ranges: DataFrame) -> DataFrame:
    """(ip, asn) from non-overlapping v4 ranges (start_ip, end_ip, asn), as an as-of match within each /8 that a range touches."""
    r = ranges.select(N.v4_number(F.col("start_ip")).alias("lo"), N.v4_number(F.col("end_ip")).alias("hi"), "asn")
    r = r.select("lo", "hi", "asn", F.explode(F.sequence(F.shiftright("lo", 24), F.shiftright("hi", 24))).alias("octet"))
    starts = r.select("octet", F.greatest("lo", F.expr("shiftleft(octet, 24)")).alias("at"), F.struct("hi", "asn").alias("range"), F.lit(None).cast("string").alias("ip"))
    asked = ips.select("ip").distinct().withColumn("at", N.v4_number(F.col("ip"))).filter("at is not null").withColumn("octet", F.shiftright("at", 24))
    rows = starts.unionByName(asked.select("octet", "at", F.lit(None).cast("struct<hi:bigint,asn:bigint>").alias("range"), "ip"))
    w = Window.partitionBy("octet").orderBy("at", F.col("ip").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("found", F.last("range", ignorenulls=True).over(w)).filter("ip is not null and found.hi >= at").select("ip", F.col("found.asn").alias("asn"))


def range_overlaps(ranges: DataFrame) -> DataFrame:
    """Ranges that begin before an earlier one ends."""
    r = ranges.select("start_ip", "end_ip", N.v4_number(F.col("start_ip")).alias("lo"), N.v4_number(F.col("end_ip")).alias("hi"))
    w = Window.partitionBy(F.shiftright("lo", 24)).orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, -1)
    return r.withColumn("before", F.max("hi").over(w)).filter("before >= lo").select("start_ip", "end_ip")


def reputation_lookup(ips: DataFrame, reputation: DataFrame, asn: DataFrame) -> DataFrame:
    """(ip, hits, scope, score, tier): the largest score of the most specific scope (ip, cidr, asn). asn: (ip, asn)."""
    base = ips.select("ip").filter("ip is not null").distinct()
    # Addresses are compared in canonical spelling, both in the table and in what is asked.
    named = reputation.filter("scope = 'ip'").select(N.canonical_or_raw(F.col("value")).alias("__ip"), "score")
    by_ip = base.withColumn("__ip", N.canonical_or_raw(F.col("ip"))).join(named, "__ip").select("ip", "score").withColumn("rank", F.lit(1))
    nets = reputation.filter("scope = 'cidr'").select(F.col("value").alias("network"), "score")
    by_net = N.longest_prefix(base, nets).select("ip", "score").withColumn("rank", F.lit(2))
    by_asn = base.join(asn.select("ip", "asn"), "ip").join(reputation.filter("scope = 'asn'").select(F.col("value").alias("asn_text"), "score"), F.col("asn").cast("string") == F.col("asn_text")).select("ip", "score").withColumn("rank", F.lit(3))
    hits = by_ip.unionByName(by_net).unionByName(by_asn)
    per = hits.groupBy("ip").agg(F.count("*").alias("hits"), F.min("rank").alias("rank"), F.max_by("score", F.struct(-F.col("rank"), "score")).alias("score"))
    tier = F.when(F.col("score") >= 75, "high").when(F.col("score") >= 50, "medium").when(F.col("score") >= 25, "low").otherwise("info")
    return per.select("ip", "hits", F.get(F.array(F.lit("ip"), F.lit("cidr"), F.lit("asn")), F.col("rank") - 1).alias("scope"), "score", tier.alias("tier"))


def first_seen(current: DataFrame, baseline: DataFrame, key: str) -> DataFrame:
    """Values of the current run that the baseline lacks; addresses are compared in canonical spelling and shown in their smallest."""
    same = N.canonical_or_raw(F.col(key)) if key.endswith("ip") else F.col(key)
    now = current.filter(F.col(key).isNotNull()).groupBy(same.alias("value")).agg(F.min(key).alias(key), F.count("*").alias("requests"))
    old = baseline.filter(F.col(key).isNotNull()).select(same.alias("value")).distinct()
    return now.join(old, "value", "left_anti").select(key, "requests")


def cve_diff(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """(cve, baseline, current, state, delta): new, disappeared or common. Both have cve and requests."""
    both = baseline.select("cve", F.col("requests").alias("baseline")).join(current.select("cve", F.col("requests").alias("current")), "cve", "full")
    state = F.when(F.col("baseline").isNull(), "new").when(F.col("current").isNull(), "disappeared").otherwise("common")
    return both.withColumns({"state": state, "delta": F.coalesce("current", F.lit(0)) - F.coalesce("baseline", F.lit(0))}).fillna(0, ["baseline", "current"])


def volume_delta(baseline: DataFrame, current: DataFrame, key: str, low: int = 30, elevated: float = 3.0) -> DataFrame:
    """Ratio of each current key's requests to the baseline: new, low-baseline, elevated or unchanged."""
    both = current.select(key, F.col("requests").alias("current")).join(baseline.select(key, F.col("requests").alias("baseline")), key, "left")
    ratio = W.share(F.col("current"), F.col("baseline"), None)
    label = F.when(F.col("baseline").isNull(), "new").when(F.col("baseline") < low, "low-baseline").when(ratio >= elevated, "elevated").otherwise("unchanged")
    return both.withColumns({"ratio": ratio, "label": label})


def unpivot_metrics(summary: DataFrame) -> DataFrame:
    return summary.unpivot([], summary.columns, "metric", "value") if len({t for _, t in summary.dtypes}) == 1 else summary.select([F.col(c).cast("double") for c in summary.columns]).unpivot([], summary.columns, "metric", "value")


def daily_comparison(baseline: DataFrame, current: DataFrame, points: dict[str, float]) -> DataFrame:
    """Per metric: baseline, current, delta, ratio (NULL on 0), and whether the relative change reaches the operator's point."""
    b, c = unpivot_metrics(baseline).withColumnRenamed("value", "baseline"), unpivot_metrics(current).withColumnRenamed("value", "current")
    both = b.join(c, "metric", "full")
    point = F.create_map(*[F.lit(x) for k, v in points.items() for x in (k, float(v))])[F.col("metric")] if points else F.lit(None).cast("double")
    ratio = W.share(F.col("current"), F.col("baseline"), None)
    return both.withColumns({"delta": F.col("current") - F.col("baseline"), "ratio": ratio}).withColumn("crossed", F.abs(F.col("ratio") - 1) >= point)


def reference_distribution(runs: DataFrame, current: DataFrame) -> DataFrame:
    """Per metric over reference runs (run_id, metric, value): least, median, most; current's delta and ratio to the median."""
    ref = runs.groupBy("metric").agg(F.count("*").alias("runs"), F.min("value").alias("least"), F.expr("percentile(value, 0.5)").alias("median"), F.max("value").alias("most"))
    return ref.join(current.select("metric", "value"), "metric").withColumns({"delta": F.col("value") - F.col("median"), "ratio": W.share(F.col("value"), F.col("median"), None)})


def condition_diff(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """Recorded settings (name, value) that changed or are missing on one side; values compared and shown as SHA-256."""
    b = baseline.select("name", F.sha2("value", 256).alias("baseline"))
    c = current.select("name", F.sha2("value", 256).alias("current"))
    both = b.join(c, "name", "full")
    return both.filter(~F.col("baseline").eqNullSafe(F.col("current"))).withColumn("state", F.when(F.col("baseline").isNull() | F.col("current").isNull(), "unavailable").otherwise("changed"))


def comparability(baseline: DataFrame, current: DataFrame, key: str = "pair") -> DataFrame:
    """Per pair of runs: whether they compare, how (kind), and why not (reasons, joined by "; ").

    Both have a row a pair: key, profile, triage_policy, rules_revision, filter_from, filter_to, NULL where it wasn't recorded.
    Runs of unlike or unknown profile or policy don't compare. Otherwise they differ in the rules alone (cti-revision), in
    the time range alone (calendar-window), or are set side by side as they are (artifact-diff).
    """
    names = ("profile", "triage_policy", "rules_revision", "filter_from", "filter_to")
    both = baseline.select(key, *[F.col(c).alias(f"b_{c}") for c in names]).join(current.select(key, *names), key)
    same = lambda c: F.col(c).eqNullSafe(F.col(f"b_{c}"))
    missing = lambda c: F.col(c).isNull() | F.col(f"b_{c}").isNull()
    why = [F.when(test, F.lit(text)) for c in ("profile", "triage_policy") for test, text in ((missing(c), f"{c} is unavailable for one or both runs"), (~same(c), f"{c} differs"))]
    range_same = same("filter_from") & same("filter_to")
    reasons = F.array_compact(F.array(*why))
    kind = F.when(F.size(reasons) > 0, "not-comparable").when(range_same & ~same("rules_revision"), "cti-revision").when(same("rules_revision") & ~range_same, "calendar-window").otherwise("artifact-diff")
    return both.select(key, (F.size(reasons) == 0).alias("comparable"), kind.alias("kind"), F.array_join(reasons, "; ").alias("reasons"))


#: Measures of a day that are shares of all its requests.
DAILY_SHARES = {"success_share": (200, 299), "client_closed_share": (499, 499), "server_error_share": (500, 599)}


def daily_measures(events: DataFrame) -> DataFrame:
    """(metric, value, reason) of a run: eight measures; a NULL value has its reason.

    Each run has its own top path, the smallest of those asked most. Status shares are over all requests, and unavailable
    where no request has a status.
    """
    n = events.agg(F.count("*").alias("requests"), F.countDistinct("source_ip").alias("peers"), F.count("status").alias("known"), *[F.count_if(F.col("status").between(*r)).alias(c) for c, r in DAILY_SHARES.items()])
    paths = events.filter("uri_path is not null").groupBy("uri_path").agg(F.count("*").alias("n"), F.countDistinct("source_ip").alias("p"))
    top = paths.agg(F.min_by(F.struct("n", "p"), F.struct(-F.col("n"), "uri_path")).alias("top"))
    row = n.join(F.broadcast(top.select("top.*")))  # one row each
    value = lambda name, v, reason=None: F.struct(F.lit(name).alias("metric"), v.cast("double").alias("value"), F.when(v.isNull(), F.lit(reason)).alias("reason"))
    part = lambda a, b: W.share(F.col(a), F.col(b), None)
    measures = [
        value("total_requests", F.col("requests")), value("distinct_sources", F.col("peers")), value("top_path_share", part("n", "requests"), "no request has a path"), value("top_path_requests_per_source", part("n", "p"), "the top path has no source"),
        value("requests_per_source", part("requests", "peers"), "no request has a source"), *[value(c, F.when(F.col("known") > 0, part(c, "requests")), "no request has a status") for c in DAILY_SHARES],
    ]
    return row.select(F.inline(F.array(*measures)))


def compare_days(baseline: DataFrame, current: DataFrame, points: list[tuple[str, str, str, float]] = ()) -> DataFrame:
    """Per metric of two ``daily_measures``: baseline, current, delta, ratio, reasons of what is unavailable, and the point.

    points: (metric, delta or ratio, at-least or at-most, value). crossed is NULL without a point and where its value is
    unavailable.
    """
    b, c = (x.select("metric", F.col("value").alias(v), F.col("reason").alias(f"{v}_reason")) for x, v in ((baseline, "baseline"), (current, "current")))
    both = b.join(c, "metric", "full")
    side = lambda v: F.when(F.col(v).isNull(), F.concat(F.lit(f"{v}: "), F.coalesce(f"{v}_reason", F.lit("not measured"))))
    reasons = F.array_compact(F.array(side("baseline"), side("current"), F.when(F.col("baseline") == 0, "ratio: the baseline is zero")))
    out = both.select("metric", "baseline", "current", (F.col("current") - F.col("baseline")).alias("delta"), W.share(F.col("current"), F.col("baseline"), None).alias("ratio"), F.array_join(reasons, "; ").alias("reasons"))
    crossed = F.lit(None).cast("boolean")
    for metric, basis, relation, value in points:
        reached = F.col(basis) >= value if relation == "at-least" else F.col(basis) <= value
        crossed = F.when(F.col("metric") == metric, reached).otherwise(crossed)
    return out.withColumn("crossed", crossed)


def path_counts(runs: DataFrame) -> DataFrame:
    return runs.filter("uri_path is not null").groupBy("run_id", "uri_path").agg(F.count("*").alias("requests"))


def path_rank(runs: DataFrame) -> DataFrame:
    """(run_id, uri_path, requests, rank): 1 + paths with more requests, ties by path.

    All runs' paths are sorted by range together; a run's places begin after those of the runs before it.
    """
    placed = numbered(path_counts(runs).select("run_id", "uri_path", "requests"), ["run_id", F.desc("requests"), "uri_path"])
    first = placed.groupBy("run_id").agg(F.min("place").alias("first"))  # one row a run
    return placed.join(F.broadcast(first), "run_id").select("run_id", "uri_path", "requests", (F.col("place") - F.col("first") + 1).alias("rank"))


def path_trend(runs: DataFrame, path: str) -> DataFrame:
    """Per run: a path's requests, share, rank and ratio to the run before; NULL where it doesn't occur. The rank is a count, nothing is sorted."""
    totals = runs.groupBy("run_id").agg(F.count("*").alias("all_requests"), F.sum(F.when(F.col("uri_path") == path, 1)).alias("requests"))
    more = (F.col("n") > F.col("requests")) | ((F.col("n") == F.col("requests")) & (F.col("uri_path") < path))
    rank = path_counts(runs).withColumnRenamed("requests", "n").join(F.broadcast(totals), "run_id").groupBy("run_id").agg((F.count_if(more) + 1).alias("place"))  # one row a run
    out = totals.join(rank, "run_id", "left").withColumn("rank", F.when(F.col("requests").isNotNull(), F.col("place")))
    before = F.lag("requests").over(Window.orderBy("run_id"))  # one row a run
    return out.select("run_id", "requests", F.when(F.col("requests").isNotNull(), W.share(F.col("requests"), F.col("all_requests"))).alias("share"), "rank", W.share(F.col("requests"), before, None).alias("ratio"))


def latest_per_key(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last entry of each key, as an aggregate."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("x")).select(*keys, "x.*")


def apply_dispositions(findings: DataFrame, store: DataFrame) -> DataFrame:
    """Findings with their disposition: equal source, template, METHOD and path, null-safe query and corpus scope; no fallback across them.

    A table without a column corpus_scope has the scope NULL, so an opinion on one corpus says nothing on another.
    """
    scoped = lambda df: df if "corpus_scope" in df.columns else df.withColumn("corpus_scope", F.lit(None).cast("string"))
    keys = ["source_ip", "template_id", "method", "uri_path", "uri_query", "corpus_scope"]
    upper = scoped(store).withColumn("method", F.upper("method"))
    s = latest_per_key(upper, keys, "recorded_at").select(*[F.col(c).alias(f"s_{c}") for c in keys], "disposition", "review_after")
    on = (F.col("source_ip") == F.col("s_source_ip")) & (F.col("template_id") == F.col("s_template_id")) & (F.upper("method") == F.col("s_method")) & (F.col("uri_path") == F.col("s_uri_path")) & F.col("uri_query").eqNullSafe(F.col("s_uri_query")) & F.col("__scope").eqNullSafe(F.col("s_corpus_scope"))
    return scoped(findings).withColumn("__scope", F.col("corpus_scope")).join(s, on, "left").select(*findings.columns, "disposition", "review_after")


def disposition_counts(findings: DataFrame, store: DataFrame, at) -> DataFrame:
    f = apply_dispositions(findings, store)
    return f.agg(F.count("*").alias("findings"), F.count("disposition").alias("reviewed"), F.count_if(F.col("disposition") == "expected").alias("expected"), F.count_if(F.col("disposition") == "needs-review").alias("needs_review"), F.count_if(F.col("disposition").isNull()).alias("unclassified"), F.count_if(F.col("review_after") <= F.lit(at).cast("timestamp")).alias("due"))


def observations(events: DataFrame, bits: int = 24, asn: DataFrame | None = None) -> DataFrame:
    """What a run adds to the store: (run_id, entity, first_minute, last_minute) of each block, v6 ones of 48 bits, and with ``asn`` (ip, asn) of each network AS<n>."""
    minute = F.floor(W.epoch(F.col("ts")) / 60)
    e = events.withColumn("entity", N.block(F.col("source_ip"), bits)).filter("entity is not null").select("run_id", "ts", "source_ip", "entity")
    if asn is not None:
        known = asn.select(N.canonical_ip(F.col("ip")).alias("__ip"), "asn").groupBy("__ip").agg(F.concat(F.lit("AS"), F.max("asn")).alias("network"))
        named = e.withColumn("__ip", N.canonical_ip(F.col("source_ip"))).join(known, "__ip", "left")
        e = named.select("run_id", "ts", F.explode(F.array_compact(F.array("entity", "network"))).alias("entity"))
    return e.groupBy("run_id", "entity").agg(F.min(minute).alias("first_minute"), F.max(minute).alias("last_minute"))


def update_observation_store(store: DataFrame, run: DataFrame) -> DataFrame:
    """Rows to append: those of runs that the store doesn't hold."""
    return run.join(store.select("run_id").distinct(), "run_id", "left_anti")


def read_observation_store(store: DataFrame) -> DataFrame:
    return store.groupBy("entity").agg(F.min("first_minute").alias("first_minute"), F.max("last_minute").alias("last_minute"), F.countDistinct("run_id").alias("runs"))


def shared_input_files(files: DataFrame) -> DataFrame:
    """Files (cohort, path, sha256) whose bytes also occur in another cohort."""
    both = files.groupBy("sha256").agg(F.countDistinct("cohort").alias("n")).filter("n > 1").drop("n")
    return files.join(both, "sha256", "left_semi")


def kev_coverage(kev: DataFrame, templates: DataFrame) -> DataFrame:
    """Per known CVE: templates, whether any is observable in requests, best conversion state."""
    t = templates.select(F.explode("cves").alias("cve"), "template_id", "detectability", "conversion_status", "validation_status")
    k = kev.select(F.upper(F.trim("cve_id")).alias("cve")).distinct()
    j = k.join(t, "cve", "left")
    per = j.groupBy("cve").agg(F.count("template_id").alias("templates"), F.max(F.coalesce((F.col("detectability") == "observable").cast("int"), F.lit(0))).alias("o"), F.max(F.coalesce((F.col("conversion_status") == "converted").cast("int"), F.lit(0))).alias("c"), F.max(F.coalesce((F.col("validation_status") == "passed").cast("int"), F.lit(0))).alias("v"))
    state = F.when(F.col("templates") == 0, "no-template").when(F.col("v") == 1, "validated").when(F.col("c") == 1, "converted").when(F.col("o") == 1, "observable").otherwise("not-observable")
    return per.select("cve", "templates", (F.col("o") == 1).alias("web_relevant"), state.alias("state"))


def template_coverage(templates: DataFrame) -> DataFrame:
    return templates.groupBy("detectability", "conversion_status").agg(F.count("*").alias("templates"), F.count_if(F.size("cves") > 0).alias("with_cve"))


def template_reasons(templates: DataFrame) -> DataFrame:
    """Templates by why they aren't observable or convertible; one of several reasons counts in each."""
    return templates.select("template_id", F.explode(F.array_distinct("reasons")).alias("reason")).groupBy("reason").agg(F.count("*").alias("templates"))


def header_coverage(templates: DataFrame, kev: DataFrame, headers: list[str]) -> DataFrame:
    """One row: templates, CVEs and KEVs in all, and those observable where these headers are logged (compared without case)."""
    logged = F.array(*[F.lit(h.lower()) for h in headers]).cast("array<string>")
    seen = F.size(F.array_except(F.transform(F.coalesce("required_headers", F.array().cast("array<string>")), F.lower), logged)) == 0
    k = kev.select(F.upper(F.trim("cve_id")).alias("cve")).distinct().withColumn("kev", F.lit(True))
    rows = templates.select("template_id", "cves", seen.alias("seen"))
    per = rows.agg(F.countDistinct("template_id").alias("templates"), F.countDistinct(F.when(F.col("seen"), F.col("template_id"))).alias("observable"))
    cves = rows.select(F.explode("cves").alias("cve"), "seen").groupBy("cve").agg(F.bool_or("seen").alias("seen")).join(k, "cve", "left")
    return per.join(F.broadcast(cves.agg(F.count("*").alias("cves"), F.count_if("seen").alias("observable_cves"), F.count("kev").alias("kevs"), F.count_if(F.col("seen") & F.col("kev").isNotNull()).alias("observable_kevs"))))


def telemetry_coverage(templates: DataFrame, profiles: DataFrame) -> DataFrame:
    """Per profile (profile, headers): templates whose required headers it records. The profiles are a handful of fixed rows."""
    rows = templates.select("template_id", "required_headers").join(F.broadcast(profiles))
    seen = F.size(F.array_except("required_headers", "headers")) == 0
    return rows.groupBy("profile").agg(F.count("*").alias("templates"), F.count_if(seen).alias("observable"))


def header_value_ranking(templates: DataFrame, kev: DataFrame) -> DataFrame:
    """Per header: templates, CVEs and KEVs that need it, and templates it makes observable when logged alone."""
    h = templates.select("template_id", "cves", "required_headers", F.explode("required_headers").alias("header"))
    k = kev.select(F.upper(F.trim("cve_id")).alias("cve")).distinct().withColumn("kev", F.lit(True))
    per = h.groupBy("header").agg(F.countDistinct("template_id").alias("templates"), F.countDistinct(F.when(F.size("required_headers") == 1, F.col("template_id"))).alias("alone"))
    cves = h.select("header", F.explode("cves").alias("cve")).distinct().join(k, "cve", "left").groupBy("header").agg(F.count("*").alias("cves"), F.count("kev").alias("kevs"))
    return per.join(cves, "header", "left").fillna(0, ["cves", "kevs"])


def entity_difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).filter(F.col(key).isNotNull()).subtract(b.select(key))


def record_dispositions(store: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows to append: those that don't repeat the last entry of their key."""
    last = latest_per_key(store, keys, "recorded_at").select(*[F.col(c).alias(f"s_{c}") for c in (*keys, "disposition")])
    on = F.col("disposition") == F.col("s_disposition")
    for c in keys:
        on &= F.col(c).eqNullSafe(F.col(f"s_{c}"))
    return new.join(last, on, "left_anti")


def compact_store(store: DataFrame) -> DataFrame:
    """One row for each (run_id, entity), whatever was appended."""
    return store.groupBy("run_id", "entity").agg(F.min("first_minute").alias("first_minute"), F.max("last_minute").alias("last_minute"))


def baseline_latest(runs: DataFrame) -> DataFrame:
    """(run_id, baseline): the newest earlier run of each, by sortable name."""
    return runs.select("run_id").distinct().withColumn("baseline", F.lag("run_id").over(Window.orderBy("run_id")))  # one row a run


#: Which request fields a log format can express.
CAPABILITIES = {
    "nginx-combined": ["status", "user_agent", "referer"], "apache-vhost-combined": ["status", "user_agent", "referer", "host"], "nginx-postdata": ["status", "user_agent", "referer", "host", "request_body", "content_type", "tls_protocol"],
    "aws-waf": ["status", "user_agent", "referer", "host", "headers", "ja3", "ja4", "waf_action", "country"], "aws-alb": ["status", "user_agent", "host", "tls_protocol"], "aws-cloudfront": ["status", "user_agent", "referer", "host"],
}


def capability_union(events: DataFrame) -> DataFrame:
    """(field, sources): fields that any log source of the corpus can express. The formats are a handful of fixed rows."""
    known = events.sparkSession.createDataFrame([(k, f) for k, fields in CAPABILITIES.items() for f in fields], "log_source string, field string")
    return events.select("log_source").distinct().join(F.broadcast(known), "log_source").groupBy("field").agg(F.count("*").alias("sources"))
