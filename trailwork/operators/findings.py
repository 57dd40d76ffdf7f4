"""Aggregates over findings: totals, CVEs, entities, scores, replay."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trailwork.functions import network as N
from trailwork.functions import web as W
from trailwork.operators.concentration import time_filter
from trailwork.operators.ordering import sliding_distinct, with_previous

SEVERITIES = ("unknown", "info", "low", "medium", "high", "critical")
#: From the weakest: what a template says of how well a request alone shows its CVE.
DETECTABILITIES = ("unknown", "undetectable", "low", "medium", "high")
#: Caps of the score's components.
CAPS = {"template": 24, "cve": 16, "observation": 16, "path": 4, "spread": 20, "unblocked": 15, "burst": 5}
URI_ONLY_CAP = 74


def hunt_metrics(events: DataFrame, findings: DataFrame, rule_matches: DataFrame | None = None, rules_evaluated: int = 0, start=None, end=None) -> DataFrame:
    """One row: requests and what a time range leaves out, records, matches by request and CVE, their confidence and outcomes, rules.

    A record is a (request, template); a match a (request, CVE), counted once with its strongest confidence. With bounds,
    both inclusive, only requests in range count, and undated ones are left out. rule_matches: (event_id, rule_id).
    """
    kept, f = time_filter(events, start, end), time_filter(findings, start, end)
    records = f.agg(
        F.count("*").alias("matches"), F.countDistinct("event_id").alias("matched_requests"), F.count_if(F.col("specificity") == "request-specific").alias("request_specific"), F.count_if(F.col("distinctiveness") == "distinctive").alias("distinctive"),
        F.count_if(F.col("severity").isin("high", "critical")).alias("high_or_critical"), F.countDistinct("source_ip").alias("matched_peers"), F.countDistinct("template_id").alias("templates"),
    )
    level = lambda name: F.count_if(F.col("detectability_rank") == DETECTABILITIES.index(name) + 1).alias(f"{name}_confidence")
    outcome = lambda name: F.count_if(F.col("outcome") == name).alias(f"cve_{name.replace('-', '_')}")
    cves = by_cve(f).agg(
        F.count("*").alias("cve_matches"), F.countDistinct("cve").alias("cves"), F.count_if("specific").alias("cve_request_specific"), F.count_if(~F.col("specific")).alias("cve_response_unverified"), level("high"), level("medium"), level("low"),
        outcome("blocked"), outcome("not-blocked"), outcome("unknown"), F.count_if("count_evidence").alias("count_evidence"),
    )
    everything = kept.agg(F.count("*").alias("requests"), F.countDistinct("source_ip").alias("peers"), F.countDistinct("ja4").alias("fingerprints"), F.min(W.epoch(F.col("ts"))).alias("earliest"), F.max(W.epoch(F.col("ts"))).alias("latest"))
    bounded = start is not None or end is not None
    inside = F.coalesce((F.col("ts") >= F.lit(start).cast("timestamp")) if start is not None else F.lit(True), F.lit(False)) & F.coalesce((F.col("ts") <= F.lit(end).cast("timestamp")) if end is not None else F.lit(True), F.lit(False))
    excluded = events.agg(F.count_if(F.lit(bounded) & F.col("ts").isNotNull() & ~inside).alias("outside_range"), F.count_if(F.lit(bounded) & F.col("ts").isNull()).alias("undated_excluded"))
    out = everything.join(F.broadcast(records)).join(F.broadcast(cves)).join(F.broadcast(excluded)).withColumn("rules_evaluated", F.lit(rules_evaluated).cast("long"))
    if rule_matches is None:
        return out.withColumns({c: F.lit(0).cast("long") for c in ("rule_matches", "rule_matched_requests", "rules_matched")})
    # The matches of requests in range, each once.
    met = rule_matches.select("event_id", "rule_id").distinct().join(kept.select("event_id"), "event_id", "left_semi")
    return out.join(F.broadcast(met.agg(F.count("*").alias("rule_matches"), F.countDistinct("event_id").alias("rule_matched_requests"), F.countDistinct("rule_id").alias("rules_matched"))))


def by_cve(findings: DataFrame) -> DataFrame:
    """A row for each (event, CVE) once, whatever number of templates matched, with the strongest severity, detectability and specificity.

    Confidence and evidence of counting rules are unknown and false where the findings have no columns for them.
    """
    rank = lambda names, c: F.coalesce(F.array_position(F.array(*map(F.lit, names)), F.col(c)), F.lit(1)) if c in findings.columns else F.lit(1).cast("long")
    evidence = F.coalesce(F.size("waf_non_terminating_rule_ids") > 0, F.lit(False)) if "waf_non_terminating_rule_ids" in findings.columns else F.lit(False)
    have = [c for c in ("ts", "source_ip", "ja4", "host", "status", "outcome", "request_id", "distinctiveness") if c in findings.columns]
    specific = F.col("specificity") == "request-specific" if "specificity" in findings.columns else F.lit(False)
    rows = findings.select("event_id", *have, "template_id", rank(SEVERITIES, "severity").alias("severity_rank"), rank(DETECTABILITIES, "detectability").alias("detectability_rank"), specific.alias("specific"), evidence.alias("count_evidence"), F.explode("cves").alias("cve"))
    return rows.groupBy("event_id", "cve").agg(*[F.first(c).alias(c) for c in have], F.max("severity_rank").alias("severity_rank"), F.max("detectability_rank").alias("detectability_rank"), F.bool_or("specific").alias("specific"), F.bool_or("count_evidence").alias("count_evidence"))


def cve_summary(findings: DataFrame) -> DataFrame:
    """Per CVE: requests by distinctiveness, first and last time, peers, fingerprints, hosts, outcomes, strongest severity and detectability, protection gap."""
    at = W.epoch(F.col("ts"))
    per = by_cve(findings).groupBy("cve").agg(
        F.count("*").alias("requests"), F.min(at).alias("first_seen"), F.max(at).alias("last_seen"), F.countDistinct("source_ip").alias("peers"), F.countDistinct("ja4").alias("fingerprints"), F.countDistinct("host").alias("hosts"),
        F.count_if(F.col("outcome") == "blocked").alias("blocked"), F.count_if(F.col("outcome") == "not-blocked").alias("not_blocked"), F.count_if(F.col("outcome") == "unknown").alias("unknown_outcome"), F.count_if("count_evidence").alias("count_evidence"),
        F.count_if(F.col("status").between(200, 299)).alias("ok"), F.count_if(F.col("distinctiveness") == "distinctive").alias("distinctive"), F.count_if(F.col("distinctiveness") == "generic").alias("generic"), F.max("severity_rank").alias("severity_rank"), F.max("detectability_rank").alias("detectability_rank"),
    )
    templates = findings.select(F.explode("cves").alias("cve"), "template_id").groupBy("cve").agg(F.array_join(F.sort_array(F.collect_set("template_id")), ";").alias("template_ids"))
    gap = W.share(F.col("not_blocked"), F.col("blocked") + F.col("not_blocked"), None)
    name = lambda names, c: F.get(F.array(*map(F.lit, names)), F.col(c).cast("int") - 1)
    return per.join(templates, "cve").withColumns({"protection_gap": gap, "severity": name(SEVERITIES, "severity_rank"), "detectability": name(DETECTABILITIES, "detectability_rank")}).drop("severity_rank", "detectability_rank")


def cve_statuses(findings: DataFrame) -> DataFrame:
    """Response status counts of each CVE's requests, in long form; requests without a status are left out."""
    return by_cve(findings).filter("status is not null").groupBy("cve", "status").agg(F.count("*").alias("requests"))


def kev_flag(rows: DataFrame, kev: DataFrame) -> DataFrame:
    known = kev.select(F.upper(F.trim("cve_id")).alias("cve")).distinct().withColumn("kev", F.lit(True))
    return rows.join(known, "cve", "left").withColumn("kev", F.coalesce("kev", F.lit(False)))


def severity_counts(findings: DataFrame) -> DataFrame:
    s = F.coalesce("severity", F.lit("unknown"))
    return findings.agg(*[F.count_if(s == x).alias(x) for x in SEVERITIES])


def findings_by_waf_action(findings: DataFrame) -> DataFrame:
    return findings.groupBy(W.waf_action_name(F.col("waf_action")).alias("action")).agg(F.count("*").alias("findings"))


def explain_paths(findings: DataFrame) -> DataFrame:
    """Per (method, path): matches, CVEs, templates, distinctiveness."""
    base = findings.groupBy("method", "uri_path").agg(F.count("*").alias("matches"), F.countDistinct("template_id").alias("templates"), F.first("distinctiveness").alias("distinctiveness"))
    cves = findings.select("method", "uri_path", F.explode("cves").alias("cve")).groupBy("method", "uri_path").agg(F.countDistinct("cve").alias("cves"))
    return base.join(cves, ["method", "uri_path"], "left").fillna(0, ["cves"])


def probe_success(findings: DataFrame, template_id: str) -> DataFrame:
    """Matches of one template by 2xx, without a status, and the rest."""
    s = F.col("status")
    return findings.filter(F.col("template_id") == template_id).agg(F.count("*").alias("matches"), F.count_if(s.between(200, 299)).alias("ok"), F.count_if(s.isNull()).alias("without_status"), F.count_if(s.isNotNull() & ~s.between(200, 299)).alias("rest"))


def probe_evidence(findings: DataFrame, template_id: str) -> DataFrame:
    """The successful matches of one template, for review: in the order of time (unknown last), then of the log."""
    rows = findings.filter((F.col("template_id") == template_id) & F.col("status").between(200, 299))
    return rows.select("event_id", "ts", "source_ip", "method", "uri_path", "status").orderBy(F.asc_nulls_last("ts"), "event_id")


def observation_key() -> Column:
    """What makes two records one observation: the request id, else time, host, method, path and query."""
    rest = F.concat_ws("|", F.coalesce(W.epoch(F.col("ts")).cast("string"), F.lit("-")), *[F.coalesce(F.col(c), F.lit("-")) for c in ("host", "method", "uri_path", "uri_query")])
    return F.coalesce(F.concat(F.lit("id:"), F.col("request_id")), rest)


def entity_groups(findings: DataFrame, key: str | tuple[str, ...] = "source_ip", spread: str = "hosts") -> DataFrame:
    """Per entity: templates, CVEs, observations, records, distinctive and request-specific observations, clients and peers, spread, unblocked share.

    ``key`` is a column, or several such as (identity, source). The spread counts hosts, or with "senders" (for fingerprints
    and networks) the larger of the validated clients and the observed peers, which may be the same. Observations are
    deduplicated first, so the distinct counts run over one row each; an observation with both outcomes is left out of the
    share.
    """
    keys = [key] if isinstance(key, str) else list(key)
    f = findings.filter(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])).withColumn("observation", observation_key())
    per = f.groupBy(*keys, "observation").agg(F.count("*").alias("records"), F.max((F.col("distinctiveness") == "distinctive").cast("int")).alias("distinctive"), F.max((F.col("specificity") == "request-specific").cast("int")).alias("specific"), F.max((F.col("outcome") == "blocked").cast("int")).alias("blocked"), F.max((F.col("outcome") == "not-blocked").cast("int")).alias("passed"))
    clear = F.col("blocked") + F.col("passed") == 1
    totals = per.groupBy(*keys).agg(F.count("*").alias("observations"), F.sum("records").alias("records"), F.sum("distinctive").alias("distinctive_observations"), F.sum("specific").alias("specific_observations"), F.count_if(clear & (F.col("passed") == 1)).alias("unblocked"), F.count_if(clear).alias("with_outcome"))
    client = N.canonical_or_raw(F.col("client_ip")) if "client_ip" in findings.columns else F.lit(None).cast("string")
    senders = F.greatest("clients", "peers") if spread == "senders" else F.col("hosts")
    wide = f.withColumn("__client", client).groupBy(*keys).agg(F.countDistinct("template_id").alias("templates"), F.countDistinct("host").alias("hosts"), F.countDistinct("__client").alias("clients"), F.countDistinct(F.when(F.col("__client").isNull(), N.canonical_or_raw(F.col("source_ip")))).alias("peers"))
    wide = wide.withColumn("spread", senders).drop("hosts")
    cves = f.select(*keys, F.explode("cves").alias("cve")).groupBy(*keys).agg(F.countDistinct("cve").alias("cves"))
    out = totals.join(wide, keys).join(cves, keys, "left").fillna(0, ["cves"])
    return out.withColumn("unblocked_share", W.share(F.col("unblocked"), F.col("with_outcome"), None))


def with_asn(findings: DataFrame, asn: DataFrame) -> DataFrame:
    """Findings with identity (validated-client or observed-peer) and the ASN of that address, NULL where it isn't known. asn: ip, asn."""
    client = F.col("client_ip") if "client_ip" in findings.columns else F.lit(None).cast("string")
    named = findings.withColumns({"identity": F.when(client.isNotNull(), "validated-client").when(F.col("source_ip").isNotNull(), "observed-peer"), "__ip": N.canonical_ip(F.coalesce(client, "source_ip"))})
    known = asn.select(N.canonical_ip(F.col("ip")).alias("__ip"), "asn").filter("__ip is not null").groupBy("__ip").agg(F.max("asn").alias("asn"))
    return named.join(known, "__ip", "left").drop("__ip")


def rank_entities(groups: DataFrame, key: str | tuple[str, ...] = "source_ip") -> DataFrame:
    """Most observations first, then most templates, then the key."""
    keys = [key] if isinstance(key, str) else list(reversed(key))
    return groups.orderBy(F.desc("observations"), F.desc("templates"), *keys)


def triage_basis(groups: DataFrame, breadth_observations: int = 3, breadth_templates: int = 2, depth_observations: int = 10) -> DataFrame:
    """Add ``basis`` over all of an entity's observations: breadth, depth, both or NULL."""
    wide, deep = (F.col("observations") >= breadth_observations) & (F.col("templates") >= breadth_templates), F.col("observations") >= depth_observations
    return groups.withColumn("basis", basis(wide, deep))


def behavior_score(groups: DataFrame, burst: Column | None = None, spread: bool = True, waf: bool = True) -> DataFrame:
    """Add score (0 to 100) and tier: capped points over what the telemetry can reach; without request-specific evidence at most 74."""
    generic = F.col("observations") - F.col("distinctive_observations")
    points = {
        "template": F.least(F.col("templates") * 3, F.lit(CAPS["template"])),
        "cve": F.least(F.col("cves") * 2, F.lit(CAPS["cve"])),
        "observation": F.least(F.col("distinctive_observations") + F.least(F.floor(generic / 10), F.lit(2)), F.lit(CAPS["observation"])),
        "path": F.least(F.col("distinctive_observations"), F.lit(CAPS["path"])),
        "burst": F.when(burst if burst is not None else F.lit(False), CAPS["burst"]).otherwise(0),
    }
    if spread:
        points["spread"] = F.least(F.col("spread") * 2, F.lit(CAPS["spread"]))
    if waf:
        points["unblocked"] = F.coalesce(F.floor(F.col("unblocked_share") * CAPS["unblocked"] + 0.5), F.lit(0))
    reach = sum(CAPS[p] for p in points)
    total = F.floor(reduce(lambda a, b: a + b, points.values()) * 100.0 / reach + 0.5)
    score = F.when(F.col("specific_observations") == 0, F.least(total, F.lit(URI_ONLY_CAP))).otherwise(total).cast("long")
    return groups.withColumn("score", score).withColumn("tier", F.when(F.col("score") >= 75, "high").when(F.col("score") >= 50, "medium").when(F.col("score") >= 25, "low").otherwise("info"))


def windowed_burst(findings: DataFrame, widths: tuple[int, ...], key: str = "source_ip", breadth_observations: int = 3, breadth_templates: int = 2, depth_observations: int = 10) -> DataFrame:
    """Per entity and width in seconds: most distinct observations and templates within any such window, both ends included.

    Breadth: some window holds so many observations and so many templates at once; depth: some window holds so many
    observations. Times count in whole milliseconds. See ``sliding_distinct`` for how entities of any size are spread.
    """
    rows = findings.filter(F.col(key).isNotNull() & F.col("ts").isNotNull()).select(key, F.unix_millis("ts").alias("ms"), observation_key().alias("o"), "template_id")
    counts = sliding_distinct(rows, [key], widths, {"observations": F.col("o"), "templates": F.col("template_id")})
    wide, deep = (F.col("observations") >= breadth_observations) & (F.col("templates") >= breadth_templates), F.col("observations") >= depth_observations
    out = counts.groupBy(key, "width").agg(F.max("observations").alias("max_observations"), F.max("templates").alias("max_templates"), F.bool_or(wide).alias("breadth"), F.bool_or(deep).alias("depth"))
    return out.withColumn("basis", basis(F.col("breadth"), F.col("depth"), "windowed "))


def basis(breadth: Column, depth: Column, before: str = "") -> Column:
    return F.when(breadth & depth, f"{before}breadth + depth").when(breadth, f"{before}breadth").when(depth, f"{before}depth")


def visible_pattern() -> Column:
    """What a request looks like: method, path and query."""
    return F.concat(F.coalesce("method", F.lit("<method unavailable>")), F.lit(" "), F.coalesce("uri_path", F.lit("<path unavailable>")), F.coalesce(F.concat(F.lit("?"), "uri_query"), F.lit("")))


def sequence_summary(findings: DataFrame, width: int = 10, key: str = "source_ip") -> DataFrame:
    """Per entity: observations, undated ones, most distinct patterns and distinctive patterns within ``width`` seconds, least and median seconds between consecutive observations.

    An observation counts once, at its earliest time. Without two dated observations there is no gap, without a dated one no maximum.
    """
    named = findings.filter(F.col(key).isNotNull()).select(key, F.unix_millis("ts").alias("ms"), observation_key().alias("o"), visible_pattern().alias("pattern"), (F.col("distinctiveness") == "distinctive").alias("distinctive"))
    seen = named.groupBy(key, "o").agg(F.min_by(F.struct("ms", "pattern", "distinctive"), F.struct(F.coalesce("ms", F.lit((1 << 63) - 1)), "pattern")).alias("s")).select(key, "s.*")
    totals = seen.groupBy(key).agg(F.count("*").alias("observations"), F.count_if(F.col("ms").isNull()).alias("undated"))
    most = sliding_distinct(seen, [key], [width], {"patterns": F.col("pattern"), "distinctive_patterns": F.when(F.col("distinctive"), F.col("pattern"))})
    most = most.groupBy(key).agg(F.max("patterns").alias("max_patterns"), F.max("distinctive_patterns").alias("max_distinctive_patterns"))
    # Only distinct times are neighbours; the other observations of a time are 0 apart.
    times = seen.filter("ms is not null").groupBy(key, "ms").agg(F.count("*").alias("n"))
    times = with_previous(times, [key], F.floor(F.col("ms") / 3_600_000), "ms", "ms", "before")
    gap = F.array_compact(F.array(F.when(F.col("before").isNotNull(), F.struct(((F.col("ms") - F.col("before")) / 1000.0).alias("gap"), F.lit(1).cast("long").alias("k"))), F.when(F.col("n") > 1, F.struct(F.lit(0.0).alias("gap"), (F.col("n") - 1).alias("k")))))
    gaps = times.select(key, F.explode(gap).alias("g")).select(key, "g.*").groupBy(key, "gap").agg(F.sum("k").alias("k"))
    between = gaps.groupBy(key).agg(F.min("gap").alias("min_gap"), F.expr("percentile(gap, 0.5, k)").alias("median_gap"))
    return totals.join(most, key, "left").join(between, key, "left")


def ordered_sequence(findings: DataFrame, key: str = "source_ip", most: int | None = None) -> DataFrame:
    """Per entity its (time, pattern) in order, as rows with their place; all of them, or the first ``most`` where given.

    A place is the number of rows in the hours before, in the seconds before of the hour, and within the second, so no
    window holds more than an entity's hours, an hour's seconds or a second's rows.
    """
    rows = findings.filter(F.col(key).isNotNull() & F.col("ts").isNotNull()).select(key, F.unix_millis("ts").alias("ms"), F.concat_ws(" ", "method", "uri_path").alias("pattern")).distinct()
    rows = rows.withColumns({"hour": F.expr("ms div 3600000") - (F.col("ms") % 3600000 < 0).cast("long"), "second": F.expr("ms div 1000") - (F.col("ms") % 1000 < 0).cast("long")})
    before = lambda *by: F.coalesce(F.sum("n").over(Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    seconds = rows.groupBy(key, "hour", "second").agg(F.count("*").alias("n"))
    hours = seconds.groupBy(key, "hour").agg(F.sum("n").alias("n")).select(key, "hour", before(key, "hour").alias("hours_before"))
    offsets = seconds.withColumn("seconds_before", before(key, "hour", "second")).join(hours, [key, "hour"]).select(key, "second", (F.col("hours_before") + F.col("seconds_before")).alias("ahead"))
    within = F.row_number().over(Window.partitionBy(key, "second").orderBy("ms", "pattern"))
    placed = rows.withColumn("within", within).join(offsets, [key, "second"]).select(key, "ms", "pattern", (F.col("ahead") + F.col("within")).alias("place"))
    return placed if most is None else placed.filter(F.col("place") <= most)


def triage_view(groups: DataFrame, reputation: DataFrame | None = None, first_seen: DataFrame | None = None, sequences: DataFrame | None = None, key: str = "source_ip") -> DataFrame:
    """Scored entities with basis, reputation, first-seen mark and sequence measures, in the order of review.

    Order: score, then reputation (unknown last), then first-seen ones, then the key, and the identity where groups have one.
    reputation: key, reputation; first_seen: addresses (a column ``ip``) that earlier runs lack; sequences: see
    ``sequence_summary``. Addresses are compared in canonical spelling.
    """
    spelt = lambda c: N.canonical_or_raw(F.col(c))
    out = triage_basis(behavior_score(groups)).withColumn("__ip", spelt(key))
    if reputation is not None:
        known = reputation.select(spelt(key).alias("__ip"), "reputation").groupBy("__ip").agg(F.max("reputation").alias("reputation"))
        out = out.join(known, "__ip", "left")
    else:
        out = out.withColumn("reputation", F.lit(None).cast("long"))
    if first_seen is not None:
        new = first_seen.select(spelt("ip").alias("__ip")).distinct().withColumn("first_seen", F.lit(True))
        out = out.join(new, "__ip", "left").withColumn("first_seen", F.coalesce("first_seen", F.lit(False)))
    else:
        out = out.withColumn("first_seen", F.lit(False))
    out = out.drop("__ip")
    if sequences is not None:
        out = out.join(sequences.select(key, "undated", "max_patterns", "max_distinctive_patterns", "min_gap", "median_gap"), key, "left")
    last = [key, "identity"] if "identity" in groups.columns else [key]
    return out.orderBy(F.desc("score"), F.desc_nulls_last("reputation"), F.desc("first_seen"), *last)


def triage_summary(view: DataFrame) -> DataFrame:
    """One row without any key: entities, those to investigate, first-seen ones, a histogram of tiers, sequence maxima (0 without any)."""
    tiers = [F.count_if(F.col("tier") == t).alias(f"tier_{t}") for t in ("info", "low", "medium", "high")]
    most = lambda c: (F.coalesce(F.max(c), F.lit(0)) if c in view.columns else F.lit(0)).cast("long").alias(c)
    undated = (F.coalesce(F.sum("undated"), F.lit(0)) if "undated" in view.columns else F.lit(0)).cast("long").alias("undated")
    return view.agg(F.count("*").alias("entities"), F.count("basis").alias("to_investigate"), F.count_if("first_seen").alias("first_seen"), *tiers, undated, most("max_patterns"), most("max_distinctive_patterns"))


#: Narrower and narrower readings of a detection.
RUNGS = ("path", "path_query", "path_query_headers", "full", "full_specific")


def ladder(events: DataFrame, detections: DataFrame) -> DataFrame:
    """(event_id, request_id, outcome, cve and one Boolean a rung) of every path hit.

    path; path and query; path, query and headers; the full match, with method and fragment; the full match of a detection
    that is request-specific. Parts that the detections or the events have no column for are not asked.
    """
    from trailwork.operators.matching import headers_present, request_specificity, small

    have = set(detections.columns)
    d = detections.select("cves", request_specificity(detections).alias("specificity"), *[F.col(c).alias(f"d_{c}") for c in ("path", "method", "query", "fragment", "headers") if c in have])
    hit = events.join(small(d), F.col("uri_path") == F.col("d_path"))
    no = lambda c: F.coalesce(c, F.lit(False))
    query = no(F.col("d_query").isNull() | F.contains(F.col("uri_query"), F.col("d_query")))
    headers = query & headers_present(F.col("d_headers"), F.col("headers")) if "headers" in have and "headers" in events.columns else query
    full = headers & no(F.lower("method") == F.lower("d_method"))
    if "fragment" in have and "uri_fragment" in events.columns:
        full &= no(F.col("d_fragment").isNull() | (F.col("uri_fragment") == F.col("d_fragment")))
    holds = dict(zip(RUNGS, (F.lit(True), query, headers, full, full & (F.col("specificity") == "request-specific")), strict=True))
    return hit.select("event_id", "request_id", W.waf_outcome(F.col("waf_action")).alias("outcome"), F.explode("cves").alias("cve"), *[c.alias(n) for n, c in holds.items()])


def replayed(events: DataFrame, detections: DataFrame) -> DataFrame:
    """(event_id, request_id, outcome, cve) of full matches, once each."""
    return ladder(events, detections).filter("full").select("event_id", "request_id", "outcome", "cve").distinct()


def _held_rungs() -> Column:
    return F.explode(F.array_compact(F.array(*[F.when(F.col(r), F.lit(r)) for r in RUNGS]))).alias("rung")


def ablation(events: DataFrame, detections: DataFrame) -> DataFrame:
    """Per rung: matched events, distinct (event, CVE), share of all requests."""
    pairs = ladder(events, detections).select("event_id", "cve", _held_rungs()).distinct()
    per = pairs.groupBy("rung").agg(F.countDistinct("event_id").alias("events"), F.count("*").alias("event_cves"))
    return per.join(F.broadcast(events.agg(F.count("*").alias("all_requests")))).withColumn("share", W.share(F.col("events"), F.col("all_requests")))


def historical_replay(matches: DataFrame, findings: DataFrame) -> DataFrame:
    """Per CVE: known findings, re-observed request ids, missed, coverage (NULL without known ones), other matches and their outcomes.

    Both have cve and request_id, matches also outcome.
    """
    known = findings.groupBy("cve").agg(F.count("*").alias("known"))
    ids = findings.filter("request_id is not null").select("cve", "request_id").distinct()
    seen = matches.filter("request_id is not null").select("cve", "request_id").distinct()
    again = ids.join(seen, ["cve", "request_id"], "left_semi").groupBy("cve").agg(F.count("*").alias("reobserved"))
    other = matches.join(ids, ["cve", "request_id"], "left_anti").groupBy("cve").agg(F.count("*").alias("other_matches"), *[F.count_if(F.col("outcome") == o).alias(f"other_{o.replace('-', '_')}") for o in ("blocked", "not-blocked", "unknown")])
    out = known.join(again, "cve", "full").join(other, "cve", "full").fillna(0, ["known", "reobserved", "other_matches", "other_blocked", "other_not_blocked", "other_unknown"])
    return out.withColumns({"missed": F.greatest(F.col("known") - F.col("reobserved"), F.lit(0)), "coverage": W.share(F.col("reobserved"), F.col("known"), None)})


def replay_total(replay: DataFrame) -> DataFrame:
    """One row over all CVEs of ``historical_replay``: sums, and the coverage of all known findings (NULL without any)."""
    sums = replay.agg(F.count("*").alias("cves"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("known", "reobserved", "missed", "other_matches", "other_blocked", "other_not_blocked", "other_unknown")])
    return sums.withColumn("coverage", W.share(F.col("reobserved"), F.col("known"), None))


def count_hypotheses(events: DataFrame, detections: DataFrame, findings: DataFrame) -> DataFrame:
    """Per CVE and rung: matched requests, known request ids re-observed, coverage."""
    pairs = ladder(events, detections).select("event_id", "request_id", "cve", _held_rungs()).distinct()
    known = findings.filter("request_id is not null").select("cve", "request_id").distinct().withColumn("known", F.lit(True))
    total = findings.groupBy("cve").agg(F.count("*").alias("known_findings"))
    per = pairs.join(known, ["cve", "request_id"], "left").groupBy("cve", "rung").agg(F.count("*").alias("matches"), F.countDistinct(F.when(F.col("known"), F.col("request_id"))).alias("reobserved"))
    return per.join(total, "cve", "left").fillna(0, ["known_findings"]).withColumn("coverage", W.share(F.col("reobserved"), F.col("known_findings"), None))


def build_candidates(findings: DataFrame) -> DataFrame:
    """Groups of (CVE, method, path, query) with counts by exclusion in fixed order, and a number within the CVE."""
    rows = findings.withColumn("exclusion", F.when(F.upper("waf_action") == "BLOCK", "blocked").when(F.col("specificity") != "request-specific", "uri-only").when(F.col("method").isNull() | F.col("uri_path").isNull(), "incomplete").otherwise("kept"))
    kept = rows.filter("exclusion = 'kept'").select(F.explode("cves").alias("cve"), "method", "uri_path", "uri_query", "event_id").distinct()
    per = kept.groupBy("cve", "method", "uri_path", "uri_query").agg(F.count("*").alias("requests"))
    return per.withColumn("number", F.row_number().over(Window.partitionBy("cve").orderBy("method", "uri_path", F.asc_nulls_first("uri_query"))))


def candidate_exclusions(findings: DataFrame) -> DataFrame:
    reason = F.when(F.upper("waf_action") == "BLOCK", "blocked").when(F.col("specificity") != "request-specific", "uri-only").when(F.col("method").isNull() | F.col("uri_path").isNull(), "incomplete").otherwise("kept")
    return findings.groupBy(reason.alias("reason")).agg(F.count("*").alias("findings"))


#: Names of the path field, the only one that a candidate of a rule may ask about.
PATH_FIELDS = ("cs-uri-stem", "uri_path")


def rule_candidates(matches: DataFrame, rules: DataFrame) -> DataFrame:
    """One candidate a rule that only compares paths with literals: requests, first and last time; it makes no claim on a CVE.

    matches: rows of ``match_rules``; blocked requests are left out. Rules of other fields or keywords can't be said as a candidate: they keep their number,
    in the order of rule ids, and have translatable false.
    """
    field = lambda s: F.lower(s["field"]).isin(*PATH_FIELDS)
    known = rules.select("rule_id", ((F.size("selections") > 0) & F.forall("selections", lambda s: F.coalesce(field(s), F.lit(False))) & (F.size("condition") > 0)).alias("translatable"))
    at = W.epoch(F.col("ts"))
    kept = matches.filter(F.coalesce(F.upper("waf_action") != "BLOCK", F.lit(True)))
    per = kept.groupBy("rule_id").agg(F.count("*").alias("requests"), F.min(at).alias("first_seen"), F.max(at).alias("last_seen"))
    numbered = per.withColumn("number", F.row_number().over(Window.orderBy("rule_id")))  # one row a rule
    return numbered.join(known, "rule_id", "left").withColumn("translatable", F.coalesce("translatable", F.lit(False)))


def replay_candidate(events: DataFrame, holds: Column, findings: DataFrame) -> DataFrame:
    """One row: evaluated and matched requests, known request ids matched and missed, coverage."""
    ids = findings.filter("request_id is not null").select("request_id").distinct()
    matched = events.filter(holds)
    hit = ids.join(matched.filter("request_id is not null").select("request_id").distinct(), "request_id", "left_semi").agg(F.count("*").alias("known_matched"))
    out = events.agg(F.count("*").alias("evaluated"), F.count_if(holds).alias("matched")).join(F.broadcast(hit)).join(F.broadcast(ids.agg(F.count("*").alias("known"))))
    return out.withColumns({"known_missed": F.col("known") - F.col("known_matched"), "other_matches": F.col("matched") - F.col("known_matched"), "coverage": W.share(F.col("known_matched"), F.col("known"), None)})


def evaluate_candidate(corpora: DataFrame, holds: Column, absent: Column) -> DataFrame:
    """Per cohort: requests, matches, share, requests that lack a field, matched peers and paths."""
    matched = F.coalesce(holds, F.lit(False))
    return corpora.groupBy("cohort").agg(F.count("*").alias("requests"), F.count_if(matched).alias("matches"), W.share(F.count_if(matched), F.count("*")).alias("share"), F.count_if(absent).alias("absent_fields"), F.countDistinct(F.when(matched, F.col("source_ip"))).alias("peers"), F.countDistinct(F.when(matched, F.col("uri_path"))).alias("paths"))


def candidate_tops(corpora: DataFrame, holds: Column, key: str, k: int = 10) -> DataFrame:
    """The k values of a key that a candidate matches most in each cohort, ties by value; a report of the first k."""
    per = corpora.filter(F.coalesce(holds, F.lit(False)) & F.col(key).isNotNull()).groupBy("cohort", key).agg(F.count("*").alias("matches"))
    place = F.row_number().over(Window.partitionBy("cohort").orderBy(F.desc("matches"), key))
    return per.withColumn("place", place).filter(F.col("place") <= k)


def evaluate_labels(actual: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: TP, FN, FP, TN over events and (event, rule) misses. actual: (event_id, rule_id); truth: (event_id, rule_id or NULL)."""
    want = truth.groupBy("event_id").agg(F.collect_set("rule_id").alias("want"))
    got = actual.groupBy("event_id").agg(F.collect_set("rule_id").alias("got"))
    rows = want.join(got, "event_id", "left").withColumn("got", F.coalesce("got", F.array()))
    w, g = F.size("want") > 0, F.size("got") > 0
    n = rows.agg(F.count_if(w & g).alias("tp"), F.count_if(w & ~g).alias("fn"), F.count_if(~w & g).alias("fp"), F.count_if(~w & ~g).alias("tn"), F.sum(F.size(F.array_except("want", "got"))).alias("missed"), F.sum(F.size(F.array_except("got", "want"))).alias("unexpected"))
    return n.withColumns({"recall": W.share(F.col("tp"), F.col("tp") + F.col("fn"), None), "precision": W.share(F.col("tp"), F.col("tp") + F.col("fp"), None), "false_positive_rate": W.share(F.col("fp"), F.col("fp") + F.col("tn"), None)})


def request_context(events: DataFrame, ips: DataFrame, start, end, cap: int) -> DataFrame:
    """All requests of chosen peers in a time window: the first ``cap`` in physical order, then by time; with the number left out."""
    chosen = events.join(ips.select("source_ip").distinct(), "source_ip", "left_semi").filter(F.col("ts").between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")))
    first = chosen.orderBy("event_id").limit(cap)
    return first.join(F.broadcast(chosen.agg(F.count("*").alias("n")))).withColumn("omitted", F.greatest(F.col("n") - cap, F.lit(0))).drop("n")


def evidence_examples(findings: DataFrame, key: str, k: int) -> DataFrame:
    """The first k rows of each group, with the number left out. The count is an aggregate of its own, so that the rank limits its groups early."""
    ranked = findings.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy("event_id", "template_id"))).filter(F.col("place") <= k)
    counts = findings.groupBy(F.col(key).alias("__key")).agg(F.count("*").alias("__n"))
    return ranked.join(counts, F.col(key).eqNullSafe(F.col("__key"))).withColumn("omitted", F.greatest(F.col("__n") - k, F.lit(0))).drop("__key", "__n")
