"""Matching requests against detections, rules, indicators and conditions.

Rule-side tables are small, but their size is checked (``small``): up to a number of rows they are broadcast, beyond that
the same equi-joins run by shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailwork.functions import network as N
from trailwork.functions import web as W
from trailwork.functions.tables import is_small, small, written
from trailwork.operators import rules as R

def request_specificity(detections: DataFrame) -> Column:
    has = F.col("query").isNotNull()
    if "fragment" in detections.columns:
        has |= F.col("fragment").isNotNull()
    if "headers" in detections.columns:
        has |= F.size(F.coalesce("headers", F.array())) > 0
    return F.when(has, "request-specific").otherwise("response-unverified")


def headers_present(wanted: Column, headers: Column) -> Column:
    """Whether every wanted header is there, some header of its name having its value, without case; true where none is wanted."""
    same = lambda h, w: (F.lower(h["name"]) == F.lower(w["name"])) & (F.lower(h["value"]) == F.lower(w["value"]))
    return F.when(F.coalesce(F.size(wanted), F.lit(0)) <= 0, True).otherwise(F.coalesce(F.forall(wanted, lambda w: F.coalesce(F.exists(headers, lambda h: same(h, w)), F.lit(False))), F.lit(False)))


def detection_hits(events: DataFrame, detections: DataFrame) -> DataFrame:
    """Events joined with every detection they match, with its specificity; fragment and headers are asked where both sides have them."""
    d = detections.withColumn("specificity", request_specificity(detections)).withColumnsRenamed({"method": "d_method", "query": "d_query", "fragment": "d_fragment", "headers": "d_headers"})
    on = (F.col("uri_path") == F.col("path")) & (F.lower("method") == F.lower("d_method")) & F.coalesce(F.col("d_query").isNull() | F.contains(F.col("uri_query"), F.col("d_query")), F.lit(False))
    if "fragment" in detections.columns and "uri_fragment" in events.columns:
        on &= F.coalesce(F.col("d_fragment").isNull() | (F.col("uri_fragment") == F.col("d_fragment")), F.lit(False))
    if "headers" in detections.columns and "headers" in events.columns:
        on &= headers_present(F.col("d_headers"), F.col("headers"))
    return events.join(small(d), on, "inner").drop("d_method", "d_query", "d_fragment", "d_headers", "path")


def match_detections(events: DataFrame, detections: DataFrame) -> DataFrame:
    """One finding for each (event, template): exact path, then method without case, query contained, fragment equal, headers present.

    Of several requests of one template the one of the lowest ordinal counts. Detections: template_id, ordinal, cves,
    severity, method, path, query and, if there, fragment, headers. A request without a method never matches. CVEs come out
    sorted and once each.
    """
    hit = detection_hits(events, detections)
    least = hit.groupBy("event_id", "template_id").agg(F.min("ordinal").alias("ordinal"))
    kept = hit.join(least, ["event_id", "template_id", "ordinal"]).withColumn("cves", F.array_sort(F.array_distinct("cves")))
    return kept.withColumns({"distinctiveness": W.path_distinctiveness(F.col("uri_path")), "outcome": W.waf_outcome(F.col("waf_action"))})


def filter_findings(findings: DataFrame, outcome: str | None = None, include_generic: bool = False) -> DataFrame:
    """Explicit outcome only; findings that are generic and response-unverified are hidden from listings."""
    out = findings if outcome is None else findings.filter(F.col("outcome") == outcome)
    return out if include_generic else out.filter(~((F.col("distinctiveness") == "generic") & (F.col("specificity") == "response-unverified")))


def match_rules(events: DataFrame, rules: DataFrame | list[dict]) -> DataFrame:
    """One row for each (event, rule) that holds; rules come as a table or written out. See ``rules.match_rules``."""
    return R.match_rules(events, R.rules_table(events.sparkSession, rules) if isinstance(rules, list) else rules)


#: The event columns that an indicator type is compared with.
_PLAIN_FIELDS = {"path": "uri_path", "user-agent": "user_agent", "ja3": "ja3", "ja4": "ja4"}


def host_and_port(host: Column) -> tuple[Column, Column]:
    """A host in lower case without port and last dot, and its explicit numeric port or NULL; a bare v6 address has none."""
    port = F.nullif(F.regexp_extract(host, r"^(?:[^:]*|\[.*\]):(\d+)$", 1), F.lit(""))
    name = F.when(port.isNotNull(), F.regexp_replace(host, r":\d+$", "")).otherwise(host)
    return F.lower(F.regexp_replace(name, r"\.$", "")), port


def url_parts(url: Column) -> tuple[Column, Column]:
    """(authority, path) of an http or https URL without query and fragment, the scheme's own port left out; NULLs for any other."""
    good = url.rlike(r"^https?://[^/?#@\s]+(/[^?#]*)?$")
    name, port = host_and_port(F.regexp_extract(url, r"^https?://([^/]+)", 1))
    own = F.when(url.startswith("https:"), "443").otherwise("80")
    authority = F.when(port.isNotNull() & (port != own), F.concat(name, F.lit(":"), port)).otherwise(name)
    path = F.regexp_extract(url, r"^https?://[^/]+(/.*)$", 1)
    return F.when(good, authority), F.when(good, F.when(path == "", "/").otherwise(path))


def match_indicators(events: DataFrame, indicators: DataFrame) -> DataFrame:
    """(event_id, indicator_id, fields): which fields an indicator hit. Types: ip, cidr, path, path-prefix, user-agent, ja3, ja4, host, url.

    Addresses, networks, prefixes, hosts and URLs are matched on the distinct values first, by equi-joins on canonical
    values or on the lengths that occur. What they give is a table of values with the indicators they hit, one row a value,
    and each field of the events meets its own part of it: by broadcast where it is small, else by a join on the value, whose
    frequent values adaptive execution splits. Events stay one row until the hits of all fields are there.
    """
    have = set(events.columns)
    spread = F.broadcast if is_small(indicators) else (lambda x: x)
    kind = lambda *names: indicators.filter(F.col("type").isin(*names))
    atoms = [kind(t).select(F.lit(c).alias("field"), "value", "indicator_id") for t, c in _PLAIN_FIELDS.items() if c in have]
    for field in ("source_ip", "client_ip"):
        if field in have:
            ips = events.select(F.col(field).alias("ip")).filter("ip is not null").distinct()
            exact = ips.withColumn("canonical", N.canonical_ip(F.col("ip"))).join(spread(kind("ip").select("indicator_id", N.canonical_ip(F.col("value")).alias("canonical"))), "canonical")
            nets = N.longest_prefix(ips, kind("cidr").select("indicator_id", F.col("value").alias("network")))
            atoms += [x.select(F.lit(field).alias("field"), F.col("ip").alias("value"), "indicator_id") for x in (exact, nets)]
    if "uri_path" in have:
        prefixes = kind("path-prefix").select("indicator_id", F.col("value").alias("cut"), F.length("value").alias("cut_length"))
        paths = events.select("uri_path").filter("uri_path is not null").distinct()
        cuts = paths.join(spread(prefixes.select("cut_length").distinct()), F.length("uri_path") >= F.col("cut_length")).withColumn("cut", F.expr("left(uri_path, cut_length)"))
        atoms.append(cuts.join(spread(prefixes), ["cut", "cut_length"]).select(F.lit("uri_path").alias("field"), F.col("uri_path").alias("value"), "indicator_id"))
    fields = {c: F.col(c).cast("string") for c in (*_PLAIN_FIELDS.values(), "source_ip", "client_ip", "host") if c in have}
    if "host" in have:
        name, port = host_and_port(F.col("host"))
        hosts = events.select("host").filter("host is not null").distinct().withColumn("name", name)
        atoms.append(hosts.join(spread(kind("host").select("indicator_id", host_and_port(F.col("value"))[0].alias("name"))), "name").select(F.lit("host").alias("field"), F.col("host").alias("value"), "indicator_id"))
    if {"host", "uri_path"} <= have:
        fields["url"] = F.concat("host", F.lit(" "), "uri_path")
        authority, path = url_parts(F.col("value"))
        urls = kind("url").select("indicator_id", authority.alias("authority"), path.alias("path")).filter("authority is not null")
        # Without a port or with a default one a request meets a URL without a port, with an explicit one also a URL of that port.
        mine = F.array_compact(F.array(F.when(port.isNull() | port.isin("80", "443"), name), F.concat(name, F.lit(":"), port)))
        asked = events.filter("host is not null and uri_path is not null").select("host", F.col("uri_path").alias("path")).distinct().withColumn("authority", F.explode(mine))
        atoms.append(asked.join(spread(urls), ["authority", "path"]).select(F.lit("url").alias("field"), F.concat("host", F.lit(" "), "path").alias("value"), "indicator_id"))
    wanted = written(reduce(DataFrame.unionByName, atoms).groupBy("field", "value").agg(F.collect_set("indicator_id").alias("ids")), "indicator-values")
    rows = events.select("event_id", *[v.alias(f"key_{c}") for c, v in fields.items()])
    near = is_small(wanted)
    for c in fields:
        mine = wanted.filter(F.col("field") == c).select(F.col("value").alias(f"key_{c}"), F.col("ids").alias(f"ids_{c}"))
        rows = rows.join(F.broadcast(mine) if near else mine, f"key_{c}", "left")
    hit = reduce(lambda a, b: a | b, [F.col(f"ids_{c}").isNotNull() for c in fields])
    none = F.lit(None).cast("string")
    every = F.array_distinct(F.flatten(F.array_compact(F.array(*[F.col(f"ids_{c}") for c in fields]))))
    found = rows.filter(hit).select("event_id", *[f"ids_{c}" for c in fields], F.explode(every).alias("indicator_id"))
    hits = F.array_compact(F.array(*[F.when(F.array_contains(f"ids_{c}", F.col("indicator_id")), F.lit(c)).otherwise(none) for c in fields]))
    return found.select("event_id", "indicator_id", F.sort_array(hits).alias("fields"))


def indicator_validity(at: Column, begin: Column, end: Column) -> Column:
    """valid_from <= t < valid_until; unavailable for a bounded indicator at an unknown time."""
    bounded = begin.isNotNull() | end.isNotNull()
    inside = F.coalesce(at >= begin, F.lit(True)) & F.coalesce(at < end, F.lit(True))
    return F.when(at.isNull() & bounded, "unavailable").when(inside, "valid").otherwise("outside")


def ioc_summary(events: DataFrame, matches: DataFrame, indicators: DataFrame) -> DataFrame:
    """Per indicator: matched requests, peers, first and last time, matches outside validity."""
    at = W.epoch(F.col("ts"))
    rows = matches.join(events.select("event_id", "ts", "source_ip"), "event_id").join(small(indicators.select("indicator_id", "type", "valid_from", "valid_until")), "indicator_id")
    rows = rows.withColumn("validity", indicator_validity(F.col("ts"), F.col("valid_from"), F.col("valid_until")))
    return rows.groupBy("indicator_id", "type").agg(F.count("*").alias("matches"), F.countDistinct("source_ip").alias("peers"), F.min(at).alias("first_seen"), F.max(at).alias("last_seen"), F.count_if(F.col("validity") == "outside").alias("outside"), F.count_if(F.col("validity") == "unavailable").alias("unavailable"))


def ioc_fields(matches: DataFrame) -> DataFrame:
    """Per indicator and field it was met in: requests. A request counts in every field."""
    return matches.select("indicator_id", F.explode("fields").alias("field")).groupBy("indicator_id", "field").agg(F.count("*").alias("requests"))


def ioc_totals(events: DataFrame, matches: DataFrame, indicators: DataFrame) -> DataFrame:
    """One row: requests, those that any indicator met, (request, indicator) pairs, indicators and those met."""
    met = matches.agg(F.countDistinct("event_id").alias("matched_requests"), F.count("*").alias("pairs"), F.countDistinct("indicator_id").alias("indicators_matched"))
    return events.agg(F.count("*").alias("requests")).join(F.broadcast(met)).join(F.broadcast(indicators.agg(F.countDistinct("indicator_id").alias("indicators"))))


def condition(tree: dict, columns: list[str]) -> Column:
    """A defensive condition as a Boolean: a missing field is false, its negation true, an empty AND or OR false."""
    kind = tree["kind"]
    if kind in ("and", "or"):
        parts = [condition(t, columns) for t in tree["conditions"]]
        return reduce((lambda a, b: a & b) if kind == "and" else (lambda a, b: a | b), parts) if parts else F.lit(False)
    if kind == "not":
        return ~condition(tree["condition"], columns)
    field = {"uri": "uri_path", "query": "uri_query", "method": "method", "host": "host", "ja3": "ja3", "ja4": "ja4", "user_agent": "user_agent"}
    name = next((c for k, c in field.items() if kind.startswith(k + "_")), None)
    if kind == "source_address_set":
        test = N.in_any_v4(F.col("source_ip"), tree["networks"]) | F.coalesce(N.canonical_or_raw(F.col("source_ip")).isin(tree.get("addresses", [])), F.lit(False))
    elif kind.startswith("header_"):
        holds = (lambda v: v == tree["value"]) if kind.endswith("equals") else (lambda v: v.contains(tree["value"]))
        test = F.exists(F.col("headers"), lambda h: (F.lower(h["name"]) == tree["name"].lower()) & holds(h["value"])) if "headers" in columns else F.lit(False)
    else:
        column = F.col(name) if name in columns else F.lit(None).cast("string")
        value = tree["value"]
        if kind.endswith("ascii_case_insensitive"):
            column, value = F.lower(column), value.lower()
        test = column.contains(value) if "_contains" in kind else column.startswith(value) if "_starts_with" in kind else column == value
    return F.coalesce(test, F.lit(False))


def condition_fields(tree: dict) -> list[str]:
    if tree["kind"] in ("and", "or"):
        return sorted({f for t in tree["conditions"] for f in condition_fields(t)})
    if tree["kind"] == "not":
        return condition_fields(tree["condition"])
    head = tree["kind"].split("_")[0]
    return [{"uri": "uri_path", "query": "uri_query", "user": "user_agent", "source": "source_ip", "header": "headers"}.get(head, head)]


def absent_condition_fields(tree: dict) -> Column:
    return reduce(lambda a, b: a | b, [F.col(c).isNull() for c in condition_fields(tree)])


def resolve_client_ip(events: DataFrame, proxies: list[str]) -> DataFrame:
    """client_ip: the right-most forwarded address outside the trusted networks, if the peer is trusted and every hop parses.

    Addresses of both families count, and are given in canonical spelling.
    """
    hops = F.transform(F.split(W.header_value(F.col("headers"), "x-forwarded-for"), ","), lambda h: F.trim(h))
    parse = F.forall(hops, lambda h: N.ip_hex(h).isNotNull())
    outside = F.filter(hops, lambda h: ~N.in_any(h, proxies))
    found = F.when(N.in_any(F.col("source_ip"), proxies) & parse & (F.size(outside) > 0), N.canonical_ip(F.element_at(outside, -1)))
    return events.withColumn("client_ip", found)


def select_templates(detections: DataFrame, allow: dict[str, list[str]] | None = None, deny: dict[str, list[str]] | None = None, exclude_unknown: bool = False) -> DataFrame:
    """Add ``reason``: kept, denied, not-allowed or unknown-vendor, by lists of vendor, products and tags, compared without case.

    Deny beats allow. With an allow list a template has to be on it by any of the three. Unknown vendors stay unless asked.
    """

    def listed(name: str, values: list[str]) -> Column:
        low = [v.lower() for v in values]
        return F.lower(name).isin(low) if name == "vendor" else F.exists(name, lambda x: F.lower(x).isin(low))

    on = lambda lists: reduce(lambda a, b: a | b, [F.coalesce(listed(n, v), F.lit(False)) for n, v in (lists or {}).items()], F.lit(False))
    reason = F.when(on(deny), "denied")
    if exclude_unknown:
        reason = reason.when(F.col("vendor").isNull(), "unknown-vendor")
    if allow:
        reason = reason.when(~on(allow) & F.col("vendor").isNotNull(), "not-allowed")
    return detections.withColumn("reason", reason.otherwise("kept"))


def known_rereplay(matches: DataFrame, findings: DataFrame) -> DataFrame:
    """Add ``kind``: known (the request id was a finding of the CVE), other, or other-without-id."""
    known = findings.filter("request_id is not null").select("cve", "request_id").distinct().withColumn("known", F.lit(True))
    return matches.join(known, ["cve", "request_id"], "left").withColumn("kind", F.when(F.col("known"), "known").when(F.col("request_id").isNull(), "other-without-id").otherwise("other")).drop("known")
