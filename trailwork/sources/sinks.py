"""Sinks: findings, runs, address lists, sanitized tables, threat-intelligence objects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailwork.functions import network as N


def flat_findings(findings: DataFrame) -> DataFrame:
    """Arrays of text joined by ; and anything else nested as JSON, for CSV."""
    out = []
    for f in findings.schema.fields:
        if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StringType):
            out.append(F.array_join(f.name, ";").alias(f.name))
        elif isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType)):
            out.append(F.to_json(f.name).alias(f.name))
        else:
            out.append(F.col(f.name))
    return findings.select(*out)


def write_findings(findings: DataFrame, path: str, form: str = "jsonl") -> None:
    """jsonl (gzip) or csv; never over an existing folder."""
    if form == "jsonl":
        findings.write.mode("errorifexists").json(path, compression="gzip")
    elif form == "csv":
        flat_findings(findings).write.mode("errorifexists").csv(path, header=True)
    else:
        raise ValueError("form must be jsonl or csv")


def write_run(run_id: str, tables: dict[str, DataFrame], path: str) -> None:
    """Each table as Parquet under its name, partitioned by run_id; an existing run is never overwritten."""
    for name, table in tables.items():
        table.write.mode("errorifexists").parquet(f"{path}/{name}/run_id={run_id}")


def write_address_list(sources: DataFrame, path: str, column: str = "source_ip") -> None:
    """Distinct addresses in canonical spelling, one a line, sorted; what is no address is left out.

    Sources with a column ``identity`` give one list an identity, in a folder of its name.
    """
    by = ["identity"] if "identity" in sources.columns else []
    rows = sources.select(*by, N.canonical_ip(F.col(column)).alias(column)).filter(F.col(column).isNotNull()).distinct().orderBy(*by, column)
    rows.write.mode("errorifexists").partitionBy(*by).text(path)


#: Columns with raw values, which sanitized tables never hold.
RAW = ("uri", "uri_path", "uri_query", "uri_fragment", "source_ip", "client_ip", "host", "user_agent", "referer", "request_id", "request_body", "raw", "headers", "ja3", "ja4", "value", "top_path", "path", "entity", "pattern")


def sanitize(table: DataFrame, keep_text: tuple[str, ...] = ("cve", "severity", "template_id", "template_ids", "outcome", "state", "label", "tier", "metric", "reason", "action", "class", "field", "rung", "feature", "run_id")) -> DataFrame:
    """Numbers, Booleans, times and text of a closed vocabulary; everything else goes."""
    plain = (T.NumericType, T.BooleanType, T.TimestampType, T.DateType)
    return table.select(*[f.name for f in table.schema.fields if f.name not in RAW and (isinstance(f.dataType, plain) or f.name in keep_text)])


def stable_id(*parts: Column) -> Column:
    """A UUID-shaped id from SHA-256 of the parts."""
    h = F.sha2(F.concat_ws("|", *parts), 256)
    cut = lambda a, n: F.substring(h, a, n)
    return F.concat(cut(1, 8), F.lit("-"), cut(9, 4), F.lit("-5"), cut(14, 3), F.lit("-a"), cut(18, 3), F.lit("-"), cut(21, 12))


def observables(findings: DataFrame) -> DataFrame:
    """(kind, value) of what findings were seen with, once each: ipv4-addr, ipv6-addr and uri-path. What is no address is left out.

    These are raw values: exports hold them only where they are given.
    """
    ip = N.canonical_ip(F.col("source_ip"))
    kind = F.when(ip.contains(":"), "ipv6-addr").otherwise("ipv4-addr")
    addresses = findings.select(F.when(ip.isNotNull(), kind).alias("kind"), ip.alias("value"))
    return addresses.unionByName(findings.select(F.lit("uri-path").alias("kind"), F.col("uri_path").alias("value"))).filter("value is not null").distinct()


def export_stix(summary: DataFrame, run_id: str, seen: DataFrame | None = None) -> DataFrame:
    """(type, id, object): a vulnerability and a note with its counts for each CVE of a summary, sorted by type and id.

    ``seen`` (see ``observables``) adds an object a value. Ids follow from the contents, so the same run gives the same rows.
    """
    vulnerability = F.concat(F.lit("vulnerability--"), stable_id(F.lit("vulnerability"), F.col("cve")))
    note = F.concat(F.lit("note--"), stable_id(F.lit("note"), F.lit(run_id), F.col("cve")))
    v = summary.select(F.lit("vulnerability").alias("type"), vulnerability.alias("id"), F.to_json(F.struct(F.lit("vulnerability").alias("type"), F.lit("2.1").alias("spec_version"), vulnerability.alias("id"), F.col("cve").alias("name"))).alias("object"))
    counts = [F.col(c).alias(f"x_{c}") for c in ("detectability", "template_ids", "distinctive", "generic") if c in summary.columns]
    n = summary.select(F.lit("note").alias("type"), note.alias("id"), F.to_json(F.struct(F.lit("note").alias("type"), F.lit("2.1").alias("spec_version"), note.alias("id"), F.concat(F.lit("matching requests: "), F.col("requests")).alias("content"), F.array(vulnerability).alias("object_refs"), F.col("requests").alias("x_requests"), *counts)).alias("object"))
    out = v.unionByName(n)
    if seen is not None:
        kind = F.when(F.col("kind") == "uri-path", "x-uri-path").otherwise(F.col("kind"))
        name = F.concat(kind, F.lit("--"), stable_id(kind, F.col("value")))
        out = out.unionByName(seen.select(kind.alias("type"), name.alias("id"), F.to_json(F.struct(kind.alias("type"), F.lit("2.1").alias("spec_version"), name.alias("id"), F.col("value"))).alias("object")))
    return out.orderBy("type", "id")


def export_misp(summary: DataFrame, run_id: str, seen: DataFrame | None = None) -> DataFrame:
    """(uuid, attribute): one vulnerability attribute a CVE and, with ``seen``, one a source address or path; sorted."""
    uuid = stable_id(F.lit("misp"), F.lit(run_id), F.col("cve"))
    attribute = lambda u, kind, category, value, comment: F.to_json(F.struct(u.alias("uuid"), kind.alias("type"), F.lit(category).alias("category"), value.alias("value"), comment.alias("comment")))
    out = summary.select(uuid.alias("uuid"), attribute(uuid, F.lit("vulnerability"), "External analysis", F.col("cve"), F.concat(F.lit("requests="), F.col("requests"))).alias("attribute"))
    if seen is not None:
        kind = F.when(F.col("kind") == "uri-path", "uri").otherwise("ip-src")
        mine = stable_id(F.lit("misp"), F.lit(run_id), kind, F.col("value"))
        out = out.unionByName(seen.select(mine.alias("uuid"), attribute(mine, kind, "Network activity", F.col("value"), F.lit("seen with a match, which is no verdict")).alias("attribute")))
    return out.orderBy("uuid")
