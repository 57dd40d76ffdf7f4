"""Connected components of a table of links, by alternating large and small stars on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailwork.llm.common import materialize


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b); root is the smallest node of its component.

    Each round is two aggregations and two joins over the links that are left, written to the shared folder, until the
    links no longer change; only a checksum reaches the driver. Hubs stay rows of a join, never one list.
    """

    def star(edges: DataFrame, larger: bool) -> DataFrame:
        """edges (u, v) with u > v."""
        if larger:
            both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        else:
            both = edges
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        tied = both.join(least, "u")
        if larger:
            out = tied.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            out = tied.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        return out.filter("u > v").distinct()

    edges = materialize(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct(), "links")
    seen = None
    for _ in range(rounds):
        check = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if not check.n or check == seen:
            break
        seen = check
        edges = materialize(star(star(edges, True), False), "stars")
    else:
        raise RuntimeError(f"links did not settle in {rounds} rounds")
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots.select("node", F.col("node").alias("root")))
