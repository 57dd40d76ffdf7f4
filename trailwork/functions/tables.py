"""Tables that joins may broadcast, and tables written into the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows, and bytes of their values as text, up to which a rule-side table is broadcast.
MOST_BROADCAST, MOST_BYTES = 200_000, 64 << 20


def is_small(table: DataFrame) -> bool:
    """Whether a table is within both bounds; no more than the bound and one more of its rows are looked at."""
    size = F.sum(F.octet_length(F.to_json(F.struct("*")))) if table.columns else F.lit(0)
    seen = table.limit(MOST_BROADCAST + 1).agg(F.count("*").alias("n"), size.alias("bytes")).first()
    return seen.n <= MOST_BROADCAST and (seen["bytes"] or 0) <= MOST_BYTES


def small(table: DataFrame) -> DataFrame:
    """Broadcast a rule-side table if it is small; otherwise leave the same equi-join to a shuffle."""
    return F.broadcast(table) if is_small(table) else table


def once(rows: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are worked out once a row, however often they are used later.

    They come out of a generator of one row, which the optimizer moves neither filters nor other columns through.
    """
    return rows.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir where the cluster sets it, else a scratch folder (tests)."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("trailwork.folder", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("trailwork.folder", found)
    return found


def written(table: DataFrame, name: str) -> DataFrame:
    """The table, written into the shared folder and read back: later steps neither repeat it nor lose it with an executor."""
    path = f"{shared_folder(table.sparkSession)}/{name}-{uuid.uuid4().hex}"
    table.write.parquet(path)
    return table.sparkSession.read.schema(table.schema).parquet(path)
