"""Contiguous shards of near equal bytes.

Rows are range-partitioned by (text_crc32, doc_id), so that equal texts stand together and no key can fill a partition.
Each partition writes running sums of its own sizes; the totals of the partitions, one small row each, give every
partition its offset in the global prefix sum, and the shards are cut at equal byte targets. A cut moves to the next
border between different texts when one lies within ``snap`` of a target; otherwise it falls inside a run of equal texts,
since the byte law comes first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailwork.llm.common import materialize


NAMES = ("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def with_prefix(rows: DataFrame, partitions: int) -> DataFrame:
    """Rows in the order of text_crc32 and doc_id, with partition, running bytes and running count in the partition."""

    def running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, size, count = TaskContext.get().partitionId(), 0, 0
        for b in batches:
            sizes = b.column("size").to_numpy()
            ends = size + np.cumsum(sizes)
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(np.full(len(sizes), part, np.int32)), pa.array(ends - sizes), pa.array(count + np.arange(len(sizes), dtype=np.int64))],
                names=[*b.schema.names, "part", "before", "at"],
            )
            if len(sizes):
                size, count = int(ends[-1]), count + len(sizes)

    ordered = rows.repartitionByRange(partitions, "text_crc32", "doc_id").sortWithinPartitions("text_crc32", "doc_id")
    schema = T.StructType(list(rows.schema.fields)).add("part", T.IntegerType()).add("before", T.LongType()).add("at", T.LongType())
    return ordered.mapInArrow(running, schema)


def shard_by_bytes(docs: DataFrame, shards: int = 8, snap: float = 0.005, keep: bool = False) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row; with ``keep`` after the columns of the row.

    Size is the UTF-8 bytes of the text (null: none) plus 1; a null text has no crc and comes first, a null doc_id comes
    before others of the same text. Repeated rows each get a slot of their own. Columns of the row that have the name of one
    of these give way to it. An empty table gives no rows.
    """
    spark = docs.sparkSession
    measured = [F.col("doc_id").cast("long").alias("doc_id"), (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(F.col("text").cast("binary")).alias("text_crc32")]
    own = [c for c in docs.columns if c not in NAMES] if keep else []
    rows = docs.select(*measured, *([F.struct(*[F.col(f"`{c}`") for c in own]).alias("row")] if own else []))
    along = ["row"] if own else []
    kept = materialize(with_prefix(rows, int(spark.conf.get("spark.sql.shuffle.partitions"))), "shard-prefix")
    # One row a partition: bounded by the number of partitions, whatever the number of documents.
    totals = sorted((r.part, r.bytes, r.n) for r in kept.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect())
    offsets, total, count = [], 0, 0
    for part, size, n in totals:
        offsets.append((part, total, count))
        total, count = total + size, count + n
    where = F.broadcast(spark.createDataFrame(offsets, "part int, part_bytes long, part_rows long"))
    placed = kept.join(where, "part").select(*along, "doc_id", "size", "text_crc32", (F.col("before") + F.col("part_bytes")).alias("before"), (F.col("at") + F.col("part_rows")).alias("at"))

    targets = [total * i // shards for i in range(1, shards)]
    reach = int(total / shards * snap)
    cuts = list(targets)
    near = [(F.abs(F.col("before") - t) <= reach, i) for i, t in enumerate(targets)]
    cut = F.lit(None).cast("int")
    for close, i in near:
        cut = F.when(close, F.lit(i)).otherwise(cut)
    # Where each text begins near a target; the first text of a zone may begin before it, so it is no border.
    borders = placed.withColumn("cut", cut).filter("cut is not null").groupBy("cut", "text_crc32").agg(F.min("before").alias("border"))
    goal = F.element_at(F.array(*[F.lit(t) for t in targets]), F.col("cut") + 1) if targets else F.lit(0)
    firsts = borders.groupBy("cut").agg(F.min("border").alias("first"))
    best = borders.join(F.broadcast(firsts), "cut").filter("border > first").groupBy("cut").agg(F.min_by("border", F.struct(F.abs(F.col("border") - goal), "border")).alias("border"))
    for r in best.collect():
        cuts[r["cut"]] = r.border
    shard = sum(((F.col("before") >= F.lit(c)).cast("int") for c in cuts), F.lit(0)) if cuts else F.lit(0)
    sharded = placed.withColumn("shard", shard)
    begins = {r.shard: r.begin for r in sharded.groupBy("shard").agg(F.min("at").alias("begin")).collect()}
    begin = F.lit(0).cast("long")
    for s, at in begins.items():
        begin = F.when(F.col("shard") == s, F.lit(at)).otherwise(begin)
    out = sharded.select(*along, "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), (F.col("at") - begin).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    return out.select("doc_id", *[F.col(f"row.`{c}`").alias(c) for c in own], *NAMES[1:])


def write_shards(docs: DataFrame, path: str, shards: int = 8) -> None:
    """Write the documents into one folder a shard, in the order of their slots; repeated rows are written as often as they come."""
    sharded = shard_by_bytes(docs, shards, keep=True)
    n = max(shards, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    sharded.repartitionByRange(n, "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
