"""Incremental forms: new files only, tumbling rates with a watermark and late rows counted, stateless matching, idempotent stores.

What a batch adds is written under its number, over what an earlier attempt of the same batch may have left, so a batch that
is run again counts once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailwork.functions import web as W
from trailwork.functions.tables import shared_folder
from trailwork.operators import compare, matching
from trailwork.sources import logs


def stream_events(spark: SparkSession, path: str, parse: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Lines of files that the checkpoint hasn't seen, parsed. A line's number is its order within its batch's split."""
    lines = spark.readStream.option("recursiveFileLookup", "true").text(path)
    return parse(lines.select(F.col("_metadata.file_path").alias("input_file"), F.lit(None).cast("long").alias("line_number"), F.col("value").alias("line")).filter(F.trim("line") != ""))


def stream_numbered_events(spark: SparkSession, path: str, store_path: str, parse: Callable[[DataFrame], DataFrame]):
    """A writer that parses files the checkpoint hasn't seen, with the physical numbers of their lines, into ``store_path``.

    A file comes whole in one batch, so its lines are numbered there as in a batch read.
    """

    def append(batch: DataFrame, batch_id: int) -> None:
        parse(logs.numbered_lines(batch)).write.mode("overwrite").parquet(f"{store_path}/batch={batch_id}")

    return logs.raw_lines(spark.readStream.option("recursiveFileLookup", "true").text(path)).writeStream.foreachBatch(append)


def stream_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def stream_request_rates(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Requests of each tumbling window, final once the watermark has passed; later rows are dropped."""
    return events.filter("ts is not null").withWatermark("ts", late).groupBy(F.window("ts", width)).agg(F.count("*").alias("requests")).select(F.unix_timestamp("window.start").alias("start"), "requests")


def stream_rates_with_late(events: DataFrame, store_path: str, width: int = 3600, late: int = 7200):
    """A writer that adds each batch's requests by window to ``store_path``, and counts those too late for theirs apart.

    The watermark of a batch is the latest time of all batches before, less ``late`` seconds; a request is late whose window
    of ``width`` seconds ended by then. Undated requests are counted too, so all counts add up to the rows that came.
    """
    spark = events.sparkSession
    spark.createDataFrame([], "latest long").write.mode("ignore").parquet(f"{store_path}/seen/batch=-1")

    def append(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        before = session.read.schema("latest long, batch long").parquet(f"{store_path}/seen").filter(F.col("batch") < batch_id).agg(F.max("latest").alias("latest")).first().latest
        at = W.epoch(F.col("ts"))
        start = F.floor(at / width) * width
        too_late = F.coalesce(start + width <= before - late, F.lit(False)) if before is not None else F.lit(False)
        rows = batch.groupBy(start.alias("start"), too_late.alias("late")).agg(F.count("*").alias("requests"), F.max(at).alias("latest"))
        rows.write.mode("overwrite").parquet(f"{store_path}/rates/batch={batch_id}")
        written = session.read.schema("start long, late boolean, requests long, latest long").parquet(f"{store_path}/rates/batch={batch_id}")
        written.agg(F.max("latest").alias("latest")).write.mode("overwrite").parquet(f"{store_path}/seen/batch={batch_id}")

    return events.writeStream.foreachBatch(append)


def read_stream_rates(spark: SparkSession, store_path: str) -> DataFrame:
    """(start, requests, late): of every window the requests counted and those that came too late for it; undated ones have a NULL start."""
    rows = spark.read.schema("start long, late boolean, requests long, latest long, batch long").parquet(f"{store_path}/rates")
    return rows.groupBy("start").agg(F.coalesce(F.sum(F.when(~F.col("late"), F.col("requests"))), F.lit(0)).alias("requests"), F.coalesce(F.sum(F.when(F.col("late"), F.col("requests"))), F.lit(0)).alias("late"))


def stream_match(events: DataFrame, detections: DataFrame) -> DataFrame:
    """Stream-static join on the path with its residual conditions; stateless, so a template may match by several ordinals."""
    return matching.detection_hits(events, detections)


def stream_observation_store(events: DataFrame, store_path: str, bits: int = 24):
    """A writer that appends each batch's blocks under run_id batch-N, once even when a batch is run again."""

    def append(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = compare.observations(batch.withColumn("run_id", F.lit(f"batch-{batch_id}")), bits)
        rows.drop("run_id").write.mode("overwrite").parquet(f"{store_path}/run_id=batch-{batch_id}")

    return events.writeStream.foreachBatch(append)


def run_available(frame: DataFrame, mode: str = "append") -> DataFrame:
    """Run a streaming query over all input there is, into a Parquet table in the shared folder, and read it."""
    import uuid

    spark = frame.sparkSession
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    frame.writeStream.format("parquet").option("path", f"{base}/table").option("checkpointLocation", f"{base}/state").outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(frame.schema).parquet(f"{base}/table")
