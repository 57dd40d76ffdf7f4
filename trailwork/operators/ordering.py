"""Order without windows over whole groups: neighbours across borders, places by a range sort, distinct values in sliding windows.

A group that holds a third of all rows is cut into buckets of bounded length; what has to cross a bucket's border is one
row a bucket, so no task has to hold or walk through a whole group.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trailwork.functions.tables import written


def with_previous(rows: DataFrame, keys: Iterable[str], bucket: Column, order: str, value: str, out: str = "before") -> DataFrame:
    """Add the value of the row before in the order of a key, NULL for its first row.

    ``bucket`` grows with ``order`` and bounds how many rows are sorted together. Each bucket gets one more row, the last of
    the nearest bucket before it, in front of its own. Order and value aren't NULL.
    """
    keys = list(keys)
    cut = rows.withColumn("__bucket", bucket)
    last = cut.groupBy(*keys, "__bucket").agg(F.max_by(value, order).alias("__value"))
    carried = F.lag("__value").over(Window.partitionBy(*keys).orderBy("__bucket"))  # a row a bucket
    front = last.withColumn("__carried", carried).filter("__carried is not null").select(*keys, "__bucket", F.col("__carried").alias(value), F.lit(True).alias("__front"))
    both = cut.withColumn("__front", F.lit(False)).unionByName(front, allowMissingColumns=True)
    before = F.lag(value).over(Window.partitionBy(*keys, "__bucket").orderBy(F.desc("__front"), order))
    return both.withColumn(out, before).filter(~F.col("__front")).drop("__front", "__bucket")


def numbered(rows: DataFrame, order: list[Column | str], out: str = "place") -> DataFrame:
    """The rows with their place (1, 2, ...) in a total order, by a range sort.

    The sorted rows are written; a place is a row's number in its partition on top of the rows of the partitions before,
    whose counts are one row a partition.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_rows = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id())
    kept = written(sorted_rows, "ordered").withColumn("__part", F.shiftright("__id", 33))
    counts = kept.groupBy("__part").agg(F.count("*").alias("__n"))
    ahead = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a partition
    placed = kept.join(F.broadcast(counts.select("__part", ahead.alias("__ahead"))), "__part")
    return placed.withColumn(out, F.col("__ahead") + F.col("__id").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("__id", "__part", "__ahead")


def sliding_distinct(rows: DataFrame, keys: Iterable[str], widths: Iterable[int], kinds: dict[str, Column], ms: str = "ms") -> DataFrame:
    """(keys, width, ms, one count for each kind): distinct values seen in the ``width`` seconds up to ``ms``, both ends included.

    Every occurrence opens a value's interval, which ends after the width or at the value's next occurrence. Intervals are
    cut where buckets as long as the window begin, so that the sums of opened and closed intervals start anew in each: no
    sort holds more than one entity's times of two widths, and no set is kept at all. There is a row for every time at which
    a count changes, so maxima over rows are maxima over time. Rows without a time are left out, NULL values not counted.
    """
    keys, names = list(keys), list(kinds)
    given = F.array_compact(F.array(*[F.when(v.isNotNull(), F.struct(F.lit(n).alias("kind"), v.cast("string").alias("value"))) for n, v in kinds.items()]))
    seen = rows.filter(F.col(ms).isNotNull()).select(*keys, F.col(ms).alias("at"), F.explode(given).alias("__v")).select(*keys, "at", "__v.kind", "__v.value").distinct()
    spans = F.explode(F.array(*[F.struct(F.lit(w).alias("width"), F.lit(w * 1000 + 1).cast("long").alias("span")) for w in dict.fromkeys(widths)]))
    floor = lambda t: t - F.pmod(t, F.col("span"))
    seen = seen.select("*", spans.alias("__w")).select(*keys, "at", "kind", "value", "__w.width", "__w.span").withColumn("start", floor(F.col("at")))
    of = [*keys, "width", "span", "kind", "value"]
    # The first occurrence of a bucket stands behind those of the bucket before, where it is the next one.
    behind = seen.groupBy(*of, "start").agg(F.min("at").alias("at")).withColumns({"start": F.col("start") - F.col("span"), "behind": F.lit(True)})
    following = F.lead("at").over(Window.partitionBy(*of, "start").orderBy("at"))
    opened = seen.withColumn("behind", F.lit(False)).unionByName(behind).withColumn("next", following).filter(~F.col("behind"))
    end, border = F.least(F.col("at") + F.col("span"), F.coalesce("next", F.col("at") + F.col("span"))), F.col("start") + F.col("span")
    step = lambda start, at, by: F.struct(start.alias("start"), at.alias("at"), F.lit(by).alias("by"))
    steps = F.array_compact(F.array(
        step(F.col("start"), F.col("at"), 1), F.when(end < border, step(F.col("start"), end, -1)), F.when(end > border, step(border, border, 1)), F.when(end > border, step(border, end, -1)),
    ))
    moves = opened.select(*keys, "width", "kind", F.explode(steps).alias("__s")).select(*keys, "width", "kind", "__s.*")
    summed = moves.groupBy(*keys, "width", "start", "at").agg(*[F.sum(F.when(F.col("kind") == n, F.col("by")).otherwise(0)).alias(n) for n in names])
    running = Window.partitionBy(*keys, "width", "start").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    return summed.select(*keys, "width", F.col("at").alias(ms), *[F.sum(n).over(running).alias(n) for n in names])
