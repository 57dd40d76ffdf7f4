"""Mixing sources to target weights by subset-sum budget fitting.

Every source gets a word budget. Whole passes over a source cover most of it; the rest is a subset-sum problem over exact
text lengths: documents are counted by (source, length), a proportional share of every length is taken, and a
bounded-knapsack programme over the leftover counts, and over a part of the taken ones that is given back, fits the
remaining words. Which documents of a length are taken is decided by a seeded hash of doc_id and text, so reruns agree: those
whose hash lies below a cut of their source and length. Only the counts reach the fitting step; documents are ranked by a
range-partitioned sort, so no source, length or run of equal rows has to fit one task, and texts aren't shuffled.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailwork.llm.common import in_order, materialize

WEIGHTS = (3, 1, 2)
SHARE = (3, 2)
REPEAT = 2
#: About half of this many words, or LONGEST times the longest text where that is more, are left to the dynamic programme.
MOST_LEFT = 200_000
LONGEST = 4
#: The programme holds reached sums as an array up to this many words, else as a sorted list.
MOST_DENSE = 4_000_000
#: Tables of sources, or of sources and lengths, are broadcast up to this many rows and this many bytes of a source's name, else joined by a shuffle.
MOST_BROADCAST, LONGEST_NAME = 200_000, 200


def draw_of(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("source"), F.crc32(F.col("text").cast("binary")))


def water_fill(sources: DataFrame, share: tuple[int, int] = SHARE, repeat: int = REPEAT) -> DataFrame:
    """Add ``target`` to (size, weight): shares of the pool by weight, none above repeat times its size; what is over is shared anew.

    The pool is that share of all sizes. A round is one aggregate over the sources: those above their bound stay there, and
    what is left is shared by the weight of the others, until none is above.
    """
    bound = repeat * F.col("size")
    total = sources.agg(F.sum("size").alias("n"), F.sum("weight").alias("w")).first()
    pool = (total.n or 0) * share[0] / share[1]
    left, weight, capped = pool, total.w or 1, 0
    while True:
        over = F.lit(left) * F.col("weight") / F.lit(weight) > bound
        r = sources.agg(F.count_if(over).alias("k"), F.sum(F.when(over, bound).otherwise(0)).alias("n"), F.sum(F.when(over, 0).otherwise(F.col("weight"))).alias("w")).first()
        if (r.k or 0) <= capped:
            return sources.withColumn("target", F.when(over, bound.cast("double")).otherwise(F.lit(left) * F.col("weight") / F.lit(weight)))
        capped, left, weight = r.k, pool - r.n, r.w or 1


def programme(left: int, counts: dict[int, int]) -> dict[int, int]:
    """How many of each length to take so that the sum is the largest that does not exceed ``left``: bounded knapsack."""
    dense = left <= MOST_DENSE
    # Sums are multiples of the lengths' common divisor, so none lies between this one and left.
    goal = left - left % (math.gcd(*[k for k in counts if counts[k] > 0]) or 1)
    # reached[s]: s words can be had; by, used: the length and its count that first reached a sum.
    if dense:
        reached = np.zeros(left + 1, bool)
        reached[0] = True
        by, used = np.zeros(left + 1, np.int64), np.zeros(left + 1, np.int64)
    else:
        sums, by, used = (np.zeros(1, np.int64) for _ in range(3))
    for k in sorted((k for k in counts if 0 < k <= left and counts[k] > 0), reverse=True):
        if reached[goal] if dense else sums[-1] == goal:
            break
        was = np.flatnonzero(reached) if dense else sums
        for j in range(1, min(counts[k], left // k) + 1):
            to = was + j * k
            to = to[to <= left]
            if not len(to):
                break
            if dense:
                new = to[~reached[to]]
                reached[new], by[new], used[new] = True, k, j
            else:
                at = np.searchsorted(sums, to)
                new = to[(at == len(sums)) | (sums[np.minimum(at, len(sums) - 1)] != to)]
                at = np.searchsorted(sums, new)
                sums, by, used = np.insert(sums, at, new), np.insert(by, at, k), np.insert(used, at, j)
    out = dict.fromkeys(counts, 0)
    at = int(np.flatnonzero(reached)[-1]) if dense else int(sums[-1])
    while at:
        i = at if dense else int(np.searchsorted(sums, at))
        k, j = int(by[i]), int(used[i])
        out[k] += j
        at -= k * j
    return out


def fit(budget: int, counts: dict[int, int]) -> dict[int, int]:
    """How many documents of each length to take so that their lengths sum to ``budget`` as nearly as can be, never above.

    Proportional part first, then the largest lengths while much is left, then bounded-knapsack dynamic programming. As
    long as the sum misses the budget (or the multiple of the lengths' common divisor below it), a larger part of what was
    taken is given back to the programme, up to all of it, where the sum is the best there is, or MOST_DENSE words.
    """
    total = sum(k * n for k, n in counts.items())
    taken = {k: 0 for k in counts}
    if budget <= 0 or not total:
        return taken
    if budget >= total:
        return dict(counts)
    goal = budget - budget % math.gcd(*[k for k, n in counts.items() if n > 0])
    longest = max(k for k in counts if k <= budget or k == min(counts))
    room = max(MOST_LEFT // 2, LONGEST * longest)
    left = budget
    for k, n in counts.items():
        taken[k] = n * budget // total
        left -= k * taken[k]
    for k in sorted(counts, reverse=True):
        if left <= room:
            break
        more = min(counts[k] - taken[k], (left - room) // k if k else 0)
        taken[k] += more
        left -= k * more
    best: dict[int, int] = {}
    most = -1
    while True:
        more = programme(left, {k: n - taken[k] for k, n in counts.items()})
        found = {k: taken[k] + more[k] for k in counts}
        reached = sum(k * n for k, n in found.items())
        if reached > most:
            best, most = found, reached
        if most == goal or left == budget or left >= max(MOST_DENSE, LONGEST * room):
            return best
        back = min(1.0, (LONGEST * max(left, room) - left) / (budget - left))
        for k in counts:
            n = min(taken[k], math.ceil(taken[k] * back)) if k else 0
            taken[k] -= n
            left += k * n


def bounded(table: DataFrame) -> DataFrame:
    """Broadcast a written table with a column source if it has few enough rows and short enough names."""
    r = table.agg(F.count("*").alias("n"), F.max(F.octet_length("source")).alias("longest")).first()
    return F.broadcast(table) if r.n <= MOST_BROADCAST and (r.longest or 0) <= LONGEST_NAME else table


def _words(text: str) -> Column:
    return F.size(F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")).cast("long")


def _plan(docs: DataFrame, seed: int) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, source_no, size, draw, place) in order, and (source, size, source_no, source_size, target, first, passes, extra) of every source and length."""
    rows = materialize(docs.select("doc_id", "source", _words("text").alias("size"), draw_of(seed).alias("draw")), "mix-rows")
    sized = rows.groupBy("source").agg(F.sum("size").alias("size"))
    sources = in_order(sized.withColumn("last", F.col("source").isNull()), ["last", "source"], "mix-sources", "source_no")
    weight = F.get(F.array(*map(F.lit, WEIGHTS)), (F.col("source_no") % len(WEIGHTS)).cast("int"))
    plan = water_fill(materialize(sources.select("source_no", "source", "size", weight.alias("weight")), "mix-weights"))
    plan = materialize(plan.select("source_no", "source", F.col("size").alias("source_size"), "target"), "mix-targets")

    by_source = bounded(plan.select("source_no", "source")).withColumnRenamed("source", "its_source")
    numbered = rows.join(by_source, F.col("source").eqNullSafe(F.col("its_source"))).select("doc_id", "source_no", "size", "draw")
    # Equal rows are told apart by a number, so that a run of them can be cut.
    placed = in_order(numbered.withColumn("row", F.monotonically_increasing_id()), ["source_no", "size", "draw", "row"], "mix-placed").drop("row")
    counts = placed.groupBy("source_no", "size").agg(F.count("*").alias("n"), F.min("place").alias("first"))

    def fitted(pdf: pd.DataFrame) -> pd.DataFrame:
        n, target = int(pdf.source_size.iloc[0]), float(pdf.target.iloc[0])
        passes = int(min(REPEAT, target // n)) if n else 1
        extra = fit(int(round(target - passes * n)), dict(zip(pdf["size"].tolist(), pdf.n.tolist(), strict=True))) if passes < REPEAT else {}
        return pdf.assign(passes=passes, extra=[extra.get(k, 0) for k in pdf["size"].tolist()]).drop(columns="n")

    chosen = counts.join(plan, "source_no").groupBy("source_no").applyInPandas(fitted, "source_no long, size long, first long, source string, source_size long, target double, passes int, extra long")
    return placed, materialize(chosen, "mix-chosen")


def _ranked(placed: DataFrame, chosen: DataFrame) -> DataFrame:
    return placed.join(bounded(chosen), ["source_no", "size"]).withColumn("rank", F.col("place") - F.col("first"))


def mix_plan(docs: DataFrame, seed: int = 17) -> DataFrame:
    """Every row with size, source_size, target and ``copies`` (0 to 2), as doc_id, source and the columns named.

    A null text has size 0; a null source is a source of its own, last in order. Repeated rows of one doc_id and text are
    told apart by nothing, so which of them is taken doesn't matter. An empty table gives no rows.
    """
    ranked = _ranked(*_plan(docs, seed))
    return ranked.select("doc_id", "source", "size", "source_size", "target", "draw", (F.col("passes") + (F.col("rank") < F.col("extra")).cast("int")).alias("copies"))


def mix_report(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken of every row; taken counts repeats."""
    return mix_plan(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mixed(docs: DataFrame, seed: int = 17) -> DataFrame:
    """The mixed documents with their own columns: a row appears as often as it is taken.

    Of rows alike in doc_id, source and text as many are taken as the plan says; which ones is arbitrary.
    """
    placed, chosen = _plan(docs, seed)
    ranked = _ranked(placed, chosen)
    # The cut is the hash of the first row not taken; of equal rows at the cut some may be taken.
    cut = ranked.filter("rank = extra").select("source_no", "size", F.col("draw").alias("cut"))
    chosen = materialize(chosen.join(cut, ["source_no", "size"], "left"), "mix-cuts")
    ties = _ranked(placed, chosen).filter("draw = cut and rank < extra").groupBy("source_no", "size").agg(F.count("*").alias("ties"))
    cuts = materialize(chosen.join(ties, ["source_no", "size"], "left").select(F.col("source"), F.col("size").alias("__size"), "passes", "extra", "cut", F.coalesce("ties", F.lit(0)).alias("ties")), "mix-ties")
    plan = bounded(cuts).withColumnsRenamed({"source": "__source", "passes": "__passes", "extra": "__extra", "cut": "__cut", "ties": "__ties"})
    mine = docs.withColumns({"__mine": _words("text"), "__draw": draw_of(seed)})
    met = mine.join(plan, mine["source"].eqNullSafe(F.col("__source")) & (F.col("__mine") == F.col("__size")))
    below = F.coalesce(F.col("__draw") < F.col("__cut"), F.col("__extra") > 0)
    tied = F.coalesce((F.col("__draw") == F.col("__cut")) & (F.col("__ties") > 0), F.lit(False))
    sure = met.filter(~tied).withColumn("__take", F.col("__passes") + below.cast("int"))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    copies = lambda df: df.filter("__take > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__take")))).select(*columns)
    if cuts.filter("ties > 0").isEmpty():
        return copies(sure)
    nth = in_order(met.filter(tied).withColumn("__row", F.monotonically_increasing_id()), ["__draw", "__row"], "mix-tied", "__place")
    begin = nth.groupBy(F.col("__draw").alias("__key")).agg(F.min("__place").alias("__begin"))
    told = nth.join(begin, F.col("__draw") == F.col("__key")).withColumn("__take", F.col("__passes") + (F.col("__place") - F.col("__begin") < F.col("__ties")).cast("int"))
    return copies(sure).unionByName(copies(told))
