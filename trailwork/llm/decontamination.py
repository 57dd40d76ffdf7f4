"""Benchmark decontamination by SimHash over item-sized windows, with DataFrame functions only.

A benchmark item of w words is compared with every window of w words of a text (the whole text where it is shorter). The
items are dealt to buckets by a hash. A window is fingerprinted for a bucket when it holds enough of the word 5-grams of the
bucket's items of that size to be able to reach the wanted similarity with one of them; this prefilter is exact, windows below
that count can't reach it, and it keeps a window from meeting items it shares too little with. The bag of a window's 5-grams is
made a set by numbering the occurrences of each, so that a repeated 5-gram weighs no more in one bit than as many different
ones, and Jaccard similarity of the sets is the weighted one of the bags. The 64-bit SimHash of the set meets the items of
its size through a multi-index: eight blocks of eight bits, and by the pigeonhole principle two fingerprints at most
``radius`` bits apart have a block at most radius // 8 bits apart, so the items are entered under every block value that
near, in their bucket. Pairs within the radius are verified exactly.

The work is done once for each different text, whatever the number of its copies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailwork.llm.common import materialize, unused

SHINGLE = 5
BITS, BLOCKS = 64, 8
#: As the members of the sets are all different, bits differ independently: with a probability of 0.161 at most at similarity
#: 0.8 (0.188 where a text is a word shorter than an item of nine), so more than 27 of 64 differ in four of a million such pairs at most.
RADIUS = 27
#: Buckets of items.
BUCKETS = 64
#: The shingles of the benchmark, and the texts found, are broadcast up to this many, else joined by a shuffle.
MOST_BROADCAST = 2_000_000


def words_column(text: str) -> Column:
    """Lower-case runs of letters and digits of a whole text; none for null."""
    return F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingles_column(words: Column, size: int = SHINGLE) -> Column:
    """Hash of the word n-gram at every position; a text of fewer words is one n-gram, one without words has none."""
    last = F.size(words) - size + 1
    several = F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.xxhash64(F.slice(words, i, size)))
    return F.when(F.size(words) > 0, several).otherwise(F.array().cast("array<bigint>"))


def numbered_column(ordered: Column) -> Column:
    """A sorted bag as a set: every member hashed with the number of equal ones before it."""
    return F.transform(ordered, lambda h, i: F.xxhash64(h, i + 1 - F.array_position(ordered, h)))


def simhash_column(bag: str) -> Column:
    """64-bit SimHash of an array column: a bit is set where more than half of its members have it set."""
    ones = f"aggregate({bag}, 0L, (n, h) -> n + (shiftrightunsigned(h, b) & 1L))"
    return F.expr(f"aggregate(transform(sequence(0, {BITS - 1}), b -> if(2 * {ones} > size({bag}), shiftleft(1L, b), 0L)), 0L, (x, y) -> x | y)")


def block_column(fingerprint: Column, at: Column) -> Column:
    """The at-th eight bits of a fingerprint."""
    return F.call_function("shiftrightunsigned", fingerprint, at * 8).bitwiseAND(F.lit(255).cast("long")).cast("int")


def near_masks(bits: int) -> list[int]:
    return [m for m in range(256) if m.bit_count() <= bits]


def fingerprinted(rows: DataFrame) -> DataFrame:
    """Rows with an array ``bag`` of shingles: the bag as a set, with its fingerprint ``print``."""
    sets = rows.withColumn("bag", F.array_sort("bag")).withColumn("bag", numbered_column(F.col("bag")))
    return sets.withColumn("print", simhash_column("bag"))


def benchmark_items(benchmark: DataFrame) -> DataFrame:
    """item, item_id, bucket, w (words), shingles; items without words or without an item_id are left out."""
    words = benchmark.filter("item_id is not null").select(F.monotonically_increasing_id().alias("item"), "item_id", words_column("text").alias("words")).filter(F.size("words") > 0)
    return words.select("item", "item_id", F.pmod(F.xxhash64("item_id", "words"), F.lit(BUCKETS)).cast("int").alias("bucket"), F.size("words").alias("w"), shingles_column(F.col("words")).alias("shingles"))


def window_starts(at: Column, need: Column, m: Column, last: Column) -> Column:
    """Where windows of m shingles begin (up to ``last``) that hold ``need`` of the sorted hits or more.

    A window that holds hits k .. k + need - 1 begins at or before hit k and ends at or after the other.
    """
    low = lambda k: F.greatest(F.get(at, k + need - 1) - m + 1, F.lit(0))
    high = lambda k: F.least(F.get(at, k), last)
    spans = F.transform(F.sequence(F.lit(0), F.size(at) - need), lambda k: F.when(high(k) >= low(k), F.sequence(low(k), high(k))).otherwise(F.array().cast("array<int>")))
    return F.array_distinct(F.flatten(spans))


def windows_of(texts: DataFrame, known: DataFrame, percent: int, carry: bool) -> DataFrame:
    """(key, w, bucket, start, bag) of the windows that could reach percent; texts: key, words; known: shingle, (w, bucket) of the items that have it.

    With ``carry`` the few hits take their text's shingles along; else they are fetched again by key.
    """
    made = texts.select("key", F.size("words").alias("n"), shingles_column(F.col("words")).alias("shingles"))
    along = ["shingles"] if carry else []
    # Outer, as the optimizer would test the arrays of an inner explode before it, by computing them once more a word.
    hits = made.select("key", "n", *along, F.posexplode_outer("shingles").alias("at", "shingle")).join(known, "shingle")
    by_size = hits.select("key", "n", *along, "at", F.inline("sizes"))
    found = by_size.groupBy("key", "w", "bucket").agg(F.first("n").alias("n"), F.sort_array(F.collect_set("at")).alias("at"), *[F.first(c).alias(c) for c in along])
    # Shingles in a window of w words; a shorter text is one window of its own.
    found = found.withColumns({"m": F.greatest(F.least("w", "n") - (SHINGLE - 1), F.lit(1)), "last": F.greatest(F.col("n") - F.col("w"), F.lit(0))})
    need = F.ceil(percent * (F.col("m") + F.greatest(F.col("w") - (SHINGLE - 1), F.lit(1))) / F.lit(100 + percent)).cast("int")
    found = found.withColumn("need", need).filter(F.size("at") >= F.col("need"))
    starts = found.select("key", "w", "bucket", "m", *along, window_starts(F.col("at"), F.col("need"), F.col("m"), F.col("last")).alias("starts"))
    if not carry:
        starts = texts.join(starts, "key").select("key", "w", "bucket", "m", "starts", shingles_column(F.col("words")).alias("shingles")).dropDuplicates(["key", "w", "bucket"])
    spread = starts.select("key", "w", "bucket", "m", "shingles", F.explode_outer("starts").alias("start")).filter("start is not null")
    return spread.select("key", "w", "bucket", "start", F.slice("shingles", F.col("start") + 1, F.col("m")).alias("bag"))


def contaminated_texts(docs: DataFrame, benchmark: DataFrame, percent: int = 80, radius: int = RADIUS) -> DataFrame:
    """key (MD5 of the text), item_id, similarity, start_word, windows: the best window of each text and item that reach percent."""
    items = materialize(fingerprinted(benchmark_items(benchmark).withColumn("bag", F.col("shingles"))), "benchmark-items")
    by_shingle = items.select(F.explode_outer("shingles").alias("shingle"), "w", "bucket").filter("shingle is not null").distinct()
    known = materialize(by_shingle.groupBy("shingle").agg(F.sort_array(F.collect_set(F.struct("w", "bucket"))).alias("sizes")), "benchmark-shingles")
    few = known.count() <= MOST_BROADCAST
    texts = docs.select(F.md5(F.col("text").cast("binary")).alias("key"), words_column("text").alias("words")).filter("key is not null")
    windows = materialize(fingerprinted(windows_of(texts, F.broadcast(known) if few else known, percent, carry=few)), "benchmark-windows")

    near_bits = radius // BLOCKS
    blocks = F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1))).alias("block")
    index = items.select("item", "w", "bucket", F.col("print").alias("item_print"), blocks).withColumn("mask", F.explode(F.array(*[F.lit(m) for m in near_masks(near_bits)])))
    index = index.select("item", "w", "bucket", "item_print", "block", block_column(F.col("item_print"), F.col("block")).bitwiseXOR(F.col("mask")).alias("value"))
    probes = windows.select("key", "w", "bucket", "start", "print", blocks).withColumn("value", block_column(F.col("print"), F.col("block")))
    apart = F.col("print").bitwiseXOR(F.col("item_print"))
    # A pair may meet in several blocks; the first of them counts.
    first = F.forall(F.filter(F.sequence(F.lit(0), F.lit(BLOCKS - 1)), lambda b: b < F.col("block")), lambda b: F.bit_count(block_column(apart, b)) > near_bits)
    near = probes.join(index, ["w", "bucket", "block", "value"]).filter((F.bit_count(apart) <= radius) & first).select("key", "w", "bucket", "start", "item")

    judged = near.join(windows.select("key", "w", "bucket", "start", "bag"), ["key", "w", "bucket", "start"]).join(items.select("item", "item_id", F.col("bag").alias("item_bag")), "item")
    both = F.size(F.array_intersect("bag", "item_bag"))
    judged = judged.select("key", "item_id", "start", both.alias("both"), (F.size("bag") + F.size("item_bag") - both).alias("all"))
    good = judged.filter(100 * F.col("both") >= percent * F.col("all")).withColumn("similarity", F.col("both") / F.col("all"))
    return good.groupBy("key", "item_id").agg(F.max("similarity").alias("similarity"), F.min_by("start", F.struct(-F.col("similarity"), "start")).cast("long").alias("start_word"), F.countDistinct("start").alias("windows"))


def contaminated(docs: DataFrame, benchmark: DataFrame, percent: int = 80, radius: int = RADIUS) -> DataFrame:
    """doc_id, item_id, similarity, start_word, windows: the best window of each pair, and how many windows reach percent.

    Null, empty and wordless texts and items match nothing. A text or item of fewer than five words is one shingle, so such
    an item, too short to be told from chance inside a longer text, matches documents of just its words. Rows that repeat a
    doc_id add up under it, equal texts once; rows without a doc_id are left out here, since they couldn't be named, but
    not in ``decontaminated``. Items of one item_id add up too.
    """
    found = contaminated_texts(docs, benchmark, percent, radius)
    named = docs.filter("doc_id is not null").select("doc_id", F.md5(F.col("text").cast("binary")).alias("key")).distinct()
    pairs = named.join(found, "key")
    best = F.struct(-F.col("similarity"), F.col("start_word"))
    return pairs.groupBy("doc_id", "item_id").agg(F.max("similarity").alias("similarity"), F.min_by("start_word", best).alias("start_word"), F.sum("windows").alias("windows"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, percent: int = 80) -> DataFrame:
    """The documents whose text holds no benchmark item, with their own columns; null texts stay."""
    key = unused(docs, "key")
    found = materialize(contaminated_texts(docs, benchmark, percent).select(F.col("key").alias(key)).distinct(), "benchmark-found")
    if found.count() <= MOST_BROADCAST:
        found = F.broadcast(found)
    return docs.join(found, F.md5(docs["text"].cast("binary")) == F.col(key), "left_anti")
