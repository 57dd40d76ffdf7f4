"""Helpers that several corpus operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a scratch folder in local mode only."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("trailwork.scratch", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("trailwork.scratch", found)
    return found


def unused(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a table into the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fold(key: Column, n: int, held: int) -> Column:
    """True where crc32 of the key as text leaves ``held``; a null key is never held out."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % n == held, F.lit(False))


def words_of(text: str | None) -> list[bytes]:
    """The words of a whole text as UTF-8; bytes.split() cuts at exactly the six ASCII spaces."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def lower_words_of(text: str | bytes | None) -> list[bytes]:
    """As words_of, with A-Z (and nothing else) in lower case; UTF-8 bytes may be given instead."""
    if not text:
        return []
    return (text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text).lower().split()


_RANDOM = np.random.default_rng(20240917)
#: A random number for every byte, the same with A-Z as a-z, and a random odd base of the polynomial.
_BYTE = _RANDOM.integers(1, 1 << 63, 256, np.uint64)
_FOLDED = _BYTE.copy()
_FOLDED[65:91] = _FOLDED[97:123]
_BASE = int(_RANDOM.integers(1 << 61, 1 << 62)) * 8 + 5 & (1 << 64) - 1
_SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
_MIX = np.uint64(0x9FB21C651E98DF25)
_ROOM = 1 << 20


class Powers:
    """base ** i and base ** -i modulo 2 ** 64 for i below a length that grows as needed."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            self.up, self.down = (np.cumprod(np.r_[np.uint64(1), np.full(max(n, _ROOM) - 1, x, np.uint64)], dtype=np.uint64) for x in (_BASE, pow(_BASE, -1, 1 << 64)))
        return self.up[:n], self.down[:n]


def word_spans(data: np.ndarray, borders: np.ndarray, breaks: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of texts side by side in ``data`` begin and end; ``breaks`` tells of each byte whether it parts words."""
    space = breaks[data]
    before, after = np.r_[True, space[:-1]], np.r_[space[1:], True]
    filled = borders[:-1] < borders[1:]
    before[borders[:-1][filled]] = True
    after[borders[1:][filled] - 1] = True
    return np.flatnonzero(~space & before), np.flatnonzero(~space & after) + 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, powers: Powers, fold: bool = True) -> np.ndarray:
    """64-bit hashes of spans of bytes (with fold: A-Z as a-z): differences of prefix sums of a polynomial, shifted back to their starts."""
    up, down = powers.upto(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_FOLDED if fold else _BYTE)[data] * up, out=total[1:])
    hashes = (total[ends] - total[starts]) * down[starts]
    hashes = (hashes ^ (hashes >> np.uint64(32)) ^ (ends - starts).astype(np.uint64)) * _MIX
    return hashes ^ (hashes >> np.uint64(29))


def word_hashes(data: np.ndarray, borders: np.ndarray, powers: Powers, fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of texts side by side in ``data``, and where each text's words begin and end among them."""
    starts, ends = word_spans(data, borders)
    return span_hashes(data, starts, ends, powers, fold), np.searchsorted(starts, borders)


def text_blocks(texts: pa.Array, size: int, breaks: np.ndarray = _SPACE) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, borders, rows) of whole texts side by side, about ``size`` bytes a block.

    A longer text is cut at white space (or other ``breaks``), so that a block holds ``size`` bytes or one word; ``rows`` tells whose
    each piece is.
    Null texts have no bytes.
    """
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + size, side="right")) - 1)
        at, stop = int(ends[lo]), int(ends[hi])
        while hi == lo + 1 and stop - at > size:
            cut = at + size
            space = np.zeros(0, np.int64)
            while cut < stop and not len(space):
                space = np.flatnonzero(breaks[data[cut : min(cut + size, stop)]])
                cut += int(space[0]) if len(space) else size
            cut = min(cut, stop)
            yield data[at:cut], np.array([0, cut - at]), np.array([lo])
            at = cut
        if hi > lo + 1:
            yield data[at:stop], ends[lo : hi + 1] - at, np.arange(lo, hi)
        elif stop > at:
            yield data[at:stop], np.array([0, stop - at]), np.array([lo])
        lo = hi


def in_order(rows: DataFrame, keys: list[Column | str], name: str, out: str = "place") -> DataFrame:
    """The rows, written, with their place (0, 1, ...) in the order of the keys.

    They are range-partitioned and sorted; a row's place is its number in its partition on top of the rows of the partitions
    before, whose counts are one small row a partition. No key has to fit one task; equal rows are in any order.
    """
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("__id", F.monotonically_increasing_id())
    kept = materialize(ordered, name)
    part = F.shiftright("__id", 33).alias("__part")
    counts = sorted((r["__part"], r.n) for r in kept.groupBy(part).agg(F.count("*").alias("n")).collect())  # one row a partition
    offsets, before = [], 0
    for p, n in counts:
        offsets.append((p, before))
        before += n
    ahead = F.broadcast(spark.createDataFrame(offsets, "__part long, __ahead long"))
    placed = kept.withColumn("__part", F.shiftright("__id", 33)).join(ahead, "__part")
    return placed.withColumn(out, F.col("__ahead") + F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))).drop("__id", "__part", "__ahead")


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Arrow batches of so many rows at most, so that what a task holds at once stays small."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)
