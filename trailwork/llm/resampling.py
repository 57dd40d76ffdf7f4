"""Importance resampling of documents towards a target distribution.

A document's features are its runs of one to three words. Each is hashed to a bucket; a bucket's gain is the logarithm of how
much more often target texts fill it than documents do, and a document weighs the sum over its features. Gumbel noise drawn
from a hash of the id makes the highest scores a sample without replacement in proportion to the weights.

The features of a block of texts are interned in an open-addressed numpy table: keys are their xxHash64 values, equal keys
count as one only where the bytes are equal, and a slot keeps the bucket and the count. Counting adds up slots; weighing
gathers a gain for each occurrence through its slot. Nothing but 10,000 sums a task is shuffled for the counts.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailwork.llm.common import in_order, materialize, text_blocks, word_spans

BUCKETS = 10_000
#: Words of the longest feature.
LONGEST = 3
#: Bytes of text whose features share a table.
BLOCK = 1 << 18
PERCENT, LEAST_WORDS, SEED = 5, 20, 42
#: Bytes above which a feature is hashed and compared by itself rather than together with those of its length.
LONG = 256

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Words are of ASCII letters and digits and of all that is not ASCII.
_BREAK = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])

_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))  # fixed values of xxHash64
_LOW, _ALL = np.uint64((1 << 32) - 1), (1 << 64) - 1


def _turn(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def _mix(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _turn(acc + lane * _P2, 31) * _P1


def _changes() -> np.ndarray:
    """What a byte changes in a CRC-32 where so many bytes follow it: a row for each number below LONG."""
    rows = [np.array([zlib.crc32(bytes([b])) ^ zlib.crc32(bytes(1)) for b in range(256)], np.uint32)]
    while len(rows) < LONG:
        rows.append((rows[-1] >> np.uint32(8)) ^ rows[0][rows[-1] & np.uint32(255)])
    return np.stack(rows)


_CHANGE = _changes()


class Spans:
    """Spans of bytes of one buffer, hashed and compared eight bytes at a time."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        self.data, self.starts, self.sizes = data, starts, ends - starts
        padded = np.concatenate([data, np.zeros(8, np.uint8)])
        self.lanes = np.ascontiguousarray(np.ndarray(len(data) + 1, "<u8", padded, 0, (1,)))

    def bytes_of(self, i: int) -> bytes:
        at = int(self.starts[i])
        return self.data[at : at + int(self.sizes[i])].tobytes()

    def _by_size(self, of: np.ndarray, kind: type, together: Callable, single: Callable) -> np.ndarray:
        """A number for each of the spans ``of``: of short ones of one size at once, of long ones by themselves."""
        out = np.empty(len(of), kind)
        short = np.minimum(self.sizes[of], LONG + 1).astype(np.uint16)
        order = np.argsort(short, kind="stable")
        for group in np.split(order, np.flatnonzero(np.diff(short[order])) + 1) if len(order) else ():
            size = int(short[group[0]])
            out[group] = together(self.starts[of[group]], size) if size <= LONG else [single(self.bytes_of(i)) for i in of[group].tolist()]
        return out

    def hashes(self) -> np.ndarray:
        """xxHash64 with seed 0 of all spans."""
        return self._by_size(np.arange(len(self.starts)), np.uint64, self._hashes, xxhash.xxh64_intdigest)

    def checksums(self, of: np.ndarray) -> np.ndarray:
        """CRC-32 of the spans ``of``: of so many zero bytes, changed by every byte according to the bytes that follow it."""
        return self._by_size(of, np.uint32, self._checksums, zlib.crc32)

    def _checksums(self, at: np.ndarray, size: int) -> np.ndarray:
        out = np.full(len(at), zlib.crc32(bytes(size)), np.uint32)
        for k in range(size):
            out ^= _CHANGE[size - 1 - k][self.data[at + k]]
        return out

    def _hashes(self, at: np.ndarray, size: int) -> np.ndarray:
        done = 0
        if size >= 32:
            sums = [np.full(len(at), x, np.uint64) for x in (int(_P1) + int(_P2) & _ALL, int(_P2), 0, -int(_P1) & _ALL)]
            for done in range(0, size - 31, 32):
                sums = [_mix(v, self.lanes[at + done + 8 * k]) for k, v in enumerate(sums)]
            done += 32
            acc = _turn(sums[0], 1) + _turn(sums[1], 7) + _turn(sums[2], 12) + _turn(sums[3], 18)
            for v in sums:
                acc = (acc ^ _mix(np.zeros_like(v), v)) * _P1 + _P4
        else:
            acc = np.full(len(at), _P5, np.uint64)
        acc = acc + np.uint64(size)
        for done in range(done, size - 7, 8):
            acc = _turn(acc ^ _mix(np.zeros_like(acc), self.lanes[at + done]), 27) * _P1 + _P4
        done = size & ~7
        if size - done >= 4:
            acc = _turn(acc ^ ((self.lanes[at + done] & _LOW) * _P1), 23) * _P2 + _P3
            done += 4
        for k in range(done, size):
            acc = _turn(acc ^ ((self.lanes[at + k] & np.uint64(255)) * _P5), 11) * _P1
        acc = (acc ^ (acc >> np.uint64(33))) * _P2
        acc = (acc ^ (acc >> np.uint64(29))) * _P3
        return acc ^ (acc >> np.uint64(32))

    def same(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether spans a[i] and b[i] hold the same bytes."""
        equal = self.sizes[a] == self.sizes[b]
        long = equal & (self.sizes[a] > LONG)
        for i in np.flatnonzero(long).tolist():
            equal[i] = self.bytes_of(a[i]) == self.bytes_of(b[i])
        left = np.flatnonzero(equal & ~long)
        for done in range(0, LONG, 8):
            size = self.sizes[a[left]] - done
            left = left[size > 0]
            if not len(left):
                break
            unlike = self.lanes[self.starts[a[left]] + done] ^ self.lanes[self.starts[b[left]] + done]
            beyond = np.maximum(0, 8 - (self.sizes[a[left]] - done))  # bytes of the lane after the span
            equal[left[(unlike << (8 * beyond).astype(np.uint64)) != 0]] = False
        return equal


def intern(spans: Spans, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(slot of each span, span that owns each slot or -1): an open-addressed table, at most half full, probed one slot on.

    Spans that meet a free slot all claim it and the last one stays; the others compare hash and bytes with the owner and go on.
    """
    room = 1 << max(4, (2 * len(hashes)).bit_length())
    owner = np.full(room, -1, np.int64)
    slots = np.empty(len(hashes), np.int64)
    pending, at = np.arange(len(hashes)), (hashes & np.uint64(room - 1)).astype(np.int64)
    while len(pending):
        free = owner[at] < 0
        owner[at[free]] = pending[free]
        held = owner[at]
        found = held == pending
        like = np.flatnonzero(~found & (hashes[held] == hashes[pending]))
        found[like] = spans.same(held[like], pending[like])
        slots[pending[found]] = at[found]
        pending, at = pending[~found], (at[~found] + 1) & (room - 1)
    return slots, owner


class Block(NamedTuple):
    """Features of a block of texts: the row and slot of each occurrence, bucket and count of each slot, words of each row."""

    rows: np.ndarray
    slots: np.ndarray
    bucket: np.ndarray
    count: np.ndarray
    words: np.ndarray


def interned(texts: pa.Array, size: int = BLOCK) -> Iterator[Block]:
    """Blocks of about ``size`` bytes; a longer text is cut between words, and its last words are carried over."""
    carried, row_before = b"", -1
    for data, borders, rows in text_blocks(texts, size, _BREAK):
        before = 0
        if row_before == rows[0] and carried:
            before = carried.count(b" ")
            data = np.concatenate([np.frombuffer(carried, np.uint8), data])
            borders = np.r_[0, borders[1:] + len(carried)]
        data = _LOWER[data]
        starts, ends = word_spans(data, borders, _BREAK)
        # Words side by side with one space between: a word's bytes and the first byte after it, as a space.
        word = ~_BREAK[data]
        kept = word | np.r_[False, word[:-1]]
        place = np.cumsum(kept) - 1
        data = np.where(word, data, np.uint8(32))[kept]
        owner = rows[np.searchsorted(borders, starts, side="right") - 1]
        starts, ends = place[starts], place[ends - 1] + 1 if len(ends) else ends
        row_before, carried = int(rows[-1]), b"".join(data[s:e].tobytes() + b" " for s, e in zip(starts[-(LONGEST - 1) :], ends[-(LONGEST - 1) :], strict=True)) if len(rows) == 1 else b""
        first, last = [], []
        for n in range(1, LONGEST + 1):
            i = np.arange(max(0, before - n + 1), len(starts) - n + 1)
            i = i[owner[i] == owner[i + n - 1]]
            first.append(i)
            last.append(i + n - 1)
        first, last = np.concatenate(first), np.concatenate(last)
        spans = Spans(data, starts[first], ends[last])
        slots, held = intern(spans, spans.hashes())
        bucket, count = np.zeros(len(held), np.int64), np.bincount(slots, minlength=len(held))
        used = np.flatnonzero(held >= 0)
        bucket[used] = spans.checksums(held[used]) % BUCKETS
        yield Block(owner[first], slots, bucket, count, np.bincount(owner[before:], minlength=len(texts)))


def bucket_counts(texts: DataFrame) -> np.ndarray:
    """Features of all texts by bucket: one row a task and bucket is shuffled, and 10,000 sums reach the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for b in batches:
            for block in interned(b.column(0)):
                # Whole numbers below 2 ** 53, so exact as doubles.
                total += np.bincount(block.bucket, block.count, BUCKETS).astype(np.int64)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], names=["bucket", "n"])

    summed = texts.select(F.col("text").cast("string")).mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(BUCKETS, np.int64)
    out[summed.column("bucket").to_numpy()] = summed.column("n").to_numpy()
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of smoothed shares, rounded down, for every bucket."""
    s_all, t_all = float(source.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + BUCKETS) / ((s + 1.0) * (t_all + BUCKETS)))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths from a hash of seed and id; a null id counts as an empty one."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def with_importance(docs: DataFrame, gain: np.ndarray, seed: int = SEED, out: str = "importance") -> DataFrame:
    """Add a struct (n_words, n_features, weight, score) of longs for the whole text; other columns stay as they are.

    Null, empty and wordless texts have no features and weigh 0. Repeated rows get the same answer.
    """
    shared = docs.sparkSession.sparkContext.broadcast(gain)  # 10,000 numbers

    @F.arrow_udf("n_words long, n_features long, weight long")
    def weigh(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            n = len(texts)
            words, features, weight = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
            for block in interned(texts):
                by_slot = shared.value[block.bucket]
                words += block.words
                features += np.bincount(block.rows, minlength=n)
                weight += np.bincount(block.rows, by_slot[block.slots], n).astype(np.int64)
            yield pa.StructArray.from_arrays([pa.array(words), pa.array(features), pa.array(weight)], names=["n_words", "n_features", "weight"])

    weighed = docs.withColumn(out, weigh.asNondeterministic()(F.col("text")))
    return weighed.withColumn(out, F.struct(f"{out}.*", (F.col(f"{out}.weight") + noise(F.col("doc_id"), seed)).alias("score")))


def ranked(weighed: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, measures: str = "importance", out: str = "rank") -> DataFrame:
    """Add the place among the drawn: the highest scores of ``percent`` % of the rows of ``least_words`` words, rounded down.

    Ties go to the smaller doc_id, null last, then to the shorter text; rows that aren't drawn have null. The rows are written
    once. A quantile within a proven error leaves a little more than the drawn share, and only those rows are sorted, by range.
    """
    spark = weighed.sparkSession
    names = [c for c in weighed.columns if c != out]
    rows = weighed.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(f"{measures}.score").alias("score"), F.col("doc_id").alias("id"), F.col(f"{measures}.n_features").alias("size"), (F.col(f"{measures}.n_words") >= least_words).alias("fit"), F.rand(SEED).alias("salt"))
    rows = materialize(rows, "resampling-scored")
    n = rows.filter("fit").count()
    drawn = n * percent // 100
    share, error = percent / 100, percent / 1000
    cut = rows.filter("fit").approxQuantile("score", [max(0.0, 1 - share - 2 * error)], error) if drawn else []
    among = F.col("fit") & (F.col("score") >= cut[0]) if cut else F.lit(False)
    placed = in_order(rows.filter(among), [F.desc("score"), F.asc_nulls_last("id"), F.asc("size"), F.asc("salt")], "resampling-order") if drawn else None
    rest = rows.filter(~among).select("row.*", F.lit(None).cast("long").alias(out))
    if placed is None:
        return rest
    return placed.select("row.*", F.when(F.col("place") < drawn, F.col("place") + 1).alias(out)).union(rest)


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """The drawn documents, whole rows with their measures in ``importance`` and their ``rank``.

    ``docs`` has doc_id and text, ``target`` has text. An empty target or null texts only smooth the gains.
    """
    gain = gains(bucket_counts(docs), bucket_counts(target))
    return ranked(with_importance(docs, gain, seed), percent, least_words).filter("rank is not null")


def importance_report(docs: DataFrame, target: DataFrame) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every document."""
    gain = gains(bucket_counts(docs), bucket_counts(target))
    measured = with_importance(docs.select("doc_id", "text"), gain).select("doc_id", "importance")
    return ranked(measured).select("doc_id", "importance.n_features", "importance.weight", "importance.score", "rank")
