"""Fill-in-the-middle transformation with a learned rank index.

A text's units are its runs of ASCII letters and every other single code point. Where unit number r begins is looked up in a
piecewise-linear index: segments, fitted to the offsets of all unit boundaries so that none is farther off than a bound,
predict the offset from the rank, and a stored residual of one byte corrects the prediction exactly. A long text is read
piece by piece, so that a boundary costs one byte instead of the eight of its offset. Nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Farthest that a segment may be from a boundary, in bytes; residuals are signed bytes, so at most 126.
BOUND = 120
#: Bytes of text read at once.
BLOCK = 1 << 20
#: Of 100 documents, those transformed, and of these the ones with the suffix first.
TRANSFORMED, SUFFIX_FIRST, SEED = 90, 20, 1
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Boundaries that a segment is tried on first; doubled as long as they fit.
FIRST_TRY = 256

_LETTER = np.array([chr(b).isalpha() if b < 128 else False for b in range(256)])


class RankIndex:
    """Ranks to sorted offsets: error-bounded linear segments and a residual of one byte an offset."""

    def __init__(self, bound: int = BOUND):
        self.bound, self.n = bound, 0
        self.firsts, self.origins, self.slopes, self.residuals = [], [], [], []

    def extend(self, offsets: np.ndarray) -> None:
        """Add offsets, not smaller than those before: greedy segments, each as long as a cone around its first offset stays open."""
        lo = 0
        while lo < len(offsets):
            length, width = 1, FIRST_TRY
            low, high = 0.0, np.inf
            while lo + length < len(offsets):
                end = min(len(offsets), lo + width)
                run = np.arange(length, end - lo)
                rise = (offsets[lo + length : end] - offsets[lo]).astype(np.float64)
                lows = np.maximum(np.maximum.accumulate((rise - self.bound) / run), low)
                highs = np.minimum(np.minimum.accumulate((rise + self.bound) / run), high)
                closed = np.flatnonzero(lows > highs)
                fits = int(closed[0]) if len(closed) else len(run)
                if fits:
                    low, high, length = float(lows[fits - 1]), float(highs[fits - 1]), length + fits
                if len(closed):
                    break
                width *= 2
            slope = (low + high) / 2 if np.isfinite(high) else 0.0
            guess = self._predict(int(offsets[lo]), slope, np.arange(length))
            self.firsts.append(self.n + lo)
            self.origins.append(int(offsets[lo]))
            self.slopes.append(slope)
            self.residuals.append((offsets[lo : lo + length] - guess).astype(np.int8))
            lo += length
        self.n += len(offsets)

    @staticmethod
    def _predict(origin: np.ndarray | int, slope: np.ndarray | float, steps: np.ndarray) -> np.ndarray:
        return origin + np.rint(slope * steps).astype(np.int64)

    def close(self) -> RankIndex:
        self.firsts, self.origins, self.slopes = np.array(self.firsts, np.int64), np.array(self.origins, np.int64), np.array(self.slopes)
        self.residuals = np.concatenate(self.residuals) if self.residuals else np.zeros(0, np.int8)
        return self

    def offsets(self, ranks: np.ndarray) -> np.ndarray:
        """The offsets of these ranks, exactly."""
        at = np.searchsorted(self.firsts, ranks, side="right") - 1
        return self._predict(self.origins[at], self.slopes[at], ranks - self.firsts[at]) + self.residuals[ranks]


def unit_index(data: np.ndarray, borders: np.ndarray, size: int = BLOCK) -> tuple[RankIndex, np.ndarray]:
    """(index of where all units of the texts side by side in ``data`` begin, with the end of ``data`` last; units before each border)."""
    index, before = RankIndex(), np.zeros(len(borders), np.int64)
    inner = np.unique(borders[:-1])
    for lo in range(0, len(data), size):
        part = data[lo : lo + size]
        letter = _LETTER[part]
        begins = (part & 0xC0) != 0x80
        begins[1:] &= ~(letter[1:] & letter[:-1])
        if lo and letter[0] and _LETTER[data[lo - 1]]:
            begins[0] = False
        heads = inner[np.searchsorted(inner, lo) : np.searchsorted(inner, lo + len(part))] - lo
        begins[heads] = True
        starts = np.flatnonzero(begins)
        inside = (borders > lo) & (borders <= lo + len(part))
        before[inside] = index.n + np.searchsorted(starts, borders[inside] - lo)
        index.extend(starts + lo)
    index.extend(np.array([len(data)], np.int64))
    return index.close(), before


def draws(doc_id: Column, seed: int = SEED) -> list[Column]:
    """Four whole numbers below 2 ** 32 from a hash of seed and id; a null id counts as an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def _blocks(texts: pa.Array, size: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, borders) of whole texts; one longer than ``size`` stands alone."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + size, side="right")) - 1)
        yield lo, hi, data[ends[lo] : ends[hi]], ends[lo : hi + 1] - ends[lo]
        lo = hi


def with_infilling(docs: DataFrame, seed: int = SEED, transformed: int = TRANSFORMED, suffix_first: int = SUFFIX_FIRST, out: str = "infilling") -> DataFrame:
    """Add a struct (n, form, prefix_chars, middle_chars, output): the number of units, plain, psm or spm, and the rearranged text.

    Whole texts; a null text counts as empty, and an empty one stays plain, as do texts that hold a sentinel. The cuts depend on
    seed and doc_id alone, so repeated rows get the same answer. Other columns stay as they are.
    """
    sentinel = {k: k.encode() for k in (PREFIX, SUFFIX, MIDDLE)}

    @F.arrow_udf("n long, form string, prefix_chars long, middle_chars long, output string")
    def infill(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        p, s, m = (sentinel[k] for k in (PREFIX, SUFFIX, MIDDLE))
        for texts, *drawn in batches:
            h = [np.asarray(x.to_numpy(zero_copy_only=False), np.int64) for x in drawn]
            rows = []
            for lo, hi, data, borders in _blocks(texts, BLOCK):
                index, before = unit_index(data, borders)
                n = np.diff(before)
                cuts = np.sort(np.stack([h[0][lo:hi] % (n + 1), h[1][lo:hi] % (n + 1)]), axis=0)
                # The border after a text's last unit is where the next text that isn't empty begins, or the end.
                first, second = (index.offsets(before[:-1] + c) for c in cuts)
                plain = (h[2][lo:hi] % 100 >= transformed) | (n == 0)
                turned = h[3][lo:hi] % 100 < suffix_first
                for i in range(hi - lo):
                    text = data[borders[i] : borders[i + 1]].tobytes()
                    if plain[i] or p in text or s in text or m in text:
                        rows.append((int(n[i]), "plain", None, None, text))
                        continue
                    a, b = int(first[i] - borders[i]), int(second[i] - borders[i])
                    prefix, middle, suffix = text[:a], text[a:b], text[b:]
                    output = b"".join((s, suffix, p, prefix, m, middle) if turned[i] else (p, prefix, s, suffix, m, middle))
                    rows.append((int(n[i]), "spm" if turned[i] else "psm", len(prefix.decode("utf-8", "replace")), len(middle.decode("utf-8", "replace")), output))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            n, form, chars, middle_chars = (pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=False))
            yield pa.StructArray.from_arrays([n, form, chars, middle_chars, pa.array(columns[4], pa.binary()).cast(pa.string())], names=["n", "form", "prefix_chars", "middle_chars", "output"])

    return docs.withColumn(out, infill.asNondeterministic()(F.col("text"), *draws(F.col("doc_id"), seed)))


def restored(output: Column, form: Column) -> Column:
    """The text that ``output`` was made from. No text of form psm or spm holds a sentinel, so its first occurrences are the borders."""
    p, s, m = (F.instr(output, k) for k in (PREFIX, SUFFIX, MIDDLE))
    tail = F.substr(output, m + F.lit(len(MIDDLE)))
    prefix_first = F.concat(F.substr(output, F.lit(1 + len(PREFIX)), s - F.lit(1 + len(PREFIX))), tail, F.substr(output, s + F.lit(len(SUFFIX)), m - s - F.lit(len(SUFFIX))))
    suffix_first = F.concat(F.substr(output, p + F.lit(len(PREFIX)), m - p - F.lit(len(PREFIX))), tail, F.substr(output, F.lit(1 + len(SUFFIX)), p - F.lit(1 + len(SUFFIX))))
    return F.when(form == "psm", prefix_first).when(form == "spm", suffix_first).otherwise(output)


def infilling_report(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and the SHA-256 of the output and of the text rebuilt from it, for every row."""
    made = with_infilling(docs.select("doc_id", "text")).select("doc_id", "infilling.*")
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))
