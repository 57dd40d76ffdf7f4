"""Quality rules by repetition coverage.

Word n-grams of several lengths are found with rolling hashes (prefix sums of a polynomial modulo 2^64, one subtraction
a window), and what counts is how many characters lie inside n-grams or lines that occur twice or more in the same text.
All work is inside one text, so nothing is shuffled.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailwork.llm.common import Powers, word_hashes

#: n-gram length -> largest share of a text's word characters inside repeated n-grams of that length.
MAX_NGRAM_SHARE = {5: 0.45, 8: 0.40, 10: 0.35, 15: 0.30}
#: Largest share of word characters inside lines that occur twice or more.
MAX_LINE_SHARE = 0.40
BASE_NGRAM = 8
SYMBOLS = b"#*$%&|<>"

_P = 0x9E3779B97F4A7C15
_P_INVERSE = pow(_P, -1, 1 << 64)


def covered(values: np.ndarray, n: int) -> np.ndarray:
    """Which words lie inside an n-gram that occurs at least twice, the first occurrence included."""
    count = len(values) - n + 1
    out = np.zeros(len(values), bool)
    if count < 2:
        return out
    with np.errstate(over="ignore"):
        power = np.cumprod(np.r_[np.uint64(1), np.full(len(values) - 1, _P, np.uint64)], dtype=np.uint64)
        back = np.cumprod(np.r_[np.uint64(1), np.full(count - 1, _P_INVERSE, np.uint64)], dtype=np.uint64)
        total = np.r_[np.uint64(0), np.cumsum(values * power, dtype=np.uint64)]
        window = (total[n:] - total[:-n]) * back
    order = np.argsort(window, kind="stable")
    same = window[order][1:] == window[order][:-1]
    repeated = np.zeros(count, bool)
    repeated[order[1:][same]] = True
    repeated[order[:-1][same]] = True
    edge = np.zeros(len(values) + 1, np.int32)
    starts = np.flatnonzero(repeated)
    edge[starts] += 1
    edge[starts + n] -= 1
    return np.cumsum(edge[:-1]) > 0


def measure(text: str | None, lengths: tuple[int, ...], powers: Powers) -> tuple:
    """n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, dup_line_chars, then covered characters by length."""
    raw = text.encode("utf-8", "surrogatepass") if text else b""
    words = raw.split()
    if not words:
        return (0, 0, len(raw) - len(raw.translate(None, SYMBOLS)), 0, 0, 0, 0, *[0] * len(lengths))
    data = np.frombuffer(raw, np.uint8)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    point = ((data & 0xC0) != 0x80) & ~space
    starts = np.flatnonzero(~space & np.r_[True, space[:-1]])
    chars = np.add.reduceat(point, starts, dtype=np.int64)
    lines = Counter(line for line in raw.split(b"\n") if line.split())
    n_lines = sum(lines.values())
    line_chars = sum(k * len(b"".join(line.split()).decode("utf-8", "surrogatepass")) for line, k in lines.items() if k > 1)
    values, _ = word_hashes(data, np.array([0, len(data)]), powers, fold=False)
    by_length = {n: covered(values, n) for n in {BASE_NGRAM, *lengths}}
    return (
        len(words), int(chars.sum()), len(raw) - len(raw.translate(None, SYMBOLS)), n_lines, n_lines - len(lines),
        int(by_length[BASE_NGRAM].sum()), line_chars, *[int(chars[by_length[n]].sum()) for n in lengths],
    )


def with_repetition(docs: DataFrame, text: str = "text", out: str = "repetition", max_ngram_share: dict[int, float] | None = None) -> DataFrame:
    """Add a struct column with the counts of ``measure``. Whole texts; a null or empty text counts as no words."""
    limits = max_ngram_share or MAX_NGRAM_SHARE
    lengths = tuple(sorted(limits))
    names = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "dup_line_chars", *[f"dup_{n}gram_chars" for n in lengths]]

    @F.pandas_udf(", ".join(f"{x} long" for x in names))
    def repetition(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        powers = Powers()
        for texts in batches:
            yield pd.DataFrame([measure(x, lengths, powers) for x in texts], columns=names, dtype="int64")

    # Nondeterministic only so that the optimizer doesn't run it once for the filter and again for the columns.
    return docs.withColumn(out, repetition.asNondeterministic()(F.col(text)))


def verdict(measures: str = "repetition", max_ngram_share: dict[int, float] | None = None, max_line_share: float = MAX_LINE_SHARE):
    """(base_failed, kept) over the struct column of ``with_repetition``."""
    m = lambda name: F.col(f"{measures}.{name}")
    failed = (m("n_words") < 20) | (100 * m("n_repeat_words") > 30 * m("n_words"))
    kept = ~failed & (m("dup_line_chars") <= max_line_share * m("word_chars"))
    for n, share in (max_ngram_share or MAX_NGRAM_SHARE).items():
        kept &= m(f"dup_{n}gram_chars") <= share * m("word_chars")
    return failed, kept


def quality_report(docs: DataFrame) -> DataFrame:
    """One row per document with the counts, ``base_failed`` and ``kept``; repeated rows each get their own."""
    names = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "dup_line_chars", *[f"dup_{n}gram_chars" for n in sorted(MAX_NGRAM_SHARE)]]
    failed, kept = verdict()
    measured = with_repetition(docs.select("doc_id", "text")).select("doc_id", *[F.col(f"repetition.{x}").alias(x) for x in names], failed.alias("base_failed"), kept.alias("kept"))
    return measured


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that pass, with their own columns unchanged."""
    extra = "__repetition"
    _, kept = verdict(extra)
    return with_repetition(docs, out=extra).filter(kept).drop(extra)
