"""Token counts by offset-mapped attribution.

A whole document is encoded once. The tokens of a byte-level vocabulary spell the text's UTF-8 bytes, so prefix sums of
their lengths are their spans; the spans are joined to the sections' spans by their borders (sorted on both sides, one
binary search a border), and a token that crosses a border goes to one section by an explicit rule.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How byte-level BPE of this vocabulary splits text before merging (fixed value).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
RULES = ("majority", "first", "last")


def read_ranks(data: str) -> dict[bytes, int]:
    """Ranks of a .tiktoken file's text."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in data.splitlines() if line)}


def line_starts(raw: bytes) -> np.ndarray:
    """Byte offsets at which the lines of a text begin; a line feed belongs to the line it ends."""
    at = np.flatnonzero(np.frombuffer(raw, np.uint8) == 10) + 1
    return np.r_[0, at[at < len(raw)]].astype(np.int64)


def attribute(lengths: np.ndarray, starts: np.ndarray, size: int, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, crossing tokens) of each section, from the tokens' byte lengths and the sections' first bytes.

    majority: the section that holds most of a token's bytes, the earliest of equals. first, last: that of its first or
    last byte. A crossing token counts as crossing in the section it is given to.
    """
    ends = np.cumsum(lengths)
    begins = ends - lengths
    low = np.searchsorted(starts, begins, side="right") - 1
    high = np.searchsorted(starts, ends - 1, side="right") - 1
    crossing = np.flatnonzero(high > low)
    owner = high.copy() if rule == "last" else low.copy()
    if rule == "majority":
        stops = np.r_[starts[1:], size]
        for t in crossing:
            span = np.arange(low[t], high[t] + 1)
            share = np.minimum(stops[span], ends[t]) - np.maximum(starts[span], begins[t])
            owner[t] = span[share.argmax()]
    return np.bincount(owner, minlength=len(starts)), np.bincount(owner[crossing], minlength=len(starts))


def section_tokens(docs: DataFrame, vocabulary: str = VOCABULARY, rule: str = "majority") -> DataFrame:
    """doc_id, section, start_char, end_char, n_tokens, n_crossing: one row for each line of each document.

    The sections of a document add up to its tokens. A null or empty text has no section. Repeated rows repeat theirs.
    The vocabulary is read once, on the driver, and broadcast (a fixed file).
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    with open(vocabulary) as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        ranks = read_ranks(shared.value)
        lengths = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            lengths[rank] = len(token)
        coder = tiktoken.Encoding("sections", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        names = ["doc_id", "section", "start_char", "end_char", "n_tokens", "n_crossing"]
        for b in batches:
            columns: list[list[np.ndarray]] = [[], [], [], [], []]
            owners: list[int] = []
            texts = b.column("text").to_pylist()
            for i, text in enumerate(texts):
                if not text:
                    continue
                raw = text.encode("utf-8")
                starts = line_starts(raw)
                tokens, crossing = attribute(lengths[np.array(coder.encode_ordinary(text), np.int64)], starts, len(raw), rule)
                chars = np.r_[0, np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)]
                owners += [i] * len(starts)
                for column, values in zip(columns, (np.arange(len(starts)), chars[starts], chars[np.r_[starts[1:], len(raw)]], tokens, crossing), strict=True):
                    column.append(values)
            out = [np.concatenate(c).astype(np.int64) if c else np.zeros(0, np.int64) for c in columns]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(owners, pa.int64())), *map(pa.array, out)], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(encode, "doc_id long, section long, start_char long, end_char long, n_tokens long, n_crossing long")
