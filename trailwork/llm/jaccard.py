"""Exact Jaccard self-join of documents on word n-grams.

1. Every text becomes the sorted array of its distinct n-gram hashes (64 bits); texts with equal arrays become one class.
2. n-grams are ordered: those in crowded bins (of a fixed number of hashed ones, counted over all texts) last, the others by
   how rare their words are. Any order gives the same links: two sets of Jaccard t or more share one of their first
   n - ceil(t n) + 1 n-grams in it, so only those are indexed; a good one makes few others share any.
3. Each indexed n-gram held by several classes first links them to the one that has it earliest ("leader"), which ties
   groups of near copies together in one pass.
4. What the leaders leave open is compared in tiles: the other holders of a leader's n-grams, by size (sizes further apart
   than t can't link), large tiles cut into size bands and blocks. Hashed bitmaps give an upper bound of the overlap by bit
   counts; only pairs that stay above the needed overlap leave the tile.
5. Their sorted arrays are intersected exactly.
6. Classes with the same hub are known to be connected, so their pairs are not needed for components, only counted: each
   hub's classes are compared all with all in the same kind of tiles, where a class's array is sent once a tile, and only
   a count a class leaves a tile.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailwork.llm.common import Powers, materialize, slices, unused, word_hashes
from trailwork.llm.components import components

BINS = 1 << 18
#: Bins travel in chunks of this many; tasks are summed in this many groups first.
CHUNK = 1 << 14
SALT = 64
LEADER_SALT = 16
BITMAP = 1024
#: Places of the filters of shared n-grams and of wanted classes.
FILTER = 1 << 24
#: Classes in a block of a tile, about.
BLOCK = 4096
#: The same for tiles that hold whole arrays, and n-grams in such a block, about.
COUNT_BLOCK, COUNT_GRAMS = 1024, 1 << 21


_MIX = np.uint64(0x9FB21C651E98DF25)
#: Bytes of text whose n-grams are made at once; a longer text goes alone.
TEXT_BLOCK = 1 << 20


def gram_sets(texts: pa.Array, n: int, powers: Powers, seen: np.ndarray | None = None, rarity: np.ndarray | None = None) -> list:
    """Sorted distinct 64-bit hashes of the n-grams of each text (UTF-8 bytes, A-Z as a-z); fewer words than n make one n-gram, none make none.

    ``seen``, if given, gains the words' counts by bin. With ``rarity``, a weight for each bin of words, each text gives
    (hashes, sums of the weights of the n-grams' words) instead.
    """
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    borders = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    out: list[np.ndarray] = []
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(borders, borders[lo] + TEXT_BLOCK, side="right")) - 1)
        part = borders[lo : hi + 1]
        words, cut = word_hashes(data[part[0] : part[-1]], part - part[0], powers) if part[-1] > part[0] else (np.zeros(0, np.uint64), np.zeros(hi - lo + 1, np.int64))
        bins = (words & np.uint64(BINS - 1)).astype(np.int64)
        if seen is not None:
            seen += np.bincount(bins, minlength=BINS)
        grams = np.full(max(0, len(words) - n + 1), n, np.uint64)
        weights = np.zeros(len(grams))
        if rarity is not None:
            for k in range(n):
                weights += rarity[bins[k : k + len(grams)]]
        for k in range(n):
            grams = (grams ^ words[k : k + len(grams)]) * _MIX
            grams ^= grams >> np.uint64(32)
        for begin, end in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            if end - begin >= n:
                own = grams[begin : end - n + 1]
                if rarity is None:
                    own = np.sort(own)
                    out.append(own[np.r_[True, own[1:] != own[:-1]]])
                else:
                    own, first = np.unique(own, return_index=True)
                    out.append((own, weights[begin : end - n + 1][first]))
            else:
                few = np.full(min(1, end - begin), end - begin, np.uint64)
                for k in range(begin, end):
                    few = (few ^ words[k]) * _MIX
                    few ^= few >> np.uint64(32)
                out.append(few if rarity is None else (few, np.zeros(len(few))))
        lo = hi
    return out


def key_of(grams: np.ndarray) -> bytes:
    return hashlib.blake2b(grams.tobytes(), digest_size=16).digest()


def pack(grams: np.ndarray) -> bytes:
    """The sorted hashes without loss: of many, seven bytes each and the first bytes as steps in a row of bits."""
    data = grams.astype("<u8")
    if len(data) < 40:
        return b"-" + data.tobytes()
    steps = np.zeros(len(data) + 256, np.uint8)
    steps[(data >> np.uint64(56)).astype(np.int64) + np.arange(len(data))] = 1
    return b"+" + data.view(np.uint8).reshape(-1, 8)[:, :7].tobytes() + np.packbits(steps).tobytes()


def unpack(data: bytes) -> np.ndarray:
    if data[:1] == b"-":
        return np.frombuffer(data, "<u8", offset=1).copy()
    n = (8 * (len(data) - 1) - 256) // 57
    wide = np.zeros((n, 8), np.uint8)
    wide[:, :7] = np.frombuffer(data, np.uint8, 7 * n, 1).reshape(-1, 7)
    steps = np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8, offset=1 + 7 * n)))
    wide[:, 7] = steps - np.arange(n)
    return wide.view("<u8").ravel()


def filter_of(bits: DataFrame) -> np.ndarray:
    """A bitmap of FILTER places, as 64-bit words, from a table of places (bit); the words are made by Spark."""
    words = bits.groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, bit & 63)")).alias("bits")).toArrow()  # FILTER / 64 rows at most
    out = np.zeros(FILTER // 64, np.uint64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return out


def is_set(bitmap: np.ndarray, place):
    """Whether places of a bitmap of 64-bit words are set; one place or an array of them."""
    if isinstance(place, np.ndarray):
        return bitmap[place >> 6] >> (place & 63).astype(np.uint64) & np.uint64(1) == 1
    return int(bitmap[place >> 6]) >> (place & 63) & 1 == 1


def wide_bitmap_of(grams: np.ndarray) -> bytes:
    """A bitmap of four places or more an n-gram, so that its bound is close for texts of any length; its width is a power of 2."""
    width = max(BITMAP, 1 << (4 * len(grams) - 1).bit_length())
    bits = np.zeros(width, np.uint8)
    bits[(grams >> np.uint64(20)) % np.uint64(width)] = 1
    return np.packbits(bits).tobytes()


def may_reach(a: bytes, b: bytes, na: int, nb: int, percent: int) -> bool:
    """Whether wide bitmaps allow a link: a bit of A that B lacks is a member of A that B lacks. The wider one is folded."""
    while len(a) != len(b):
        if len(a) < len(b):
            a, b, na, nb = b, a, nb, na
        half = len(a) // 2
        a = (int.from_bytes(a[:half]) | int.from_bytes(a[half:])).to_bytes(half)
    p, q = int.from_bytes(a), int.from_bytes(b)
    both = (p & q).bit_count()
    return min(na - p.bit_count() + both, nb - q.bit_count() + both) >= needed(na, nb, percent)


def needed(a, b, percent: int):
    """Least intersection of sets of sizes a and b at a Jaccard of percent / 100 or more: 100 i >= percent (a + b - i)."""
    return -(-percent * (a + b) // (100 + percent))


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def bitmap_of(grams: np.ndarray) -> np.ndarray:
    bits = np.zeros(BITMAP, np.uint8)
    bits[(grams >> np.uint64(20)) % np.uint64(BITMAP)] = 1
    return np.packbits(bits)


def overlap_bound(p: np.ndarray, q: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Row by row the most members that sets with these bitmaps and sizes can share."""
    return np.minimum(na - np.bitwise_count(p & ~q).sum(1, dtype=np.int64), nb - np.bitwise_count(q & ~p).sum(1, dtype=np.int64))


class WideBitmaps:
    """Wide bitmaps of rows, compared in bulk: the wider of two, at most twice as wide here, is folded."""

    def __init__(self, raw: list[bytes]):
        self.width = np.array([len(x) for x in raw])
        self.place = np.zeros(len(raw), np.int64)
        self.rows: dict[int, np.ndarray] = {}
        for w in np.unique(self.width):
            at = np.flatnonzero(self.width == w)
            self.place[at] = np.arange(len(at))
            self.rows[int(w)] = np.frombuffer(b"".join(raw[i] for i in at), np.uint64).reshape(len(at), -1)

    def of(self, at: np.ndarray, width: int) -> np.ndarray:
        """Bitmaps of rows of one width, folded to another."""
        found = self.rows[int(self.width[at[0]])][self.place[at]]
        while found.shape[1] * 8 > width:
            half = found.shape[1] // 2
            found = found[:, :half] | found[:, half:]
        return found

    def may_reach(self, x: np.ndarray, y: np.ndarray, size: np.ndarray, percent: int) -> np.ndarray:
        out = np.zeros(len(x), bool)
        for a, b in {(int(a), int(b)) for a, b in zip(self.width[x], self.width[y], strict=True)}:
            at = np.flatnonzero((self.width[x] == a) & (self.width[y] == b))
            for lo in range(0, len(at), 1024):
                k = at[lo : lo + 1024]
                p, q = self.of(x[k], min(a, b)), self.of(y[k], min(a, b))
                out[k] = overlap_bound(p, q, size[x[k]], size[y[k]]) >= needed(size[x[k]], size[y[k]], percent)
        return out


def tile_starts(table: pa.Table) -> np.ndarray:
    """Which rows begin a tile."""
    new = np.zeros(table.num_rows, bool)
    new[:1] = True
    for name in ("leader", "band", "i", "j", "next"):
        values = np.array(table.column(name).to_pylist(), dtype="S16") if name == "leader" else table.column(name).to_numpy()
        new[1:] |= values[1:] != values[:-1]
    return new


def pairs_of(table: pa.Table, percent: int) -> pa.RecordBatch:
    """Pairs (a, b) of whole tiles whose bitmaps allow a link.

    Rows d places apart are compared at once, for d = 1, 2, ..., while they share a tile and their sizes fit: rows of a tile
    are sorted by size, so a row that has met one too large is done.
    """
    tile = np.cumsum(tile_starts(table))
    size, side, follows = (table.column(c).to_numpy() for c in ("n", "side", "next"))
    two_sided = (follows == 1) | (table.column("i").to_numpy() != table.column("j").to_numpy())
    keys = table.column("class_key").to_pylist()
    _, label = np.unique(np.array(table.column("label").to_pylist(), dtype="S16"), return_inverse=True)
    bits = np.frombuffer(b"".join(table.column("bitmap").to_pylist()), np.uint64).reshape(len(keys), -1)
    wide = WideBitmaps(table.column("wide").to_pylist())
    found: list[np.ndarray] = []
    on = np.arange(len(keys))
    for d in range(1, len(keys)):
        on = on[: np.searchsorted(on, len(keys) - d)]
        on = on[(tile[on] == tile[on + d]) & (100 * size[on] >= percent * size[on + d])]
        if not len(on):
            break
        p = on[(label[on] != label[on + d]) & (~two_sided[on] | (side[on] != side[on + d]))]
        for lo in range(0, len(p), 8192):
            x, y = p[lo : lo + 8192], p[lo : lo + 8192] + d
            good = overlap_bound(bits[x], bits[y], size[x], size[y]) >= needed(size[x], size[y], percent)
            x, y = x[good], y[good]
            if len(x):
                good = wide.may_reach(x, y, size, percent)
                found.append(np.stack([x[good], y[good]]))
    out = {(min(keys[x], keys[y]), max(keys[x], keys[y])) for x, y in np.concatenate(found, 1).T.tolist()} if found else set()
    return pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.binary()), pa.array([b for _, b in out], pa.binary())], names=["a", "b"])


def counts_of(table: pa.Table, percent: int) -> pa.RecordBatch:
    """(class_key, links) for the rows of whole tiles that have any: exact links to other rows of the tile."""
    tile = np.cumsum(tile_starts(table))
    sets = [unpack(x) for x in table.column("grams").to_pylist()]
    size = np.array([len(x) for x in sets])
    order = np.lexsort((size, tile))
    side, two_sided = table.column("side").to_numpy(), (table.column("next").to_numpy() == 1) | (table.column("i").to_numpy() != table.column("j").to_numpy())
    size, side, two_sided = size[order], side[order], two_sided[order]
    grams, member = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True)
    cut = np.r_[0, np.cumsum(size)]
    held = np.zeros(len(grams), bool)
    links = np.zeros(len(size), np.int64)
    ends = np.searchsorted(tile, tile, side="right")
    for x in range(len(size) - 1):
        # Rows of a tile are sorted by size: those from x + 1 to end can link with x.
        end = x + 1 + int(np.searchsorted(percent * size[x + 1 : ends[x]], 100 * size[x], side="right"))
        if end == x + 1 or two_sided[x] and (side[x + 1 : end] == side[x]).all():
            continue
        own = member[cut[x] : cut[x + 1]]
        held[own] = True
        both = np.add.reduceat(held[member[cut[x + 1] : cut[end]]], cut[x + 1 : end] - cut[x + 1], dtype=np.int64)
        held[own] = False
        good = both >= needed(size[x], size[x + 1 : end], percent)
        if two_sided[x]:
            good &= side[x + 1 : end] != side[x]
        links[x] += good.sum()
        links[x + 1 : end] += good
    some = np.flatnonzero(links)
    return pa.RecordBatch.from_arrays([table.column("class_key").combine_chunks().take(pa.array(order[some])).cast(pa.binary()), pa.array(links[some])], names=["class_key", "links"])


def by_tiles(make):
    """make's batch for every chunk of whole tiles: they come one after the other; a chunk ends where a tile does."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for b in batches:
            held.append(b)
            rows += b.num_rows
            if rows < 4096 and sum(x.nbytes for x in held) < 1 << 24:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            border = np.flatnonzero(tile_starts(table))[-1]
            if border:
                yield make(table.slice(0, border))
                table = table.slice(border)
            held, rows = table.to_batches(), table.num_rows
        if held:
            yield make(pa.Table.from_batches(held).combine_chunks())

    return run


def jaccard_classes(docs: DataFrame, n: int = 3, percent: int = 90, count: bool = True) -> DataFrame:
    """One row per document: doc_id, n_shingles, class_key, component_id (smallest doc_id reachable by links), class_links.

    Null, empty and wordless texts have no n-grams, link with nothing and are their own component. A text with fewer words
    than n is one n-gram. Repeated rows fall in one class; a null doc_id never becomes a component_id unless a component
    has no other. class_links is the number of other classes that this one links with, all of them; without ``count`` (where
    only components are wanted) it is left out and the pairs inside a hub's group are not compared.
    """
    spark = docs.sparkSession
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for every document, then rows with this task's n-gram counts by bin."""
        from pyspark import TaskContext

        powers, bins, seen = Powers(), np.zeros(BINS, np.int64), np.zeros(BINS, np.int64)
        names = ["doc_id", "n_shingles", "class_key", "chunk", "part", "counts"]
        for b in slices(batches):
            found = gram_sets(b.column("text"), n, powers, seen)
            if found:
                bins += np.bincount((np.concatenate(found) & np.uint64(BINS - 1)).astype(np.int64), minlength=BINS)
            none = pa.nulls(len(found), pa.int32())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(x) for x in found], pa.int64()), pa.array([key_of(x) if len(x) else None for x in found], pa.binary()), none, none, pa.nulls(len(found), pa.binary())], names=names)
        if bins.any():
            k = 2 * BINS // CHUNK
            part = TaskContext.get().partitionId() % SALT
            yield pa.RecordBatch.from_arrays([pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.binary()), pa.array(range(k), pa.int32()), pa.array([part] * k, pa.int32()), pa.array([x.tobytes() for x in np.concatenate([bins, seen]).reshape(k, CHUNK)], pa.binary())], names=names)

    gathered = materialize(base.mapInArrow(gather, "doc_id long, n_shingles long, class_key binary, chunk int, part int, counts binary"), "jaccard-members")
    members = gathered.filter("chunk is null").select("doc_id", "n_shingles", "class_key")
    # The document that names its class: the smallest doc_id that has the set.
    stands = members.filter("class_key is not null").groupBy("class_key").agg(F.min("doc_id").alias("doc_id"))

    def add_bins(key: tuple, rows: pa.Table) -> pa.Table:
        total = np.zeros(CHUNK, np.int64)
        for x in rows.column("counts").to_pylist():
            total += np.frombuffer(x, np.int64)
        return pa.table({"chunk": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([total.tobytes()], pa.binary())})

    frequency = np.zeros(2 * BINS, np.int64)  # of n-grams, then of words; so many numbers whatever the input
    by_part = gathered.filter("chunk is not null").select("chunk", "part", "counts").groupBy("chunk", "part").applyInArrow(add_bins, "chunk int, counts binary")
    for r in by_part.groupBy("chunk").applyInArrow(add_bins, "chunk int, counts binary").collect():  # 2 * BINS / CHUNK rows
        frequency[r.chunk * CHUNK : (r.chunk + 1) * CHUNK] = np.frombuffer(r.counts, np.int64)
    of_grams, of_words = frequency[:BINS].astype(float), frequency[BINS:]
    # A bin well above the mean holds an n-gram of many texts; in the others a count says nothing about one n-gram.
    common = np.where(of_grams > of_grams.mean() + 6 * math.sqrt(of_grams.mean()) + 2, of_grams, 0.0)
    shared = spark.sparkContext.broadcast((common, np.log1p(of_words)))

    def classes_in(batches: Iterator[pa.RecordBatch], make, rarity: np.ndarray | None = None) -> Iterator[list]:
        """make's rows for every class of the task, once each."""
        powers, done = Powers(), set()
        for b in slices(batches):
            out = []
            for found in gram_sets(b.column("text"), n, powers, rarity=rarity):
                grams, weights = (found, None) if rarity is None else found
                if len(grams) and (key := key_of(grams)) not in done and (row := make(key, grams, weights)):
                    done.add(key)
                    out.append(row)
            yield out

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, rarity = shared.value

        def make(key: bytes, grams: np.ndarray, weights: np.ndarray) -> tuple:
            order = np.lexsort((grams, weights, often[(grams & np.uint64(BINS - 1)).astype(np.int64)]))[: prefix_length(len(grams), percent)]
            return key, len(grams), bitmap_of(grams).tobytes(), wide_bitmap_of(grams), grams[order].view(np.int64)

        for out in classes_in(batches, make, rarity):
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.binary()), pa.array([x[3] for x in out], pa.binary()), pa.array([x[4] for x in out], pa.list_(pa.int64()))], names=["class_key", "n", "bitmap", "wide", "prefix"])

    indexed = base.mapInArrow(index, "class_key binary, n long, bitmap binary, wide binary, prefix array<long>")
    indexed = materialize(indexed.groupBy("class_key").agg(*[F.first(x).alias(x) for x in ("n", "bitmap", "wide", "prefix")]), "jaccard-index")
    grams = indexed.select(F.explode("prefix").alias("gram")).groupBy("gram").agg(F.count("*").alias("holders")).filter("holders > 1")
    may_share = spark.sparkContext.broadcast(filter_of(grams.select((F.col("gram").bitwiseAND(F.lit(FILTER - 1).cast("long"))).cast("int").alias("bit"))))

    def entries_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(gram, at, class_key, n) for the grams that the filter lets through; the aggregation below is exact."""
        for x in slices(batches):
            lists = x.column("prefix")
            gram = lists.flatten().to_numpy()
            size = lists.value_lengths().to_numpy()
            row = np.repeat(np.arange(x.num_rows), size)
            at = np.arange(len(gram)) - np.repeat(np.cumsum(size) - size, size)
            on = is_set(may_share.value, gram & (FILTER - 1))
            take = pa.array(row[on])
            yield pa.RecordBatch.from_arrays([pa.array(gram[on]), pa.array(at[on].astype(np.int32)), x.column("class_key").take(take), x.column("n").take(take)], names=["gram", "at", "class_key", "n"])

    entries = materialize(indexed.select("class_key", "n", "prefix").mapInArrow(entries_of, "gram long, at int, class_key binary, n long"), "jaccard-entries")
    leaders = entries.groupBy("gram").agg(F.count("*").alias("holders"), F.min(F.struct("at", "n", "class_key")).alias("leader")).filter("holders > 1")
    shared_grams = materialize(entries.join(leaders, "gram").select("gram", "at", "class_key", "n", "holders", F.col("leader.class_key").alias("leader"), F.col("leader.n").alias("leader_n")), "jaccard-shared")
    sized = (100 * F.least("n", "leader_n") >= percent * F.greatest("n", "leader_n")) & (F.col("class_key") != F.col("leader"))
    spokes = shared_grams.filter(sized).select(F.least("class_key", "leader").alias("a"), F.greatest("class_key", "leader").alias("b")).distinct()

    def likely_of(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) whose wide bitmaps allow a link."""
        left = indexed.select(F.col("class_key").alias("a"), F.col("n").alias("na"), F.col("wide").alias("bits_a"))
        right = indexed.select(F.col("class_key").alias("b"), F.col("n").alias("nb"), F.col("wide").alias("bits_b"))

        def may_link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for x in slices(batches):
                columns = [x.column(c).to_pylist() for c in ("bits_a", "bits_b", "na", "nb")]
                kept = x.filter(pa.array([may_reach(*row, percent) for row in zip(*columns, strict=True)], pa.bool_()))
                yield pa.RecordBatch.from_arrays([kept.column("a"), kept.column("b")], names=["a", "b"])

        return pairs.join(left, "a").join(right, "b").select("a", "b", "na", "nb", "bits_a", "bits_b").mapInArrow(may_link, "a binary, b binary")

    def sets_of(wanted: DataFrame) -> DataFrame:
        """(class_key, grams) of the wanted classes and, by chance, of a few others."""
        # A filter of fixed size tells most rows that nobody needs them; the joins that follow are exact.
        bit = (F.conv(F.hex(F.substring("class_key", 1, 4)), 16, 10).cast("long") % FILTER).cast("int")
        sought = spark.sparkContext.broadcast(filter_of(wanted.select(bit.alias("bit"))))

        def arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = sought.value
            for out in classes_in(batches, lambda key, grams, _: (key, pack(grams)) if is_set(known, int.from_bytes(key[:4], "big") % FILTER) else None):
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.binary()), pa.array([g for _, g in out], pa.binary())], names=["class_key", "grams"])

        return base.mapInArrow(arrays, "class_key binary, grams binary").groupBy("class_key").agg(F.first("grams").alias("grams"))

    def exact(pairs: DataFrame, name: str) -> DataFrame:
        """The pairs (a, b) that link, by intersecting the sorted arrays."""
        likely = materialize(pairs, f"{name}-likely")
        sets = sets_of(likely.select(F.col("a").alias("class_key")).unionByName(likely.select(F.col("b").alias("class_key"))).distinct())
        asked = likely.select(F.explode(F.array(F.struct(F.col("a").alias("class_key"), F.lit(0).alias("side")), F.struct(F.col("b").alias("class_key"), F.lit(1).alias("side")))).alias("x"), "a", "b").select("x.*", "a", "b")
        sent = asked.join(sets, "class_key").select("a", "b", "side", "grams")
        whole = sent.groupBy("a", "b").agg(F.min(F.struct("side", "grams")).alias("p"), F.max(F.struct("side", "grams")).alias("q"))

        def intersect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for x in slices(batches):
                good = []
                for p, q in zip(x.column("p").to_pylist(), x.column("q").to_pylist(), strict=True):
                    p, q = unpack(p), unpack(q)
                    both = np.sort(np.concatenate([p, q]), kind="stable")
                    good.append(int((both[1:] == both[:-1]).sum()) >= needed(len(p), len(q), percent))
                kept = x.filter(pa.array(good, pa.bool_()))
                yield pa.RecordBatch.from_arrays([kept.column("a"), kept.column("b")], names=["a", "b"])

        return materialize(whole.select("a", "b", F.col("p.grams").alias("p"), F.col("q.grams").alias("q")).mapInArrow(intersect, "a binary, b binary"), f"{name}-links")

    star_links = exact(likely_of(spokes), "jaccard-star")
    # Classes that link to the same leader are connected: one label each, no need to compare them again.
    both_ways = star_links.unionByName(star_links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    degree = both_ways.groupBy("a").agg(F.count("*").alias("degree"))
    hub = both_ways.join(degree.withColumnRenamed("a", "b"), "b").groupBy("a").agg(F.max_by("b", F.struct("degree", "b")).alias("hub"), F.max("degree").alias("hub_degree"))
    label = materialize(hub.join(degree, "a").select(F.col("a").alias("class_key"), F.when(F.col("degree") >= F.col("hub_degree"), F.col("a")).otherwise(F.col("hub")).alias("label")), "jaccard-label")

    # The leader has met every other holder, so only n-grams with two more holders leave anything open. The holders of all
    # n-grams of one leader meet in its tile, so a class goes there once, whatever number of them it has.
    rest = shared_grams.filter((F.col("holders") > 2) & (F.col("class_key") != F.col("leader"))).select("leader", "class_key", "n").distinct()
    rest = rest.join(label, "class_key", "left").withColumn("label", F.coalesce("label", "class_key"))
    mixed = rest.groupBy("leader").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("holders")).filter("low != high").select("leader", "holders")
    # A leader's holders are dealt to LEADER_SALT tasks; its one row is sent to all of them.
    mixed = mixed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(LEADER_SALT - 1))))
    rest = rest.withColumn("salt", F.pmod(F.xxhash64("class_key"), F.lit(LEADER_SALT)).cast("int")).join(mixed, ["leader", "salt"]).drop("salt")
    whole = F.struct(F.lit(0).alias("band"), F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("side"), F.lit(0).alias("next"))
    ratio = -math.log(percent / 100) * 1.0001  # a little wide, for rounding
    place = lambda band, i, j, side, follows: F.struct(band.cast("int").alias("band"), i.cast("int").alias("i"), j.cast("int").alias("j"), side.cast("int").alias("side"), F.lit(follows).alias("next"))
    span, mine, zero, one = F.sequence(F.lit(0), F.col("blocks") - 1), F.col("block"), F.lit(0), F.lit(1)
    same = F.transform(span, lambda j: place(F.col("band"), F.least(j, mine), F.greatest(j, mine), F.when(j >= mine, zero).otherwise(one), 0))
    lower = F.transform(span, lambda j: place(F.col("band"), mine, j, zero, 1))
    upper = F.transform(span, lambda i: place(F.col("band") - 1, i, mine, one, 1))
    tile = ["leader", "band", "i", "j", "next"]

    def in_tiles(rows: DataFrame) -> DataFrame:
        """Rows (leader, class_key, n, label, blocks), each in every tile it has to be in.

        A leader of more than a block: tiles of block i of a size band against block j of the same band (i <= j) or of the next one.
        """
        few = rows.filter("blocks = 1").select("leader", "class_key", "n", "label", whole.alias("tile"))
        many = rows.filter("blocks > 1").withColumn("band", F.floor(F.log(F.col("n").cast("double")) / F.lit(ratio)).cast("int")).withColumn("block", F.pmod(F.xxhash64("class_key"), F.col("blocks")).cast("int"))
        many = many.select("leader", "class_key", "n", "label", F.explode(F.concat(same, lower, upper)).alias("tile"))
        return few.unionByName(many).select("leader", "class_key", "n", "label", "tile.*")

    def dealt(rows: DataFrame) -> DataFrame:
        return rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *tile).sortWithinPartitions(*tile, "n")

    spread = in_tiles(rest.withColumn("blocks", F.ceil(F.col("holders") / BLOCK).cast("int")))
    open_pairs = dealt(spread.join(indexed.select("class_key", "bitmap", "wide"), "class_key")).mapInArrow(by_tiles(lambda t: pairs_of(t, percent)), "a binary, b binary").distinct()
    links = materialize(star_links.unionByName(exact(open_pairs, "jaccard-rest")).distinct(), "jaccard-all-links")

    found = components(links)
    in_class = found.join(stands.withColumnRenamed("class_key", "node"), "node")
    least = in_class.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    linked = found.join(least, "root").select(F.col("node").alias("class_key"), "component_id")
    per_class = stands.withColumnRenamed("doc_id", "own_id").join(linked, "class_key", "left").select("class_key", F.coalesce("component_id", "own_id").alias("component_id"))
    named = members.join(per_class, "class_key", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    if not count:
        return named.select("doc_id", "n_shingles", "component_id", F.hex("class_key").alias("class_key"))

    # Every pair of different labels that links is in links; those of one label are counted in the label's own tiles.
    sized_label = label.join(indexed.select("class_key", "n"), "class_key")
    groups = sized_label.groupBy("label").agg(F.count("*").alias("holders"), F.sum("n").alias("all_grams")).filter("holders > 1")
    blocks = F.greatest(F.ceil(F.col("holders") / COUNT_BLOCK), F.ceil(F.col("all_grams") / COUNT_GRAMS)).cast("int")
    grouped = sized_label.join(groups.select("label", blocks.alias("blocks")), "label").withColumn("leader", F.col("label"))
    inside = dealt(in_tiles(grouped).join(sets_of(grouped.select("class_key")), "class_key")).mapInArrow(by_tiles(lambda t: counts_of(t, percent)), "class_key binary, links long")
    own = label.select(F.col("class_key").alias("a"), F.col("label").alias("label_a"))
    other = label.select(F.col("class_key").alias("b"), F.col("label").alias("label_b"))
    across = links.join(own, "a", "left").join(other, "b", "left").filter("coalesce(label_a, a) != coalesce(label_b, b)")
    each = across.select(F.explode(F.array("a", "b")).alias("class_key"), F.lit(1).cast("long").alias("links")).unionByName(inside)
    degrees = materialize(each.groupBy("class_key").agg(F.sum("links").alias("class_links")), "jaccard-degrees")
    out = named.join(degrees, "class_key", "left")
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce("class_links", F.lit(0)).alias("class_links"), F.hex("class_key").alias("class_key"))


def keep_one_each(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """The documents with their own columns, one a component: that of the smallest doc_id.

    Rows that repeat doc_id and text stay once. Rows without a doc_id can't be told apart by it: their distinct texts stay.
    """
    own = unused(docs, "own_id")
    kept = jaccard_classes(docs, n, percent, count=False).filter("doc_id <=> component_id").select(F.col("doc_id").alias(own)).distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(F.col(own))).drop(own).dropDuplicates(["doc_id", "text"])
