"""Toxicity by subword-bag embeddings under a linear softmax.

Every word is a bag of hashed character n-grams with its borders marked, and the word itself; a text is the average of
their vectors, and a two-class softmax sits on top. Vectors and weights are trained jointly in numpy on a bounded sample,
so an unseen misspelling shares most of its n-grams' vectors with the word it distorts. Since the classifier is linear, a
word adds a fixed amount to the logit, which is worked out once for each distinct word of a task; the words of a block of
texts are found, hashed and summed in numpy.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailwork.llm.common import Powers, fold, span_hashes, text_blocks, word_spans, words_of

BUCKETS, SIZE = 1 << 16, 8
SHORTEST, LONGEST = 3, 5
#: Rows of each label in the training sample, and entries of their bags in all (documented bounds; an entry takes four bytes).
PER_LABEL, SAMPLE_ENTRIES = 3_000, 48_000_000
EPOCHS, BATCH, RATE = 20, 128, 0.05
#: Pull of the vectors towards 0, each time one is used.
DECAY = 0.03
THRESHOLD = 0.3
#: Bytes of text that are scored at once.
BLOCK = 1 << 20
#: Training texts whose words are spelt at once.
CHUNK = 500


_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def _bucket(hashes: np.ndarray) -> np.ndarray:
    hashes = (hashes ^ (hashes >> np.uint64(29))) * _FACTOR
    return (hashes >> np.uint64(40)).astype(np.int64) % BUCKETS


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, words they belong to) of the character n-grams of <word> and of the word itself, for all words at once."""
    codes = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    starts = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(words)), sizes)
    left = np.repeat(starts + sizes, sizes) - np.arange(len(codes))
    rolling = np.zeros(len(codes), np.uint64)
    ids, owners = [], []
    for k in range(LONGEST):
        rolling = rolling[: len(codes) - k] * _FACTOR + codes[k:]
        if k + 1 >= SHORTEST:
            whole = left[: len(rolling)] > k
            ids.append(_bucket(rolling[whole] + np.uint64(k)))
            owners.append(owner[: len(rolling)][whole])
    # The whole word: a sum over its letters, each mixed with its place in the word.
    place = (np.arange(len(codes)) - np.repeat(starts, sizes)).astype(np.uint64)
    mixed = (codes + place * np.uint64(0x632BE59BD9B4E019)) * _FACTOR
    if len(words):
        ids.append(_bucket(np.add.reduceat(mixed ^ (mixed >> np.uint64(31)), starts)))
        owners.append(np.arange(len(words)))
    return np.concatenate(ids), np.concatenate(owners)


def words(text: str | bytes | None) -> list[str]:
    """Words in lower case, cut at ASCII white space."""
    return [w.decode("utf-8", "surrogatepass").lower() for w in (words_of(text) if isinstance(text, str) else (text or b"").split())]


class Model:
    """vectors (BUCKETS x SIZE), weights (SIZE), bias; logit of label 1 against label 0."""

    def __init__(self, vectors: np.ndarray, weights: np.ndarray, bias: float):
        self.gain, self.bias = (vectors @ weights).astype(np.float64), float(bias)


class Gains:
    """Summed gain and number of subwords of words, by their hashes; kept from block to block."""

    MOST = 1 << 20

    def __init__(self, gain: np.ndarray):
        self.gain = gain
        self.hashes, self.values = np.zeros(0, np.uint64), np.zeros((0, 2))

    def of(self, hashes: np.ndarray, spell: Callable[[int], str]) -> np.ndarray:
        """A row (gain, subwords) for each hash; ``spell`` gives the word at a place where its hash is new."""
        if not len(hashes):
            return np.zeros((0, 2))
        distinct, first, where = np.unique(hashes, return_index=True, return_inverse=True)
        new = ~np.isin(distinct, self.hashes, assume_unique=True)
        if len(self.hashes) + new.sum() > self.MOST:
            self.hashes, self.values, new = self.hashes[:0], self.values[:0], np.ones(len(distinct), bool)
        if new.any():
            ids, owner = subwords([spell(i) for i in first[new].tolist()])
            found = np.stack([np.bincount(owner, self.gain[ids], int(new.sum())), np.bincount(owner, minlength=int(new.sum()))], 1)
            self.hashes = np.r_[self.hashes, distinct[new]]
            order = np.argsort(self.hashes)
            self.hashes, self.values = self.hashes[order], np.r_[self.values, found][order]
        return self.values[np.searchsorted(self.hashes, distinct)][where]


def bags_of(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """(buckets, counts, factor that makes them shares) of each text, in two bytes each; counts above 65,535 are scaled down."""
    counts = [Counter(words(text)) for text in texts]
    spelt = {w: i for i, w in enumerate(dict.fromkeys(w for c in counts for w in c))}
    ids, owner = subwords(list(spelt))
    order = np.argsort(owner, kind="stable")
    ids, cut = ids[order].astype(np.uint16), np.searchsorted(owner[order], np.arange(len(spelt) + 1))
    for c in counts:
        held = [spelt[w] for w in c]
        sizes = cut[1:][held] - cut[:-1][held]
        found = np.bincount(np.concatenate([ids[cut[i] : cut[i + 1]] for i in held] or [ids[:0]]), np.repeat(np.fromiter(c.values(), float, len(c)), sizes), BUCKETS)
        used = np.flatnonzero(found)
        held = found[used]
        held = np.rint(held * min(1.0, 65535 / held.max(initial=1.0)))
        yield used.astype(np.uint16), held.astype(np.uint16), 1 / max(1.0, held.sum())


def fit(bags: list[tuple[np.ndarray, np.ndarray, float]], labels: np.ndarray, prior: float, seed: int = 5) -> Model:
    """Adam on the log loss, vectors and weights together; the bias is then moved from the sample's share to ``prior``.

    A bag is what ``bags_of`` gives for a text.
    """
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / SIZE, 1 / SIZE, (BUCKETS, SIZE)).astype(np.float32)
    weights = rng.normal(0, 1, SIZE).astype(np.float32)
    bias = np.zeros(1, np.float32)
    first, second = [np.zeros_like(vectors), np.zeros_like(weights), np.zeros(1, np.float32)], [np.zeros_like(vectors), np.zeros_like(weights), np.zeros(1, np.float32)]
    shares = np.zeros((BATCH, BUCKETS), np.float32)
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(bags))
        for lo in range(0, len(order), BATCH):
            part = [i for i in order[lo : lo + BATCH] if len(bags[i][0])]
            if not part:
                continue
            step += 1
            used = np.zeros((BUCKETS, 1), np.float32)
            for row, i in enumerate(part):
                shares[row, bags[i][0]] = bags[i][1] * np.float32(bags[i][2])
                used[bags[i][0]] = 1
            batch = shares[: len(part)]
            hidden = batch @ vectors
            p = 1 / (1 + np.exp(-(hidden @ weights + bias)))
            error = ((p - labels[part]) / len(part)).astype(np.float32)
            slopes = (batch.T @ (error[:, None] * weights), error @ hidden, error.sum(keepdims=True))
            fix = np.float32(np.sqrt(1 - 0.999**step) / (1 - 0.9**step))
            for k, (x, g) in enumerate(zip((vectors, weights, bias), slopes, strict=True)):
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                x -= RATE * fix * first[k] / (np.sqrt(second[k]) + 1e-8)
            vectors *= 1 - RATE * DECAY * used
            for row, i in enumerate(part):
                shares[row, bags[i][0]] = 0
    share_1 = float(np.clip(labels.mean(), 1e-6, 1 - 1e-6))
    prior = float(np.clip(prior, 1e-6, 1 - 1e-6))
    return Model(vectors, weights, float(bias[0]) + np.log(prior / (1 - prior)) - np.log(share_1 / (1 - share_1)))


def with_bag(docs: DataFrame, out: str = "bag") -> DataFrame:
    """Add the bag of the whole text in a binary column: its buckets, then their counts, two bytes each."""

    @F.arrow_udf("binary")
    def bag(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            made = (x for lo in range(0, len(texts), CHUNK) for x in bags_of(texts[lo : lo + CHUNK].to_pylist()))
            yield pa.array([used.tobytes() + held.tobytes() for used, held, _ in made], pa.binary())

    return docs.withColumn(out, bag.asNondeterministic()(F.col("text")))


def train(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL, most_entries: int = SAMPLE_ENTRIES) -> Model | None:
    """Learn from at most per_label rows of each label, drawn by a seeded hash. None where nothing is labelled.

    Texts are spelt where they lie; their bags reach the driver. Rows are taken in the order of the draw until their bags
    could have ``most_entries`` entries in all; a text of any length takes as many as there are buckets at most, so it is
    drawn like any other.
    """
    marks = labels.filter("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r.toxic: r.n for r in marks.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    limit = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, per_label / n))])
    draw = F.xxhash64("doc_id")
    part = F.pmod(draw, F.lit(1 << 30)) / float(1 << 30)
    drawn = F.broadcast(marks.filter(part < limit[F.col("toxic")]).orderBy("toxic", draw).limit(4 * per_label))  # so many rows at most
    # An n-gram of a text begins at most three times at a letter, but far fewer are different; two a byte is seldom reached.
    entries = F.least(2 * F.octet_length("text"), F.lit(BUCKETS))
    texts = docs.filter("text is not null").select("doc_id", "text", entries.alias("size"), F.crc32(F.col("text").cast("binary")).alias("crc"))
    offered = texts.join(drawn, "doc_id").select("doc_id", "toxic", "size", "crc", draw.alias("draw")).distinct().orderBy("draw", "doc_id", "size", "crc").limit(4 * per_label).collect()
    left, chosen = most_entries, []
    for r in offered:
        left -= r["size"]
        if left < 0:
            break
        chosen.append((r.doc_id, r["size"], r.crc, r.toxic))
    if not chosen:
        return None
    wanted = F.broadcast(docs.sparkSession.createDataFrame(chosen, "doc_id long, size int, crc long, toxic int"))
    # Equal texts of one id give one bag.
    rows = with_bag(texts.join(wanted, ["doc_id", "size", "crc"])).groupBy("doc_id", "size", "crc", "toxic").agg(F.min("bag").alias("bag")).select("doc_id", "crc", "toxic", "bag").toArrow()
    order = np.lexsort((rows.column("crc").to_numpy(), rows.column("doc_id").to_numpy()))
    bags = []
    for held in rows.column("bag").combine_chunks().take(pa.array(order)):
        both = np.frombuffer(held.as_buffer(), np.uint16)
        counted = both[len(both) // 2 :]
        bags.append((both[: len(both) // 2], counted, 1 / max(1.0, float(counted.sum(dtype=np.float64)))))
    return fit(bags, rows.column("toxic").to_numpy()[order].astype(np.float32), counts.get(1, 0) / sum(counts.values()))


def with_toxicity(docs: DataFrame, model: Model | None, out: str = "toxicity") -> DataFrame:
    """Add a double: probability of label 1 for the whole text. Null, empty and wordless texts get the model's bias alone.

    Without a model it is 0.5. Extra columns stay; repeated rows get the same answer.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def toxicity(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = shared.value
        gains, powers = Gains(m.gain if m else np.zeros(BUCKETS)), Powers()
        for texts in batches:
            total, subs = np.zeros(len(texts)), np.zeros(len(texts))
            for data, borders, rows in text_blocks(texts, BLOCK) if m else ():
                starts, ends = word_spans(data, borders)
                found = gains.of(span_hashes(data, starts, ends, powers), lambda i: data[starts[i] : ends[i]].tobytes().decode("utf-8", "replace").lower())
                owner = rows[np.searchsorted(borders, starts, side="right") - 1]
                total += np.bincount(owner, found[:, 0], len(texts))
                subs += np.bincount(owner, found[:, 1], len(texts))
            logit = (m.bias if m else 0.0) + total / np.maximum(subs, 1)
            yield pa.array(1 / (1 + np.exp(-np.clip(logit, -500, 500))))

    return docs.withColumn(out, toxicity.asNondeterministic()(F.col("text")))


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row; labels of held-out rows are never read."""
    model = train(docs, labels.filter(~fold(F.col("doc_id"), 4, 2)))
    rows = docs.select("doc_id", fold(F.col("doc_id"), 4, 2).alias("held_out"), "text")
    return with_toxicity(rows, model, "score").select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
