"""Hidden Markov language model.

Words fall into classes: each of the most frequent words is one, the end of a text is one, and the others share a fixed
number of classes by their last three bytes. A word's probability is its class's emission by the latent state times its
share of the class, (c + 0.5) / (N + 0.5 (V + 1)) over the class's training tokens, so every training count of the whole
corpus enters and unseen words keep some probability. Baum-Welch trains the states: tasks run the scaled
forward-backward recursion over their texts (cut into segments for training) and send expected counts, Spark adds them up
across partitions, and the driver, which holds only the fixed-size parameters, divides. Scores come from the scaled forward
recursion over whole texts. Counts of words beyond a broadcast head of fixed size meet the texts in a join.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailwork.llm.common import fold, lower_words_of, materialize

STATES, ROUNDS, SEGMENT = 8, 5, 256
#: Words with a class of their own; classes of the other words; words whose counts are broadcast.
OWN, SUFFIXES, HEAD = 2048, 1024, 1 << 17
END = OWN
CLASSES = OWN + 1 + SUFFIXES
#: Expected counts travel as whole numbers of this fraction, so their sum doesn't depend on its order.
GRAIN = 1 << 16


def suffix_class(word: bytes) -> int:
    return OWN + 1 + zlib.crc32(word[-3:]) % SUFFIXES


def grids(sequences: list[np.ndarray], most_rows: int, most_cells: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(indices, grid[time, row], rows alive at each time): sequences side by side, longest first."""
    lengths = np.array([len(s) for s in sequences], np.int64)
    order = np.argsort(-lengths, kind="stable")
    order = order[lengths[order] > 0]
    lo = 0
    while lo < len(order):
        n = max(1, min(most_rows, most_cells // int(lengths[order[lo]])))
        at = order[lo : lo + n]
        size = lengths[at]
        grid = np.zeros((int(size[0]), len(at)), np.uint16)
        for k, i in enumerate(at):
            grid[: size[k], k] = sequences[i]
        yield at, grid, np.searchsorted(-size, -np.arange(1, int(size[0]) + 1), side="right")
        lo += n


def log_likelihood(sequences: list[np.ndarray], start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> np.ndarray:
    """Natural log probability of every sequence, by the scaled forward recursion. emit: classes x states."""
    out = np.zeros(len(sequences))
    for at, grid, alive in grids(sequences, 2048, 1 << 22):
        total = np.zeros(len(at))
        alpha = start * emit[grid[0]]
        for t in range(len(grid)):
            n = alive[t]
            if t:
                alpha = (alpha[:n] @ move) * emit[grid[t, :n]]
            scale = alpha.sum(1)
            alpha /= scale[:, None]
            total[:n] += np.log(scale)
        out[at] = total
    return out


def expected_counts(sequences: list[np.ndarray], start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected starts, moves and emissions (classes x states) of one Baum-Welch round."""
    k = len(start)
    starts, moves, emissions = np.zeros(k), np.zeros((k, k)), np.zeros(emit.shape)
    for _, grid, alive in grids(sequences, 1024, 1 << 18):
        steps, rows = grid.shape
        seen = emit[grid]
        alpha, beta, scale = np.zeros((steps, rows, k)), np.zeros((steps, rows, k)), np.ones((steps, rows))
        for t in range(steps):
            n = alive[t]
            a = (alpha[t - 1, :n] @ move if t else start) * seen[t, :n]
            scale[t, :n] = a.sum(1)
            alpha[t, :n] = a / scale[t, :n, None]
        for t in range(steps - 1, -1, -1):
            n = alive[t]
            beta[t, :n] = 1
            if t + 1 < steps and (later := alive[t + 1]):
                b = seen[t + 1, :later] * beta[t + 1, :later] / scale[t + 1, :later, None]
                beta[t, :later] = b @ move.T
                moves += move * (alpha[t, :later].T @ b)
        gamma = alpha * beta
        starts += gamma[0].sum(0)
        on = np.arange(rows)[None, :] < alive[:, None]
        classes = grid[on]
        for s in range(k):
            emissions[:, s] += np.bincount(classes, gamma[..., s][on], len(emit))
    return starts, moves, emissions


def first_guess(texts: list[np.ndarray], overall: np.ndarray, k: int) -> np.ndarray:
    """Emissions (classes x states) from k texts that differ most from each other, each blended with the whole corpus."""
    shares = [np.bincount(t, minlength=len(overall)) / len(t) for t in texts]
    roots = [np.sqrt(s) for s in shares]
    chosen: list[int] = []
    while len(chosen) < min(k, len(texts)):
        near = [max((float(roots[i] @ roots[j]) for j in chosen), default=-float(roots[i] @ np.sqrt(overall))) for i in range(len(texts))]
        chosen.append(min((i for i in range(len(texts)) if i not in chosen), key=lambda i: (near[i], i)))
    rng = np.random.default_rng(3)
    columns = [0.7 * shares[i] + 0.3 * overall for i in chosen]
    while len(columns) < k:
        noisy = overall * rng.uniform(0.5, 1.5, len(overall))
        columns.append(noisy / noisy.sum())
    return np.stack(columns, 1)


def score_texts(docs: DataFrame, held, states: int = STATES, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row; learned where ``held`` is false.

    A null or empty text is the end token alone. Repeated rows each get a row. With nothing to learn from, every base
    probability is 1 and the model is uniform.
    """
    spark = docs.sparkSession
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[bytes] = Counter()

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array([suffix_class(w) for w in found], pa.int32()), pa.array(list(found.values()), pa.int64())], names=["token", "class", "c"])

        for b in batches:
            for text in b.column("text").to_pylist():
                found.update(lower_words_of(text))
            if len(found) > 500_000:
                yield rows()
                found.clear()
        yield rows()

    learned = base.filter(~F.col("held_out"))
    counts = learned.select("text").mapInArrow(count, "token binary, class int, c long").groupBy("token").agg(F.max("class").alias("class"), F.sum("c").alias("c"))
    counts = materialize(counts, "hmm-counts")
    n_texts = learned.count()
    by_class = counts.groupBy("class").agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()  # SUFFIXES rows
    n_tokens = sum(r.n for r in by_class) + n_texts
    n_types = sum(r.v for r in by_class) + (n_texts > 0)
    # A lower bound of the counts of the HEAD most frequent words, so that few others are sorted.
    level = F.floor(F.log2(F.col("c").cast("double")) * 8)
    levels = sorted(((r.level, r.least, r.n) for r in counts.groupBy(level.alias("level")).agg(F.min("c").alias("least"), F.count("*").alias("n")).collect()), reverse=True)  # 8 a doubling
    least, reached = 1, 0
    for _, least, n in levels:
        reached += n
        if reached >= HEAD:
            break
    head = counts.filter(F.col("c") >= least).orderBy(F.desc("c"), "token").limit(HEAD).select("token", "class", "c").toArrow()  # HEAD rows
    tokens, head_class, head_c = head.column("token").to_pylist(), head.column("class").to_numpy().copy(), head.column("c").to_numpy()
    class_n, class_v = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in by_class:
        class_n[r["class"]], class_v[r["class"]] = r.n, r.v
    np.subtract.at(class_n, head_class[:OWN], head_c[:OWN])
    np.subtract.at(class_v, head_class[:OWN], 1)
    overall = class_n.copy()
    overall[: len(head_c[:OWN])] = head_c[:OWN]
    overall[END] = n_texts
    overall = (overall + 0.01) / (overall + 0.01).sum()
    below = n_tokens + 0.5 * (n_types + 1)
    head_base = np.log10((head_c + 0.5) / below)
    head_word = np.log10((head_c + 0.5) / (class_n + 0.5 * (class_v + 1))[head_class])
    head_word[:OWN] = 0.0
    head_class[:OWN] = np.arange(len(head_class[:OWN]))
    end_base = float(np.log10((n_texts + 0.5) / below))
    known = spark.sparkContext.broadcast((tokens, head_class.astype(np.uint16), head_base, head_word))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        words_, classes, bases, shares = known.value
        place = {w: i for i, w in enumerate(words_)}
        row = TaskContext.get().partitionId() << 33
        for b in batches:
            out: list[tuple] = []
            tail_words: list[bytes] = []
            tail_k: list[int] = []
            tail_class: list[int] = []
            ends = [0]
            for text in b.column("text").to_pylist():
                words = lower_words_of(text)
                at = np.fromiter((place.get(w, -1) for w in words), np.int64, len(words))
                sequence = np.full(len(words) + 1, END, np.uint16)
                inside = np.flatnonzero(at >= 0)
                sequence[inside] = classes[at[inside]]
                outside = np.flatnonzero(at < 0).tolist()
                rest = Counter(words[i] for i in outside)
                code = {w: suffix_class(w) for w in rest}
                if outside:
                    sequence[outside] = [code[words[i]] for i in outside]
                tail_words += rest
                tail_k += rest.values()
                tail_class += code.values()
                ends.append(len(tail_words))
                out.append((row, len(words) + 1, len(inside) + (n_texts > 0), float(bases[at[inside]].sum()) + end_base, float(shares[at[inside]].sum()), sequence.tobytes()))
                row += 1
            tail = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(tail_words, pa.binary()), pa.array(tail_k, pa.int64()), pa.array(tail_class, pa.int32())], names=["token", "k", "class"]))
            columns = list(zip(*out, strict=True)) or [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), *[pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], tail], names=["doc_id", "held_out", "row", "n_tokens", "n_known", "base", "word", "sequence", "tail"])

    encoded = materialize(base.mapInArrow(encode, "doc_id long, held_out boolean, row long, n_tokens long, n_known long, base double, word double, sequence binary, tail array<struct<token:binary,k:long,class:int>>"), "hmm-encoded")

    def sequences(b: pa.RecordBatch) -> list[np.ndarray]:
        return [np.frombuffer(x, np.uint16) for x in b.column("sequence").to_pylist()]

    training = encoded.filter(~F.col("held_out")).select("sequence")
    seeds = encoded.filter(~F.col("held_out") & (F.col("n_tokens") >= 50)).select("sequence", F.xxhash64("row").alias("draw")).orderBy("draw", "sequence").limit(12 * states).toArrow()
    emit = first_guess([np.frombuffer(x, np.uint16) for x in seeds.column("sequence").to_pylist()], overall, states)
    start, move = np.full(states, 1 / states), np.full((states, states), 0.1 / states) + 0.9 * np.eye(states)
    for _ in range(rounds if n_texts else 0):
        sent = spark.sparkContext.broadcast((start, move, emit))

        def expect(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            total = np.zeros(states + states * states + CLASSES * states)
            for b in batches:
                cut = [s[i : i + SEGMENT] for s in sequences(b) for i in range(0, len(s), SEGMENT)]
                total += np.concatenate([x.ravel() for x in expected_counts(cut, *sent.value)])
            whole = np.rint(total * GRAIN).astype(np.int64)
            slots = np.flatnonzero(whole)
            yield pa.RecordBatch.from_arrays([pa.array(slots.astype(np.int32)), pa.array(whole[slots])], names=["slot", "value"])

        summed = training.mapInArrow(expect, "slot int, value long").groupBy("slot").agg(F.sum("value").alias("value")).toArrow()  # one row a parameter
        total = np.zeros(states + states * states + CLASSES * states)
        total[summed.column("slot").to_numpy()] = summed.column("value").to_numpy() / GRAIN
        start = total[:states] + 1
        start /= start.sum()
        move = total[states : states + states**2].reshape(states, states) + 1
        move /= move.sum(1, keepdims=True)
        emit = total[states + states**2 :].reshape(CLASSES, states) + 20 * overall[:, None]
        emit /= emit.sum(0)
    final = spark.sparkContext.broadcast((start, move, emit))

    def forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            score = log_likelihood(sequences(b), *final.value) / np.log(10)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("doc_id", "held_out", "row", "n_tokens", "n_known", "base", "word")], pa.array(score)], names=["doc_id", "held_out", "row", "n_tokens", "n_known", "base", "word", "forward"])

    scored = encoded.select("doc_id", "held_out", "row", "n_tokens", "n_known", "base", "word", "sequence").mapInArrow(forward, "doc_id long, held_out boolean, row long, n_tokens long, n_known long, base double, word double, forward double")
    shares = F.broadcast(spark.createDataFrame([(i, float(class_n[i] + 0.5 * (class_v[i] + 1))) for i in range(OWN + 1, CLASSES)], "class int, class_below double"))
    tail = encoded.select("row", F.explode("tail").alias("t")).select("row", "t.token", "t.k", "t.class")
    met = tail.join(counts.select("token", "c"), "token", "left").withColumn("c", F.coalesce("c", F.lit(0))).join(shares, "class")
    rest = met.groupBy("row").agg(F.sum(F.col("k") * F.log10((F.col("c") + 0.5) / below)).alias("tail_base"), F.sum(F.col("k") * F.log10((F.col("c") + 0.5) / F.col("class_below"))).alias("tail_word"), F.sum(F.when(F.col("c") > 0, F.col("k")).otherwise(0)).alias("tail_known"))
    both = scored.join(rest, "row", "left")
    plus = lambda a, b: F.col(a) + F.coalesce(F.col(b), F.lit(0))
    return both.select("doc_id", "held_out", "n_tokens", plus("n_known", "tail_known").cast("long").alias("n_known"), F.lit(n_tokens).cast("long").alias("train_tokens"), plus("base", "tail_base").alias("base_score"), (F.col("forward") + plus("word", "tail_word")).alias("score"))


def language_model_report(docs: DataFrame) -> DataFrame:
    return score_texts(docs, fold(F.col("doc_id"), 5, 1))
