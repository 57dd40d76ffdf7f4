"""Quality scores by Bradley-Terry pairwise ranking.

Of a pair of labelled documents, one good and one bad, the good one should win; the chance that it does is the logistic of
the difference of the two scores. Scores are linear in features of the form of a text, so the loss is that of a logistic
regression on feature differences, minimised by Newton's method over all pairs of all labelled documents. What a row adds
depends on the other side's scores alone, so a round counts the scores in narrow bins and then adds up rows, not pairs.
Only differences are learned: where good begins is a quantile of the scores, at the share of bad labels, and a document's
probability is that of winning against a document at this quantile.

Features are shares, so a text of any length is measured whole: bytes, pairs of classes of neighbouring bytes, lengths of
words, and how much of its words and lines repeat. They are counted for a block of texts at once in numpy.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailwork.llm.common import Powers, fold, in_order, materialize, slices, span_hashes, text_blocks, word_spans

#: Pull of the weights towards 0, rounds of Newton's method at most, and the gain below which they end.
RIDGE, ROUNDS, ENOUGH = 1e-3, 25, 1e-5
#: Width of the bins in which scores are counted, and spans of them at most that the curvature tells apart.
WIDTH, SPANS = 1 / 128, 64
THRESHOLD = 0.5
#: Bytes of text that are measured at once.
BLOCK = 1 << 20

_CLASSES = ("a-z", "A-Z", "0-9", "white space", "line feed", ".,;:", "!?", "quotes and brackets", "other ASCII", "not ASCII")
_CLASS = np.full(256, 8, np.uint8)
for _members, _class in ((range(97, 123), 0), (range(65, 91), 1), (range(48, 58), 2), (b" \t\v\f\r", 3), (b"\n", 4), (b".,;:", 5), (b"!?", 6), (b"\"'`()[]{}", 7), (range(128, 256), 9)):
    _CLASS[list(_members)] = _class
K = len(_CLASSES)
#: Word lengths in bytes from which a new bin begins.
_LENGTHS = np.array([2, 3, 4, 5, 6, 8, 10, 13, 17, 25, 50])
#: Bytes, pairs of classes, classes of first and last bytes of words, word lengths; then repeats and length.
_PARTS = (256, K * K, K * K, len(_LENGTHS) + 1)
SIZE = sum(_PARTS) + 4


def features(texts: pa.Array, powers: Powers | None = None) -> np.ndarray:
    """A row of ``SIZE`` numbers for each whole text: square roots of shares, which tell rare things apart, and logarithms.

    Null, empty and wordless texts have zeros.
    """
    powers = powers or Powers()
    n = len(texts)
    counts = np.zeros((n, sum(_PARTS)))
    cuts = np.cumsum((0, *_PARTS))
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for data, borders, rows in text_blocks(texts, BLOCK):
        sizes = np.diff(borders)
        owner = np.repeat(np.arange(len(rows)), sizes)
        kind = _CLASS[data].astype(np.int64)
        inner = owner[1:] == owner[:-1]
        starts, ends = word_spans(data, borders)
        word_owner = np.searchsorted(borders, starts, side="right") - 1
        found = (
            owner * 256 + data,
            (owner[1:] * K * K + kind[:-1] * K + kind[1:])[inner],
            word_owner * K * K + kind[starts] * K + kind[ends - 1],
            word_owner * _PARTS[3] + np.searchsorted(_LENGTHS, ends - starts, side="right"),
        )
        for k, (at, width) in enumerate(zip(found, _PARTS, strict=True)):
            counts[rows, cuts[k] : cuts[k + 1]] += np.bincount(at, minlength=len(rows) * width).reshape(len(rows), width)
        held.append((rows[word_owner], span_hashes(data, starts, ends, powers)))
    out = np.zeros((n, SIZE))
    for k in range(len(_PARTS)):
        part = counts[:, cuts[k] : cuts[k + 1]]
        out[:, cuts[k] : cuts[k + 1]] = np.sqrt(part / np.maximum(part.sum(1, keepdims=True), 1))
    out[:, cuts[-1] :] = _repeats(held, n)
    return out


def _repeats(held: list, n: int) -> np.ndarray:
    """Logarithm of the words, share of distinct words, of the commonest word, and of words that equal the word before."""
    out = np.zeros((n, 4))
    if not held:
        return out
    owner, words = (np.concatenate(x) for x in zip(*held, strict=True))
    total = np.bincount(owner, minlength=n)
    again = np.bincount(owner[1:][(owner[1:] == owner[:-1]) & (words[1:] == words[:-1])], minlength=n)
    order = np.lexsort((words, owner))
    owner, words = owner[order], words[order]
    new = np.r_[True, (owner[1:] != owner[:-1]) | (words[1:] != words[:-1])] if len(owner) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    most = np.zeros(n)
    np.maximum.at(most, owner[at], np.diff(np.r_[at, len(owner)]))
    some = np.maximum(total, 1)
    out[:] = np.stack([np.log1p(total), np.bincount(owner[at], minlength=n) / some, np.sqrt(most / some), np.sqrt(again / some)], 1)
    return out


class Model:
    """weights of standardised features folded into weights of plain ones, and the score where good begins."""

    def __init__(self, weights: np.ndarray, threshold: float):
        self.weights, self.threshold = weights, float(threshold)


class Chances:
    """What all pairs of two score histograms say: the loss, each score's chance to be on the wrong side, and the curvature.

    Scores are counted in bins of ``WIDTH``, numbered from ``first`` on. The curvature takes bins together, ``SPANS`` at most,
    and weighs all pairs of two such spans alike, so that it is that of a sum of squares whatever the spans are.
    """

    def __init__(self, first: int, good: np.ndarray, bad: np.ndarray):
        n = len(good)
        self.first, self.goods, self.bads = first, good.sum(), bad.sum()
        apart = WIDTH * np.arange(1 - n, n)
        beats = 1 / (1 + np.exp(-np.clip(apart, -500, 500)))
        over = lambda counts, kernel: np.convolve(counts, kernel)[n - 1 : 2 * n - 1]
        #: For each bin the share of bad rows that a good row there loses to, and of good rows that a bad row there beats.
        self.wrong = np.stack([over(good, beats) / self.goods, 1 - over(bad, beats) / self.bads])
        self.loss = float(good @ over(bad, np.logaddexp(0, -apart))) / self.goods / self.bads
        self.span = max(int(0.25 / WIDTH), -(-n // SPANS))
        starts = np.arange(0, n, self.span)
        counts = np.stack([np.add.reduceat(bad, starts), np.add.reduceat(good, starts)])
        gap = WIDTH * self.span * (np.arange(len(starts))[:, None] - np.arange(len(starts)))
        p = 1 / (1 + np.exp(-np.clip(gap, -500, 500)))
        self.curve = p * (1 - p)
        self.bends = np.stack([self.curve @ counts[1] / self.goods, self.curve @ counts[0] / self.bads])

    def sums(self, x: np.ndarray, bins: np.ndarray, good: np.ndarray) -> np.ndarray:
        """Of a block of rows: squares by curvature, sums of each span of bad and of good rows, and the slope, one below the other."""
        bins = bins - self.first
        at, kind = bins // self.span, good.astype(np.int64)
        share = np.where(good, 1 / self.goods, 1 / self.bads)
        spans = np.zeros((2 * len(self.curve), x.shape[1]))
        np.add.at(spans, kind * len(self.curve) + at, x * share[:, None])
        slope = (np.where(good, -1, 1) * share * self.wrong[kind, bins]) @ x
        return np.vstack([(x * (share * self.bends[kind, at])[:, None]).T @ x, spans, slope])

    def slope_and_curve(self, summed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d, k = summed.shape[1], len(self.curve)
        mixed = summed[d + k : d + 2 * k].T @ self.curve @ summed[d : d + k]
        return summed[-1], summed[:d] - mixed - mixed.T


def fit(moments: np.ndarray, histogram: Callable, total: Callable, ridge: float = RIDGE) -> np.ndarray:
    """Weights that minimise the mean logistic loss of score differences over all pairs of a good and a bad row, by Newton's method.

    moments: count, sums and sums of squares of all rows. histogram(center, weights) gives the first bin and the counts of
    good and bad rows' scores, total(center, weights, chances) the rows' sums of ``Chances.sums``.
    """
    n, center = moments[0, 0], moments[1] / moments[0, 0]
    scale = np.maximum(np.sqrt(np.maximum(moments[2] / n - center**2, 0)), 1e-3)
    weights = np.zeros(len(center))
    now = Chances(*histogram(center, weights))
    loss = now.loss
    for _ in range(ROUNDS):
        slope, curve = now.slope_and_curve(total(center, weights / scale, now))
        slope, curve = slope / scale + ridge * weights, curve / np.outer(scale, scale)
        curve[np.diag_indices_from(curve)] += ridge
        step = np.linalg.solve(curve, slope)
        size, new = 1.0, np.inf
        while size > 1e-3 and not new <= loss:  # halve the step while it leads up
            tried = weights - size * step
            chances = Chances(*histogram(center, tried / scale))
            new = chances.loss + ridge / 2 * tried @ tried
            size /= 2
        if not new < loss:
            break
        better, weights, loss, now = loss - new, tried, new, chances
        if better < ENOUGH:
            break
    return weights / scale


def _bins(x: np.ndarray, center: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The bins of the rows' scores; row by row sums, so that a row has the same bin wherever it stands."""
    return np.floor(((x - center) * weights).sum(1) / WIDTH).astype(np.int64)


def _moments(x: np.ndarray) -> np.ndarray:
    return np.stack([np.full(x.shape[1], float(len(x))), x.sum(0), (x * x).sum(0)])


def _counts(bins: np.ndarray, good: np.ndarray, n: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    first = int(bins.min())
    width = int(bins.max()) - first + 1
    one = lambda of: np.bincount(bins[of] - first, n[of], width)
    return first, one(good), one(~good)


def fit_pairs(winners: np.ndarray, losers: np.ndarray, ridge: float = RIDGE) -> np.ndarray:
    """``fit`` of rows in memory."""
    x, good = np.concatenate([winners, losers]), np.arange(len(winners) + len(losers)) < len(winners)
    histogram = lambda center, weights: _counts(_bins(x, center, weights), good, np.ones(len(x)))
    return fit(_moments(x), histogram, lambda center, weights, chances: chances.sums(x - center, _bins(x, center, weights), good), ridge)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for b in slices(batches):
        x = np.frombuffer(b"".join(b.column("features").to_pylist()), np.float32).reshape(-1, SIZE).astype(np.float64)
        yield x, b.column("quality").to_numpy() == 1


def fit_rows(rows: DataFrame) -> np.ndarray | None:
    """``fit`` of a written table of features and quality (0 or 1), all rows of it; None unless both occur.

    Each round tasks count their rows' scores and add up their rows' sums; Spark adds the tasks' sums, each of their fixed
    number of rows by itself and in the order of the tasks, and the driver holds one sum.
    """

    def summed(work: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
        def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            total = 0
            for x, good in _blocks(batches):
                total = total + work(x, good)
            if np.ndim(total):
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(np.full(len(total), TaskContext.get().partitionId(), np.int32)), pa.array([r.tobytes() for r in total], pa.binary())], names=["slot", "task", "sums"])

        def add(table: pa.Table) -> pa.Table:
            total = np.zeros(SIZE)
            for r in table.sort_by("task").column("sums").to_pylist():
                total += np.frombuffer(r, np.float64)
            return pa.table({"slot": table.column("slot")[:1], "sums": pa.array([total.tobytes()], pa.binary())})

        found = rows.mapInArrow(parts, "slot int, task int, sums binary").groupBy("slot").applyInArrow(add, "slot int, sums binary").toArrow().sort_by("slot")  # some 600 rows
        return np.array([np.frombuffer(r, np.float64) for r in found.column("sums").to_pylist()])

    def histogram(center: np.ndarray, weights: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for x, good in _blocks(batches):
                (bins, kinds), n = np.unique(np.stack([_bins(x, center, weights), good]), axis=1, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(bins), pa.array(kinds == 1), pa.array(n)], names=["bin", "good", "n"])

        found = rows.mapInArrow(count, "bin long, good boolean, n long").groupBy("bin", "good").agg(F.sum("n").alias("n")).toArrow()  # 128 bins a unit of score
        return _counts(found.column("bin").to_numpy(), found.column("good").to_numpy(), found.column("n").to_numpy().astype(np.float64))

    if {r.quality for r in rows.select("quality").distinct().collect()} != {0, 1}:
        return None
    return fit(summed(lambda x, good: _moments(x)), histogram, lambda center, weights, chances: summed(lambda x, good: chances.sums(x - center, _bins(x, center, weights), good)))


def quantile(scores: np.ndarray, weights: np.ndarray, share: float) -> float:
    """The score below which ``share`` of the weight lies, halfway between the two scores that border it."""
    order = np.argsort(scores)
    below = np.cumsum(weights[order])
    at = int(np.searchsorted(below, share * below[-1] - 1e-9 * below[-1]))
    return float((scores[order][at] + scores[order][min(at + 1, len(order) - 1)]) / 2)


def with_features(docs: DataFrame, out: str = "features") -> DataFrame:
    """Add the features of the whole text as 32-bit floats in a binary column."""

    @F.arrow_udf("binary")
    def measured(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        powers = Powers()
        for texts in batches:
            yield pa.array([row.tobytes() for lo in range(0, len(texts), 1000) for row in features(texts[lo : lo + 1000], powers).astype(np.float32)], pa.binary())

    return docs.withColumn(out, measured.asNondeterministic()(F.col("text")))


def train(docs: DataFrame, labels: DataFrame) -> Model | None:
    """Learn from all labels of ``quality`` (0 or 1; a document with several labels takes the higher); None unless both occur.

    The features of every labelled document are written once (2 kB each); rounds read them, and so do the scores whose order
    gives the threshold.
    """
    marks = labels.filter("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    if marks.select("quality").distinct().count() < 2:
        return None
    # Labels grow with the documents, so they aren't broadcast at any size.
    rows = docs.filter("text is not null").select("doc_id", "text").join(marks.hint("merge"), "doc_id")
    # A document that is there more than once counts once.
    found = with_features(rows).groupBy("doc_id", "quality").agg(F.min("features").alias("features"))
    found = materialize(found.select("doc_id", F.col("quality").cast("int").alias("quality"), "features").sortWithinPartitions("doc_id"), "ranking-features")
    weights = fit_rows(found)
    if weights is None:
        return None

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, _ in _blocks(batches):
            yield pa.RecordBatch.from_arrays([pa.array((x * weights).sum(1))], names=["score"])

    bad = found.filter("quality = 0").count()
    # Copies have equal scores; any order of theirs parts them between tasks.
    scores = found.mapInArrow(score, "score double").withColumn("tie", F.monotonically_increasing_id())
    placed = in_order(scores, ["score", "tie"], "ranking-order")
    border = [r.score for r in placed.filter(F.col("place").isin(bad - 1, bad)).select("score").collect()]  # two rows
    return Model(weights, quantile(np.array(border), np.ones(2), 0.5))


def with_quality(docs: DataFrame, model: Model | None, out: str = "quality_score") -> DataFrame:
    """Add a double: the chance that the whole text beats one at the threshold. 0.5 without a model; null texts count as empty.

    Other columns stay; repeated rows get the same answer.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        powers, m = Powers(), shared.value
        for texts in batches:
            if m is None:
                yield pa.array(np.full(len(texts), THRESHOLD))
                continue
            # Row by row sums, not a matrix product, whose last bits depend on a row's place in its batch.
            margin = np.concatenate([(features(texts[lo : lo + 1000], powers) * m.weights).sum(1) for lo in range(0, len(texts), 1000)] or [np.zeros(0)]) - m.threshold
            yield pa.array(1 / (1 + np.exp(-np.clip(margin, -500, 500))))

    return docs.withColumn(out, score.asNondeterministic()(F.col("text")))


def quality_ranking_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row; labels of held-out rows are never read."""
    model = train(docs, labels.filter(~fold(F.col("doc_id"), 3, 1)))
    rows = docs.select("doc_id", fold(F.col("doc_id"), 3, 1).alias("held_out"), "text")
    return with_quality(rows, model, "score").select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
