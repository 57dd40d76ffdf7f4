"""Resampling, quality ranking and infilling against brute force, with nulls, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.llm.test_operators import DOCS, LOWER, documents, sample_texts
from trailwork.llm import infilling, ranking, resampling

ODD = [None, "", " \t\n", "one", "É-x;ÄÖ9", "a-b,c d" * 3000, "😀a😀 \x00", "<P>", "a<S>b", "<M", "<<S" * 9, "x" * 70_000]

# resampling

RUN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_features(text):
    ws = RUN.findall((text or "").translate(LOWER))
    return len(ws), [" ".join(ws[i : i + n]) for n in (1, 2, 3) for i in range(len(ws) - n + 1)]


def brute_resampling(docs, target, percent=5, least=20):
    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(map(bucket, brute_features(text)[1]))
    for text in target:
        t.update(map(bucket, brute_features(text)[1]))
    s_all, t_all = s.total(), t.total()
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s_all + 10000) / ((s[b] + 1) * (t_all + 10000)))) for b in range(10000)]
    rows = []
    for doc_id, text in docs:
        n, found = brute_features(text)
        h = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(f)] for f in found)
        rows.append([doc_id, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    fit = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for place, r in enumerate(fit[: percent * len(fit) // 100], 1):
        r[4] = place
    return sorted((tuple(r[:5]) for r in rows), key=str)


def test_xxhash_checksum_and_table_of_spans():
    rng = random.Random(3)
    data = np.frombuffer(bytes(rng.randrange(3) for _ in range(2000)), np.uint8)
    starts = np.array([rng.randrange(1000) for _ in range(3000)])
    spans = resampling.Spans(data, starts, starts + np.array([rng.choice([0, 1, 2, 3, 7, 8, 9, 31, 32, 33, 63, 64, 65, 255, 256, 257, 700]) for _ in range(3000)]))
    raw = [spans.bytes_of(i) for i in range(3000)]
    assert spans.hashes().tolist() == [xxhash.xxh64_intdigest(x) for x in raw]
    assert spans.checksums(np.arange(3000)).tolist() == [zlib.crc32(x) for x in raw]
    # Even where all hashes collide, spans share a slot only if their bytes are equal.
    for hashes in (spans.hashes(), np.zeros(3000, np.uint64)):
        slots, owner = resampling.intern(spans, hashes)
        assert [raw[i] for i in owner[slots]] == raw and len(set(slots.tolist())) == len(set(raw))


@pytest.mark.parametrize("size", [64, 1 << 18])
def test_features_of_long_texts_are_whole(size):
    texts = [*ODD, *sample_texts(4, 20)]
    total, words = np.zeros(len(texts), int), np.zeros(len(texts), int)
    buckets = Counter()
    for block in resampling.interned(pa.array(texts), size):
        total += np.bincount(block.rows, minlength=len(texts))
        words += block.words
        for b, n in zip(block.bucket[block.count > 0].tolist(), block.count[block.count > 0].tolist(), strict=True):
            buckets[b] += n
    brute = [brute_features(x) for x in texts]
    assert words.tolist() == [n for n, _ in brute] and total.tolist() == [len(f) for _, f in brute]
    assert buckets == Counter(zlib.crc32(f.encode()) % 10000 for _, found in brute for f in found)


def test_resampling_equals_brute_force(spark):
    texts = [*ODD, *sample_texts(5, 400, vocabulary=300, length=120)]
    rows = [*enumerate(texts), *[(7_000 + i, "w1 w2 w3 " * 10) for i in range(5)], *[(13, texts[13])] * 3, (None, "w4 w5 " * 20), (None, None)]
    target = [None, "", *sample_texts(6, 30, vocabulary=40)]
    docs = spark.createDataFrame([(i, x, None, None, None) for i, x in rows], DOCS)
    got = [tuple(r) for r in resampling.importance_report(docs, spark.createDataFrame([(x,) for x in target], "text string")).collect()]
    assert sorted(got, key=str) == brute_resampling(rows, target)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, "a b c")]])
def test_resampling_of_little(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    empty = spark.createDataFrame([], "text string")
    assert sorted((tuple(r) for r in resampling.importance_report(docs, empty).collect()), key=str) == brute_resampling(rows, [])


def test_resampled_rows_keep_their_columns(spark):
    docs = documents(spark, sample_texts(7, 200, vocabulary=200, length=90)).selectExpr("*", "doc_id + 1 as rank", "'x' as row", "'y' as score", "3 as __id", "4 as place", "5 as __part", "6 as importance_")
    drawn = resampling.resample(docs, spark.createDataFrame([("w1 w2 w3",)], "text string"), percent=20).collect()
    wanted = {r[0]: r[4] for r in brute_resampling([(r.doc_id, r.text) for r in docs.collect()], ["w1 w2 w3"], 20) if r[4]}
    assert {r.doc_id: r["rank"] for r in drawn} == wanted
    assert all((r.row, r.score, r.__getitem__("__id"), r.place) == ("x", "y", 3, 4) for r in drawn)


# ranking


def forms(seed, n, bad):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("aeinorst") for _ in range(rng.randrange(2, 9)))
    return [" ".join(word() + (rng.choice(["$$", "##", "||"]) if bad and rng.random() < 0.5 else "") for _ in range(rng.randrange(10, 200))) + "." for _ in range(n)]


def test_ranking_held_out_and_odd_texts(spark):
    texts = [*forms(1, 150, False), *forms(2, 50, True), *ODD]
    docs = documents(spark, [*texts]).unionByName(documents(spark, texts[:40]))
    labels = spark.createDataFrame([*[(i, int(i < 150), 0) for i in range(200)], (0, None, 0), (None, 1, 0), (3, 1, 1)], "doc_id long, quality int, toxic int")
    rows = ranking.quality_ranking_report(docs, labels).collect()
    assert len(rows) == len(texts) + 40
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id < 200]
    assert np.mean([r.predicted == int(r.doc_id < 150) for r in held]) > 0.95
    assert len({(r.doc_id, r.score) for r in rows}) == len(texts)  # repeated rows get the same answer


def test_ranking_reads_no_held_out_label(spark):
    texts = [*forms(1, 60, False), *forms(2, 60, True)]
    docs = documents(spark, texts)
    marks = [(i, int(i < 60), 0) for i in range(120)]
    turned = [(i, 1 - q if zlib.crc32(str(i).encode()) % 3 == 1 else q, t) for i, q, t in marks]
    score = lambda m: sorted(tuple(r) for r in ranking.quality_ranking_report(docs, spark.createDataFrame(m, "doc_id long, quality int, toxic int")).collect())
    assert score(marks) == score(turned)


@pytest.mark.parametrize("marks", [[], [(1, 1, 0)], [(0, None, None), (None, 0, 0)]])
def test_ranking_without_both_labels(spark, marks):
    docs = documents(spark, ["a b", None, ""])
    rows = ranking.quality_ranking_report(docs, spark.createDataFrame(marks, "doc_id long, quality int, toxic int")).collect()
    assert [(r.score, r.predicted) for r in rows] == [(0.5, 1)] * 3
    assert ranking.quality_ranking_report(docs.limit(0), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")).collect() == []


def test_features_of_long_texts_are_whole_too(monkeypatch):
    texts = pa.array([*ODD, "Ab, cd!\n" * 500])
    whole = ranking.features(texts)
    assert whole.shape == (len(ODD) + 1, ranking.SIZE) and not whole[[0, 1]].any()
    monkeypatch.setattr(ranking, "BLOCK", 1 << 10)
    cut = ranking.features(texts)
    # Only pairs of classes across the cuts differ.
    assert np.abs(whole - cut).max() < 0.05 and (whole[:, -4:] == cut[:, -4:]).all()


def test_pairs_fit_and_quantile():
    rng = np.random.default_rng(0)
    better, worse = rng.normal(1, 1, (300, 3)) * [1, 0, 1], rng.normal(0, 1, (200, 3)) * [1, 0, 1]
    w = ranking.fit_pairs(better, worse, ridge=1e-6)
    difference = (better[:, None] - worse[None]).reshape(-1, 3)
    slope = (difference / (1 + np.exp(difference @ w))[:, None]).mean(0)
    assert np.abs(slope).max() < 0.02 and abs(w[1]) < 1e-6 and w[0] > 0.5  # near the optimum over all pairs
    assert ranking.quantile(np.array([4.0, 1, 2, 3]), np.ones(4), 0.5) == 2.5
    assert ranking.quantile(np.array([0.0, 1, 2]), np.array([1.0, 2, 1]), 0.25) == 0.5
    assert ranking.quantile(np.array([5.0]), np.ones(1), 0.3) == 5.0


def test_ranking_keeps_columns(spark):
    docs = documents(spark, forms(1, 40, False) + forms(2, 40, True)).selectExpr("*", "1 as features", "2 as quality", "3 as draw")
    model = ranking.train(docs, spark.createDataFrame([(i, int(i < 40), 0) for i in range(80)], "doc_id long, quality int, toxic int"))
    scored = ranking.with_quality(docs, model, "quality_score")
    assert scored.columns == [*docs.columns, "quality_score"]
    assert {(r.features, r.quality, r.draw) for r in scored.collect()} == {(1, 2, 3)}


def test_ranking_learns_from_every_labelled_row(spark, monkeypatch):
    n = 4300  # more of each label than the sample of 4,000 that once was drawn
    texts = [f"good{i % 7} text {i}." if i % 2 else f"## bad{i % 5} $$ {i}" for i in range(2 * n)]
    docs = documents(spark, texts).unionByName(documents(spark, texts[:50]))
    marks = spark.createDataFrame([(i, i % 2, 0) for i in range(2 * n)], "doc_id long, quality int, toxic int")
    seen = []
    fit_rows = ranking.fit_rows
    monkeypatch.setattr(ranking, "fit_rows", lambda rows: seen.append(rows.count()) or fit_rows(rows))
    model = ranking.train(docs, marks)
    assert seen == [2 * n] and ((ranking.features(pa.array(texts)) @ model.weights > model.threshold) == np.arange(2 * n) % 2).all()


def test_ranking_fits_all_pairs_in_tasks(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(0, 1, (700, ranking.SIZE)).astype(np.float32)
    good = x[:, 0] + rng.normal(0, 1, 700) > 0.5
    rows = spark.createDataFrame([(r.tobytes(), int(g)) for r, g in zip(x, good, strict=True)], "features binary, quality int").repartition(5)
    weights = ranking.fit_rows(rows)
    assert np.allclose(weights, ranking.fit_pairs(x[good].astype(float), x[~good].astype(float)), atol=1e-6)
    gap = (x[good] @ weights)[:, None] - (x[~good] @ weights)[None]
    wrong = 1 / (1 + np.exp(gap))
    scale = x.astype(float).std(0)
    slope = (wrong.mean(0) @ x[~good] / (~good).sum() - wrong.mean(1) @ x[good] / good.sum()) / scale + ranking.RIDGE * weights * scale
    assert np.abs(slope).max() < 2e-3  # over all pairs, one by one


# infilling

UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]")


def brute_infilling(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, len(units), "plain", None, None, text
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 20:
        return doc_id, len(units), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return doc_id, len(units), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def test_infilling_equals_brute_force(spark):
    texts = [*ODD, *sample_texts(8, 200), *[x.replace(" ", "<") for x in sample_texts(9, 60)]]
    rows = [*enumerate(texts), *list(enumerate(texts))[:30], (None, "ab cd"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    made = infilling.with_infilling(docs).select("doc_id", "infilling.*")
    assert sorted((tuple(r) for r in made.collect()), key=str) == sorted((brute_infilling(*r) for r in rows), key=str)
    back = made.select("doc_id", infilling.restored(F.col("output"), F.col("form")).alias("text"))
    assert sorted((tuple(r) for r in back.collect()), key=str) == sorted(((i, x or "") for i, x in rows), key=str)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert sorted((tuple(r) for r in infilling.infilling_report(docs).collect()), key=str) == sorted(((*b[:5], sha(b[5]), sha(x or "")) for b, (_, x) in ((brute_infilling(*r), r) for r in rows)), key=str)


def test_infilling_edges(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert infilling.infilling_report(docs).collect() == []
    clash = documents(spark, ["a b c"] * 4).selectExpr("*", "1 as n", "2 as output", "'z' as form")
    made = infilling.with_infilling(clash)
    assert made.columns == [*clash.columns, "infilling"] and {(r.n, r.output, r.form) for r in made.collect()} == {(1, 2, "z")}
    plain = infilling.with_infilling(clash, transformed=0).select("infilling.form").distinct().collect()
    turned = infilling.with_infilling(clash, transformed=100, suffix_first=100).select("infilling.form").distinct().collect()
    assert [r.form for r in plain] == ["plain"] and [r.form for r in turned] == ["spm"]


def test_rank_index_is_exact_and_small():
    rng = np.random.default_rng(1)
    for steps in ([1], [1, 5], [1, 1, 1, 2, 9, 100, 1000, 100_000], [0, 3]):
        offsets = np.cumsum(rng.choice(steps, 5000))
        index = infilling.RankIndex()
        for part in np.array_split(offsets, 3):
            index.extend(part)
        index.close()
        assert (index.offsets(np.arange(5000)) == offsets).all() and index.residuals.dtype == np.int8
        if max(steps) < 10:
            assert len(index.firsts) <= 6


@pytest.mark.parametrize("size", [1, 7, 1 << 20])
def test_units_do_not_depend_on_the_pieces_read(size):
    texts = ["ab1é😀c", "", "abc", "def g", "", "é"]
    data = "".join(texts).encode()
    borders = np.cumsum([0, *[len(x.encode()) for x in texts]])
    index, before = infilling.unit_index(np.frombuffer(data, np.uint8), borders, size)
    assert np.diff(before).tolist() == [len(UNIT.findall(x)) for x in texts]
    ends = [len("".join(texts[:i]).encode()) + len("".join(UNIT.findall(x)[:k]).encode()) for i, x in enumerate(texts) for k in range(len(UNIT.findall(x)))]
    assert index.offsets(np.arange(index.n)).tolist() == [*ends, len(data)]
