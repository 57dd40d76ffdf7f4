"""Corpus operators against brute force on small fixtures, with nulls, ties, repeated rows, empty tables and clashing columns."""

import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from trailwork.llm import chat, common, components, decontamination, hmm, jaccard, language, mixing, quality, sharding, tokens, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [None, "", " \t\n", "one", "two Words", "É x ÄÖ", "a\nb\na\n", "w " * 3000]


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def documents(spark, texts, langs=None, sources=None):
    n = len(texts)
    rows = [(i, x, (langs or [None] * n)[i], (sources or [None] * n)[i], None) for i, x in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def sample_texts(seed, n, vocabulary=40, length=60):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(vocabulary)]
    return [" ".join(rng.choice(vocab) for _ in range(rng.randrange(1, length))) for _ in range(n)]


# quality


def brute_quality(text):
    ws = [w for w in WORD.findall(text or "")]
    grams = Counter(tuple(ws[i : i + 8]) for i in range(len(ws) - 7))
    inside = {i + k for i in range(len(ws) - 7) if grams[tuple(ws[i : i + 8])] > 1 for k in range(8)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(inside)


def test_quality_counts(spark):
    texts = [*ODD, *sample_texts(1, 30), "a b c d e f g h i " * 5, "x # $\nx # $\ny é"]
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality.quality_report(documents(spark, texts)).collect()}
    assert got == {i: brute_quality(x) for i, x in enumerate(texts)}


def test_quality_verdict_and_columns(spark):
    good = " ".join(f"word{i}" for i in range(100))
    docs = documents(spark, [good, good[:50], "a b c d e f g h " * 20, None]).selectExpr("*", "1 as kept", "2 as repetition")
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and [r.doc_id for r in kept.collect()] == [0]
    assert quality.quality_report(docs.limit(0)).count() == 0


# sharding


def test_shards(spark):
    texts = [*ODD, *sample_texts(2, 200), *["same text"] * 50]
    rows = sharding.shard_by_bytes(documents(spark, texts)).collect()
    assert len(rows) == len(texts)
    size = Counter()
    slots = defaultdict(list)
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        assert r.size == len(raw) + 1 and r.law == "bytes" and r.grown_shard is None
        assert r.text_crc32 == (None if texts[r.doc_id] is None else zlib.crc32(raw))
        size[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    largest = max(len((x or "").encode()) + 1 for x in texts)
    assert all(abs(size[k] - sum(size.values()) / 8) <= largest + sum(size.values()) / 8 * 0.01 for k in range(8))


def test_shards_of_nothing(spark):
    assert sharding.shard_by_bytes(documents(spark, ["x"]).limit(0)).count() == 0
    assert sharding.shard_by_bytes(documents(spark, ["x"]).limit(0), keep=True).count() == 0


def test_written_shards_hold_every_row(spark, tmp_path):
    rows = [(i, f"text {i % 40} " * (i % 7), "en", None, None) for i in range(300)] + [(7, "again", None, "a", 1)] * 90 + [(None, None, None, None, None)] * 3 + [(8, "", None, None, None)]
    docs = spark.createDataFrame(rows, DOCS).selectExpr("*", "5 as slot", "6 as part", "7 as row", "8 as before")
    sharding.write_shards(docs, str(tmp_path / "out"), 4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert {"text", "lang", "source", "n_chars", "part", "row", "before", "shard", "slot"} <= set(back.columns)
    got = back.collect()
    assert Counter((r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in got) == Counter(rows)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert sorted(slots) == [0, 1, 2, 3] and all(sorted(v) == list(range(len(v))) for v in slots.values())
    narrow = {(r.shard, r.slot): (r.doc_id, r.text_crc32) for r in sharding.shard_by_bytes(docs, 4).collect()}
    assert {(r.shard, r.slot): (r.doc_id, r.text_crc32) for r in got} == narrow


def test_equal_crc_of_different_texts(spark):
    # Both have crc32 0x4ddb0c25.
    pair = ["plumless", "buckeroo"]
    rows = sharding.shard_by_bytes(documents(spark, pair * 20), 3).collect()
    assert len({r.text_crc32 for r in rows}) == 1 and sorted(Counter(r.shard for r in rows).values()) == [13, 13, 14]


# mixing


@pytest.mark.parametrize("left", [200_000, 20])
def test_fit_reaches_what_brute_force_reaches(monkeypatch, left):
    monkeypatch.setattr(mixing, "MOST_LEFT", left)
    rng = random.Random(left)
    for _ in range(300):
        counts = {rng.randrange(0, 60): rng.randrange(0, 4) for _ in range(5)}
        budget = rng.randrange(1, sum(k * n for k, n in counts.items()) + 5)
        best = max(s for s in (sum(k * j for k, j in zip(counts, pick, strict=True)) for pick in itertools.product(*(range(n + 1) for n in counts.values()))) if s <= budget)
        taken = mixing.fit(budget, counts)
        assert all(0 <= taken[k] <= counts[k] for k in counts) and sum(k * j for k, j in taken.items()) == best
    assert mixing.fit(12, {7: 4, 6: 2}) == {7: 0, 6: 2}


@pytest.mark.parametrize(
    ("budget", "counts", "best"),
    [
        (500_000, {449_999: 1, 450_000: 1, 450_001: 1}, 450_001),
        (500_001, {300_000: 1, 250_000: 1, 250_001: 1}, 500_001),
        (460_000, {300_000: 4, 450_000: 1}, 450_000),
        (9_000_001, {2_999_999: 1, 3_000_000: 2, 3_000_001: 1, 4_000_000: 3}, 9_000_001),
        (7_000_001, {2_000_000: 4, 1_000_000: 2}, 7_000_000),
        (10, {40: 2}, 0),
    ],
)
def test_fit_of_long_texts_only(budget, counts, best):
    taken = mixing.fit(budget, counts)
    assert all(0 <= taken[k] <= counts[k] for k in counts) and sum(k * j for k, j in taken.items()) == best


def brute_targets(sizes, weights):
    target, capped = [0.0] * len(sizes), set()
    while True:
        free = [i for i in range(len(sizes)) if i not in capped]
        left = 1.5 * sum(sizes) - sum(2 * sizes[i] for i in capped)
        for i in free:
            target[i] = left * weights[i] / sum(weights[j] for j in free)
        over = [i for i in free if target[i] > 2 * sizes[i]]
        if not over:
            return target
        for i in over:
            target[i] = 2.0 * sizes[i]
        capped.update(over)


def test_water_fill(spark):
    rng = random.Random(4)
    for sizes in ([10, 10, 10], [0, 10], [0, 0], [1, 2, 3, 500, 40, 9, 0, 77], [rng.randrange(1000) ** 2 for _ in range(40)]):
        weights = [mixing.WEIGHTS[i % 3] for i in range(len(sizes))]
        rows = spark.createDataFrame(list(enumerate(sizes)), "i long, size long").withColumn("weight", F.get(F.array(*map(F.lit, mixing.WEIGHTS)), (F.col("i") % 3).cast("int")))
        got = [r.target for r in mixing.water_fill(rows).orderBy("i").collect()]
        assert got == pytest.approx(brute_targets(sizes, weights))


def test_mix(spark):
    texts = [None, "", *sample_texts(3, 120)]
    sources = [random.Random(i).choice(["a", "b", None]) for i in range(len(texts))]
    docs = documents(spark, texts, sources=sources)
    rows = mixing.mix_report(docs).collect()
    assert len(rows) == len(texts) and all(r.size == len(WORD.findall(texts[r.doc_id] or "")) for r in rows)
    assert all(r.taken in (0, r.size, 2 * r.size) for r in rows)
    by_source = defaultdict(list)
    for r in rows:
        by_source[sources[r.doc_id]].append(r)
    assert round(sum(v[0].target for v in by_source.values()), 6) == round(1.5 * sum(r.size for r in rows), 6)
    for v in by_source.values():
        assert v[0].source_size == sum(r.size for r in v) and abs(sum(r.taken for r in v) - v[0].target) <= 2
    assert sorted(rows) == sorted(mixing.mix_report(docs.repartition(5)).collect())


def test_mixed_rows_follow_the_plan(spark):
    docs = documents(spark, [*sample_texts(4, 40), "same words here", "same words here"], sources=["a"] * 42).selectExpr("*", "7 as size", "8 as rank")
    plan = Counter()
    for r in mixing.mix_plan(docs).collect():
        plan[r.doc_id] += r.copies
    out = mixing.mixed(docs)
    assert out.columns == docs.columns and Counter(r.doc_id for r in out.collect()) == Counter({k: n for k, n in plan.items() if n})
    assert mixing.mixed(docs.limit(0)).count() == 0 and mixing.mix_report(docs.limit(0)).count() == 0


def test_mix_of_equal_rows_and_empty_sources(spark):
    rows = [(None, "same words in all of these", None, None, None)] * 60 + [(i, " ".join(["w"] * (i % 9 + 1)), None, "b", None) for i in range(50)] + [(i, None, None, "none", None) for i in range(5)]
    docs = spark.createDataFrame(rows, DOCS).repartition(7)
    plan = Counter()
    for r in mixing.mix_plan(docs).collect():
        plan[r.doc_id, r.source] += r.copies
    out = mixing.mixed(docs).collect()
    assert Counter((r.doc_id, r.source) for r in out) == Counter({k: n for k, n in plan.items() if n}) and 0 < plan[None, None] < 120
    assert {r.target for r in mixing.mix_report(docs.filter("source = 'none'")).collect()} == {0.0}


# Jaccard join


def brute_components(texts, n, percent):
    sets = []
    for t in texts:
        w = words(t)
        sets.append(frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset())
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(range(len(texts)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in enumerate(sets)}


@pytest.mark.parametrize(("n", "percent", "block"), [(3, 90, 4096), (3, 90, 4), (5, 80, 3)])
def test_jaccard_equals_brute_force(spark, monkeypatch, n, percent, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rng = random.Random(n)
    texts = [*ODD, "ONE", "two words"]
    for base in sample_texts(5, 12, vocabulary=300, length=200):
        w = base.split()
        for _ in range(8):
            copy = list(w)
            for _ in range(rng.randrange(0, 3)):
                copy[rng.randrange(len(copy))] = rng.choice(["zz", "yy", "xx"])
            texts.append(" ".join(copy))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_classes(documents(spark, texts), n, percent).collect()}
    assert got == brute_components(texts, n, percent)


@pytest.mark.parametrize(("n", "percent", "block"), [(3, 90, 1024), (3, 90, 4), (5, 80, 3)])
def test_jaccard_counts_every_link(spark, monkeypatch, n, percent, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "COUNT_BLOCK", block)
    rng = random.Random(n)
    texts = [*ODD, "two words", "two words"]
    for base in sample_texts(6, 5, vocabulary=300, length=150):
        w = base.split()
        for _ in range(14):
            copy = w[: rng.randrange(130, 151)]
            for _ in range(rng.randrange(0, 4)):
                copy[rng.randrange(len(copy))] = rng.choice(["zz", "yy", "xx"])
            texts.append(" ".join(copy))
    sets = [frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if (w := words(t)) else frozenset() for t in texts]
    want = {i: sum(100 * len(s & o) >= percent * len(s | o) for o in set(sets) - {s} if s and o) for i, s in enumerate(sets)}
    got = {r.doc_id: r.class_links for r in jaccard.jaccard_classes(documents(spark, texts), n, percent).collect()}
    assert got == want and max(want.values()) > 6


def test_bounds_never_lose_a_link():
    rng = np.random.default_rng(1)
    for _ in range(200):
        a = np.unique(rng.integers(0, 1 << 63, rng.integers(1, 3000), np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.97], rng.integers(0, 1 << 63, rng.integers(0, 50), np.uint64)]))
        if not len(b):
            continue
        both = len(np.intersect1d(a, b))
        if both >= jaccard.needed(len(a), len(b), 90):
            assert jaccard.may_reach(jaccard.wide_bitmap_of(a), jaccard.wide_bitmap_of(b), len(a), len(b), 90)
        assert len(jaccard.unpack(jaccard.pack(a))) == len(a)


def test_packed_arrays_lose_nothing():
    rng = np.random.default_rng(2)
    for n in [*range(0, 80), 255, 256, 257, 3000]:
        grams = np.unique(rng.integers(0, (1 << 64) - 1, n, np.uint64, endpoint=True))
        assert jaccard.unpack(jaccard.pack(grams)).tolist() == grams.tolist()
    for grams in (np.arange(300, dtype=np.uint64), np.uint64((1 << 64) - 1) - np.arange(300, dtype=np.uint64)[::-1]):
        assert jaccard.unpack(jaccard.pack(grams)).tolist() == grams.tolist()
    assert len(jaccard.pack(np.unique(rng.integers(0, 1 << 63, 1000, np.uint64)))) < 7.25 * 1000


def test_gram_sets_do_not_depend_on_neighbours():
    texts = [b"a b c d", None, b"", b" a\tB c ", b"x", b"a b c d"]
    together = jaccard.gram_sets(pa.array(texts, pa.binary()), 3, jaccard.Powers())
    alone = [jaccard.gram_sets(pa.array([t], pa.binary()), 3, jaccard.Powers())[0] for t in texts]
    assert all((x == y).all() and len(x) == len(y) for x, y in zip(together, alone, strict=True))
    assert [len(x) for x in together] == [2, 0, 0, 1, 1, 2] and set(together[3]) < set(together[0])


def test_repeated_and_null_ids(spark):
    rows = [(1, "a b c d e", None, None, None)] * 2 + [(None, "a b c d e", None, None, None), (None, "q r s t u", None, None, None), (5, None, None, None, None)]
    docs = spark.createDataFrame(rows, DOCS)
    got = [(r.doc_id, r.component_id) for r in jaccard.jaccard_classes(docs).collect()]
    assert sorted(got, key=str) == sorted([(1, 1), (1, 1), (None, 1), (None, None), (5, 5)], key=str)
    kept = jaccard.keep_one_each(docs.selectExpr("*", "1 as n", "2 as class_key"))
    assert sorted((str(r.doc_id) for r in kept.collect())) == ["1", "5", "None", "None"]
    assert jaccard.jaccard_classes(docs.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(7)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 340)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    root = {x: x for link in links for x in link}
    for _ in range(len(root)):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert got == {x: r for x, r in root.items() if x in linked}


# decontamination


def brute_contaminated(texts, items, percent=80):
    split = lambda t: [w for w in re.split(r"[^\w]+|_", (t or "").lower()) if w]
    grams = lambda w: Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))
    found = {}
    for d, t in enumerate(texts):
        w = split(t)
        for k, item in enumerate(items):
            it = split(item)
            if not w or not it or (len(it) < 5 and len(w) != len(it)):
                continue
            gi = grams(it)
            for s in range(max(1, len(w) - len(it) + 1)):
                g = grams(w[s : s + len(it)])
                both, every = sum((g & gi).values()), sum((g | gi).values())
                if 100 * both >= percent * every:
                    found[d, k] = max(found.get((d, k), 0), both / every)
    return found


def test_decontamination_equals_brute_force(spark):
    items = [*sample_texts(8, 15, vocabulary=500, length=50), None, "", "short item", "the same the same the same the same the same the same"]
    texts = [*ODD]
    rng = random.Random(2)
    for k, item in enumerate(items):
        if item:
            w = item.split()
            texts += [item, f"before. {item.upper()}! after", " ".join(["x", *w[: len(w) - 1], "y"]), " ".join(w[1:])]
            edited = list(w)
            edited[rng.randrange(len(w))] = "zz"
            texts.append("pre " + " ".join(edited) + " post")
    texts += sample_texts(9, 20, vocabulary=500)
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    rows = decontamination.contaminated(documents(spark, texts), benchmark).collect()
    got = {(r.doc_id, r.item_id): round(r.similarity, 9) for r in rows}
    assert got == {k: round(v, 9) for k, v in brute_contaminated(texts, items).items()}
    clean = decontamination.decontaminated(documents(spark, texts), benchmark)
    assert {r.doc_id for r in clean.collect()} == set(range(len(texts))) - {d for d, _ in got}
    assert decontamination.contaminated(documents(spark, texts), benchmark.limit(0)).count() == 0
    assert decontamination.contaminated(documents(spark, texts).limit(0), benchmark).count() == 0


def test_repetitive_items_are_all_found(spark):
    texts, items = [], []
    for k in range(2000):
        a, b = f"a{k}", f"b{k}"
        words_ = [(a, b)[i % 2] for i in range(15)]
        items.append(" ".join(words_))
        texts.append(" ".join(["changed", *words_[1:]]))
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    rows = decontamination.contaminated(documents(spark, texts), benchmark).collect()
    assert sorted((r.doc_id, r.item_id) for r in rows) == [(k, k) for k in range(2000)]
    assert {round(r.similarity, 9) for r in rows} == {round(10 / 12, 9)}


def test_decontamination_without_broadcast_and_of_odd_rows(spark, monkeypatch):
    rng = random.Random(5)
    vocabulary = [f"v{i}" for i in range(400)]
    items = [" ".join(rng.choice(vocabulary) for _ in range(20)) for _ in range(6)]
    hit, clean = f"before {items[0]} after", " ".join(rng.choice(vocabulary) for _ in range(60))
    rows = [(1, hit), (1, hit), (1, items[1]), (None, hit), (2, clean), (None, None), (3, f"{clean} {items[2]} " * 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as key", "2 as __id", "3 as w", "4 as start")
    benchmark = spark.createDataFrame([*enumerate(items), (None, clean), (9, None)], "item_id long, text string")
    want = [(1, 0, 1), (1, 1, 1), (3, 2, 3)]
    for most in (decontamination.MOST_BROADCAST, 0):
        monkeypatch.setattr(decontamination, "MOST_BROADCAST", most)
        exact = [(r.doc_id, r.item_id, r.windows) for r in decontamination.contaminated(docs, benchmark, percent=100).collect()]
        assert sorted(exact) == want
        kept = decontamination.decontaminated(docs, benchmark)
        assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["2", "None"]


# language model


def brute_forward(sequence, start, move, emit):
    total = 0.0
    for path in itertools.product(range(len(start)), repeat=len(sequence)):
        p = start[path[0]] * emit[sequence[0], path[0]]
        for t in range(1, len(sequence)):
            p *= move[path[t - 1], path[t]] * emit[sequence[t], path[t]]
        total += p
    return math.log(total)


def test_forward_and_expected_counts():
    rng = np.random.default_rng(0)
    start, move, emit = rng.dirichlet([1] * 3), rng.dirichlet([1] * 3, 3), rng.dirichlet([1] * 5, 3).T
    sequences = [rng.integers(0, 5, n).astype(np.uint16) for n in (1, 4, 2, 6)]
    got = hmm.log_likelihood(sequences, start, move, emit)
    assert np.allclose(got, [brute_forward(s, start, move, emit) for s in sequences])
    before = got.sum()
    for _ in range(5):
        starts, moves, emissions = hmm.expected_counts(sequences, start, move, emit)
        assert np.isclose(emissions.sum(), 13) and np.isclose(moves.sum(), 9) and np.isclose(starts.sum(), 4)
        start, move, emit = starts / starts.sum(), moves / moves.sum(1, keepdims=True), emissions / emissions.sum(0)
        now = hmm.log_likelihood(sequences, start, move, emit).sum()
        assert now >= before - 1e-9
        before = now


def test_language_model_base(spark):
    texts = [*ODD, *sample_texts(11, 60)]
    rows = hmm.language_model_report(documents(spark, texts)).collect()
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in range(len(texts))}
    counts = Counter(w for i, t in enumerate(texts) if not held[i] for w in [*words(t), "\n"])
    n, v = sum(counts.values()), len(counts)
    assert len(rows) == len(texts)
    for r in rows:
        w = [*words(texts[r.doc_id]), "\n"]
        base = sum(math.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(w), sum(counts[x] > 0 for x in w), n)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and math.isfinite(r.score) and r.score < 0


def test_language_model_beats_base_on_two_kinds_of_text(spark):
    rng = random.Random(1)
    texts = [" ".join(rng.choice("abcdefgh" if i % 2 else "mnopqrst") for _ in range(60)) for i in range(200)]
    rows = [r for r in hmm.language_model_report(documents(spark, texts)).collect() if r.held_out]
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows) + 0.2 * sum(r.n_tokens for r in rows)


def test_language_model_of_nothing(spark):
    docs = documents(spark, ["x y"])
    assert hmm.language_model_report(docs.limit(0)).count() == 0


# language identification


def test_automaton_parses_like_substring_search():
    rng = random.Random(3)
    samples = {k: "".join(rng.choice(a + " ") for _ in range(300)) for k, a in (("x", "abc"), ("y", "bcd"))}
    samples = {k: language.clean(v) for k, v in samples.items()}
    model = language.Model(samples)

    def brute(text, sample):
        n, phrase = 1, ""
        for c in text:
            if phrase + c in sample:
                phrase += c
            else:
                n += 1
                phrase = c if c in sample else ""
        return n

    texts = [language.clean("".join(rng.choice("abcd ") for _ in range(rng.randrange(1, 80)))) for _ in range(40)]
    texts = [t for t in texts if t]
    got = model.phrases([model.encode(t) for t in texts])
    assert got.tolist() == [[brute(t, samples[k]) for k in ("x", "y")] for t in texts]


def test_every_letter_of_the_samples_counts():
    # 62 frequent letters of one language; the others' letters are all rarer.
    rng = random.Random(8)
    sets = {"aa": [chr(0x4E00 + i) for i in range(62)], "bb": [chr(0x430 + i) for i in range(30)], "cc": [chr(0x3B1 + i) for i in range(17)], "dd": [chr(0xAC00 + i) for i in range(500)]}
    text = {k: [" ".join("".join(rng.choices(v, k=5)) for _ in range(400 if k == "aa" else 100)) for _ in range(2)] for k, v in sets.items()}
    model = language.Model({k: v[0] for k, v in text.items()})
    counts = model.phrases([model.encode(v[1]) for v in text.values()])
    assert [model.languages[i] for i in counts.argmin(1)] == list(sets)
    assert model.phrases([model.encode(text["dd"][0])])[0][3] < 5


def test_samples_are_not_cut_to_the_head(spark):
    rows = [(i, "1 " * 2_000 + s) for i, s in enumerate(["der hund und die katze", "the dog and the cat"])]
    docs = spark.createDataFrame([(i, t, "de" if i == 0 else "en") for i, t in rows], "doc_id long, text string, lang string")
    assert language.train(docs).languages == ["de", "en"]


def test_language(spark):
    rng = random.Random(5)
    make = lambda alphabet: " ".join("".join(rng.choice(alphabet) for _ in range(5)) for _ in range(40))
    texts = [make("abcdefgh") if i % 2 else make("efghijkl") for i in range(60)] + [None, "", "123 !?", "abab"]
    langs = ["aa" if i % 2 else "bb" for i in range(60)] + [None, "aa", None, None]
    rows = {r.doc_id: r for r in language.language_report(documents(spark, texts, langs)).collect()}
    assert [rows[i].lang_pred for i in (60, 61, 62)] == ["und"] * 3 and all(0 <= r.score <= 1 for r in rows.values())
    held = [i for i in range(60) if rows[i].held_out]
    assert held and all(rows[i].lang_pred == langs[i] for i in held)
    assert language.language_report(documents(spark, texts, [None] * 64)).select("lang_pred").distinct().collect()[0][0] == "und"


def test_long_texts_are_parsed_as_a_whole(monkeypatch):
    rng = random.Random(9)
    sample = "".join(rng.choice("abc ") for _ in range(400))
    model = language.Model({"x": language.clean(sample), "y": "ab" * 300, "z": "abc"})
    made = ["".join(rng.choice("abc ") for _ in range(3_000)), sample * 12, "ab" * 2_000, "a" * 1_500 + "b" * 1_500, "abd" * 700, "ab", "d"]
    texts = [model.encode(language.clean(t)) for t in made]
    monkeypatch.setattr(language, "PIECE", 1 << 20)
    whole = model.phrases(texts)
    for piece in (1, 7, 64, 1_000):
        monkeypatch.setattr(language, "PIECE", piece)
        assert (model.phrases(texts) == whole).all(), piece


def test_a_very_long_text_equals_an_unbroken_parse(monkeypatch):
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8))) for _ in range(300)]
    make = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    model = language.Model({"x": make(3_000), "y": make(200)})
    codes = model.encode(make(40_000)[:200_000])
    pieces = model.phrases([codes])
    monkeypatch.setattr(language, "PIECE", 1 << 20)
    assert (pieces == model.phrases([codes])).all()


def test_a_hundred_languages(spark, monkeypatch):
    rng = random.Random(6)
    words_of = {f"l{k:03}": ["".join(rng.choice("abcdefghijklmnop") for _ in range(5)) for _ in range(30)] for k in range(100)}
    text = lambda k: " ".join(rng.choice(words_of[k]) for _ in range(40))
    rows = [(i, text(k), k) for i, k in enumerate(sorted(words_of) * 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language.language_report(docs).collect()
    learned = {rows[r.doc_id][2] for r in got if not r.held_out}
    assert len(learned) > 90 and np.mean([r.lang_pred == rows[r.doc_id][2] for r in got if rows[r.doc_id][2] in learned]) > 0.95
    # Tables of fewer columns give the same counts.
    samples = {k: text(k) for k in list(words_of)[:20]}
    wide = language.Model(samples)
    monkeypatch.setattr(language, "ENTRIES", 0)
    narrow = language.Model(samples)
    texts = [text(k) for k in list(words_of)[:25]]
    assert narrow.width == 2 < wide.width
    assert (wide.phrases([wide.encode(t) for t in texts]) == narrow.phrases([narrow.encode(t) for t in texts])).all() and np.allclose(wide.own, narrow.own)


def test_uneven_samples_are_normalised():
    rng = random.Random(2)
    words_ = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 8))) for _ in range(600)]
    first, second = words_[:400], words_[:200] + words_[400:]
    make = lambda vocabulary, n: " ".join(rng.choice(vocabulary) for _ in range(n))
    model = language.Model({"a": make(first, 6000)[:24_000], "b": make(second, 600)[:1_500]})
    for k, vocabulary in enumerate((first, second)):
        relative = model.phrases([model.encode(make(vocabulary, 80)) for _ in range(100)]) / model.own
        assert (relative.argmin(1) == k).mean() >= 0.85


# token counts


@pytest.mark.parametrize("rule", tokens.RULES)
def test_attribution_against_brute_force(rule):
    rng = np.random.default_rng(4)
    for _ in range(50):
        lengths = rng.integers(1, 6, rng.integers(1, 20))
        size = int(lengths.sum())
        starts = np.unique(np.r_[0, rng.integers(0, size, 4)])
        got, crossing = tokens.attribute(lengths, starts, size, rule)
        want, cross = np.zeros(len(starts), int), np.zeros(len(starts), int)
        at = 0
        for n in lengths:
            owners = [int(np.searchsorted(starts, b, side="right")) - 1 for b in range(at, at + n)]
            share = Counter(owners)
            own = owners[0] if rule == "first" else owners[-1] if rule == "last" else max(share, key=lambda o: (share[o], -o))
            want[own] += 1
            cross[own] += len(share) > 1
            at += n
        assert got.tolist() == want.tolist() and crossing.tolist() == cross.tolist()


def test_section_tokens_add_up(spark):
    import tiktoken

    texts = ["one\n\n two three\nüé\n", None, "", "x", "\n\n\n", "é" * 50, "a b " * 500]
    rows = tokens.section_tokens(documents(spark, texts)).collect()
    ranks = tokens.read_ranks(open(tokens.VOCABULARY).read())
    coder = tiktoken.Encoding("t", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={})
    by_doc = defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
    assert set(by_doc) == {i for i, t in enumerate(texts) if t}
    for i, parts in by_doc.items():
        parts.sort(key=lambda r: r.section)
        assert sum(r.n_tokens for r in parts) == len(coder.encode_ordinary(texts[i]))
        assert "".join(texts[i][r.start_char : r.end_char] for r in parts) == texts[i]


# chat


def brute_cost(roles):
    legal = {0: (0, 1), 1: (1,), 2: (2,), 3: (1,)}
    best = {0: 0}
    for role in [*roles, None]:
        edge = dict(best)
        for _ in range(3):  # empty turns, never a system turn
            for s, c in list(edge.items()):
                for r in legal[s]:
                    if r and edge.get(r + 1, 1 << 30) > c + chat.INSERT:
                        edge[r + 1] = c + chat.INSERT
        if role is None:
            return edge[3]
        now = {}
        for given in range(3):
            change = 0 if given == role else chat.NAME if role < 0 else chat.RELABEL
            for s, c in edge.items():
                if given in legal[s]:
                    now[given + 1] = min(now.get(given + 1, 1 << 30), c + change)
            if given + 1 in best:
                now[given + 1] = min(now.get(given + 1, 1 << 30), best[given + 1] + chat.MERGE + change)
        best = now


def enumerated_cost(roles):
    """Least cost over all repairs with at most two turns put in at a place, by trying every one of them."""
    puts = [p for k in range(3) for p in itertools.product((1, 2), repeat=k)]
    best = 1 << 30
    steps = [[(put, given, merge) for put in puts for given in range(3) for merge in (False, True) if not (merge and put)] for _ in roles]
    for plan in itertools.product(*steps):
        out, cost = [], 0
        for role, (put, given, merge) in zip(roles, plan, strict=True):
            cost += chat.INSERT * len(put) + (0 if given == role else chat.NAME if role < 0 else chat.RELABEL)
            out += put
            if merge and (not out or out[-1] != given):
                cost = 1 << 30
                break
            cost += chat.MERGE * merge
            out += [] if merge else [given]
        for put in puts if cost < best else ():
            if cost + chat.INSERT * len(put) < best and re.fullmatch("0?(12)+", "".join(map(str, [*out, *put]))):
                best = cost + chat.INSERT * len(put)
    return best


def test_repair_costs_equal_enumeration():
    for n in (1, 2):
        for roles in itertools.product((-1, 0, 1, 2), repeat=n):
            assert brute_cost(roles) == enumerated_cost(roles)
    for roles in ((2, 2, 1), (0, 0, -1), (1, 0, 1), (-1, 2, 2)):
        assert brute_cost(roles) == enumerated_cost(roles)


def whole(rows):
    """conv_id -> (turns, cost, out, text) of conversations from their parts."""
    found = defaultdict(list)
    for r in sorted(rows, key=lambda r: r.part):
        found[r.conv_id].append(r)
    assert all([r.part for r in v] == list(range(v[0].parts)) and len({r.cost for r in v}) == 1 for v in found.values())
    return {k: (sum(r.n_turns for r in v), v[0].cost, sum(r.n_out for r in v), "".join(r.rendered for r in v)) for k, v in found.items()}


@pytest.mark.parametrize("block", [4096, 3])
def test_chat_repair(spark, monkeypatch, block):
    monkeypatch.setattr(chat, "BLOCK", block)
    rng = random.Random(6)
    convs = [[rng.choice(["system", "user", "assistant", "User", "tool", None]) for _ in range(rng.randrange(1, 9))] for _ in range(40)]
    convs.append([rng.choice(["system", "user", "assistant", None]) for _ in range(700)])  # over several partitions
    rows = [(c, t, role, rng.choice([f"t{t}", None, ""])) for c, roles in enumerate(convs) for t, role in enumerate(roles)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as part", "2 as block", "3 as nth").repartition(5)
    got = whole(chat.rendered(df).collect())
    code = {"system": 0, "user": 1, "assistant": 2}
    for c, roles in enumerate(convs):
        n_turns, cost, n_out, text = got[c]
        assert cost == brute_cost([code.get((x or "").lower(), -1) for x in roles]) and n_turns == len(roles)
        turns = re.findall(r"<\|(system|user|assistant)\|>\n", text)
        assert re.fullmatch(r"(system )?(user assistant )+", "".join(x + " " for x in turns)) and len(turns) == n_out
        assert [int(x) for x in re.findall(r"\bt(\d+)\b", text)] == [t for k, t, _, x in rows if k == c and x]
    acts = chat.repaired_turns(df).collect()
    paid = Counter()
    for r in acts:
        paid[r.conv_id] += chat.INSERT * (r.act == "insert") + chat.MERGE * ("merge" in r.act)
    assert all(paid[c] <= got[c][1] for c in paid)


def test_chat_odd_rows(spark):
    schema = "conv_id long, turn long, role string, text string"
    rows = [(None, None, "user", "a"), (1, 0, "user", "b"), (1, 0, "user", "b")]
    got = {r.conv_id: r for r in chat.rendered(spark.createDataFrame(rows, schema)).collect()}
    assert got[1].rendered == "<|user|>\nb\nb<|end|>\n<|assistant|>\n<|end|>\n" and got[None].n_inserted == 1
    assert chat.rendered(spark.createDataFrame([], schema)).count() == 0
    many = spark.range(5000).selectExpr("cast(null as long) as conv_id", "id as turn", "if(id % 2 = 0, 'user', 'assistant') as role", "cast(id as string) as text").repartition(9)
    assert whole(chat.rendered(many).collect())[None][:3] == (5000, 0, 5000)


# toxicity


def test_toxicity_catches_unseen_misspellings(spark):
    rng = random.Random(8)
    plain = [f"word{i}" for i in range(200)]
    bad = ["grumble", "snarlish", "blorgon"]
    misspelt = ["grumbble", "snarlissh", "bloorgon"]

    def text(i, toxic):
        w = [rng.choice(plain) for _ in range(30)]
        if toxic:
            for _ in range(4):
                w[rng.randrange(30)] = rng.choice(misspelt if i >= 400 else bad)
        return " ".join(w)

    texts = [text(i, i % 4 == 0) for i in range(500)] + [None, "", "\n"]
    docs = documents(spark, texts)
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(400)], "doc_id long, quality int, toxic int")
    rows = {r.doc_id: r for r in toxicity.toxicity_report(docs, labels).collect()}
    assert len(rows) == len(texts) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows.values())
    new = range(400, 500)
    caught = np.mean([rows[i].predicted for i in new if i % 4 == 0])
    wrong = np.mean([rows[i].predicted for i in new if i % 4])
    assert caught >= 0.8 and wrong <= 0.1
    assert toxicity.toxicity_report(docs, labels.limit(0)).filter("score != 0.5").count() == 0


@pytest.mark.parametrize("size", [1, 7, 64, 1 << 20])
def test_blocks_hold_every_word(size):
    texts = [None, "", " \n", "a bb  ccc", "é" * 50, "x" * 500 + " y", *sample_texts(3, 12), "w " * 300]
    found = defaultdict(list)
    for data, borders, rows in common.text_blocks(pa.array(texts), size):
        starts, ends = common.word_spans(data, borders)
        for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
            found[int(rows[np.searchsorted(borders, a, side="right") - 1])].append(data[a:b].tobytes().decode())
    assert {i: found[i] for i in found} == {i: w for i, t in enumerate(texts) if (w := WORD.findall(t or ""))}


def test_subwords_and_gains_equal_one_word_at_a_time():
    rng = random.Random(4)
    vocabulary = ["a", "ab", "grumble", "é", "x" * 3000, *["".join(rng.choice("abcé") for _ in range(rng.randrange(1, 12))) for _ in range(100)]]
    ids, owner = toxicity.subwords(vocabulary)
    for i, w in enumerate(vocabulary):
        alone, _ = toxicity.subwords([w])
        assert sorted(ids[owner == i]) == sorted(alone) and len(alone) == 1 + sum(max(0, len(w) + 3 - n) for n in (3, 4, 5))
    gain = np.random.default_rng(1).normal(size=toxicity.BUCKETS)
    gains, hashes = toxicity.Gains(gain), np.arange(len(vocabulary), dtype=np.uint64) % 60
    for _ in range(2):  # the second time from what is kept
        got = gains.of(hashes, lambda i: vocabulary[i % 60])
        assert np.allclose(got, [(gain[toxicity.subwords([vocabulary[i % 60]])[0]].sum(), len(toxicity.subwords([vocabulary[i % 60]])[0])) for i in range(len(vocabulary))])


def test_empty_tables_of_the_classifiers(spark):
    docs = documents(spark, ["der hund", "the dog"], ["de", "en"])
    labels = spark.createDataFrame([(0, 1, 1), (1, 1, 0), (0, 1, 1)], "doc_id long, quality int, toxic int")
    assert language.language_report(docs.limit(0)).count() == 0 and toxicity.toxicity_report(docs.limit(0), labels).count() == 0
    twice = toxicity.toxicity_report(docs.unionByName(docs), labels).collect()
    assert len(twice) == 4 and len({(r.doc_id, r.score) for r in twice}) == 2
