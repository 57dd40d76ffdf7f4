"""Edges of the corpus operators and of the pipeline: nulls, repeated rows, empty tables, long texts, clashing names."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.test_operators import DOCS, ODD, documents, sample_texts, words
from trailwork.llm import decontamination, hmm, jaccard, language, quality, sharding, tokens, toxicity

CLASH = ("__key", "__id", "key", "own_id", "item", "n", "bucket", "label", "place", "__part", "__ahead", "row", "repetition", "counted")


def clashing(docs):
    return docs.selectExpr("*", *[f"{i} as `{c}`" for i, c in enumerate(CLASH)])


def test_filters_keep_any_column(spark):
    good = [" ".join(f"w{k}x{i}" for i in range(60)) for k in range(3)]
    docs = clashing(documents(spark, [*good, good[0], None, ""]))
    benchmark = spark.createDataFrame([(1, good[1])], "item_id long, text string")
    clean = decontamination.decontaminated(docs, benchmark)
    assert clean.columns == docs.columns and sorted(r.doc_id for r in clean.collect()) == [0, 2, 3, 4, 5]
    once = jaccard.keep_one_each(docs)
    assert once.columns == docs.columns and sorted(r.doc_id for r in once.collect()) == [0, 1, 2, 4, 5]
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [0, 1, 2, 3]
    assert {tuple(r[c] for c in CLASH) for df in (clean, once, kept) for r in df.collect()} == {tuple(range(len(CLASH)))}


def test_buckets_of_items_lose_nothing(spark, monkeypatch):
    rng = random.Random(3)
    common = [f"c{i}" for i in range(12)]
    items = [" ".join([*common, *[rng.choice("abcdefgh") + str(k) for _ in range(10)]]) for k in range(40)]
    texts = [f"before it {x} after" for x in items] + [" ".join([*common, *[f"u{i}" for i in range(30)]])]
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    found = []
    for n in (1, 64, 1000):
        monkeypatch.setattr(decontamination, "BUCKETS", n)
        found.append(sorted((r.doc_id, r.item_id, round(r.similarity, 9), r.start_word, r.windows) for r in decontamination.contaminated(documents(spark, texts), benchmark).collect()))
    assert found[0] == found[1] == found[2] and [(d, i) for d, i, *_ in found[0]] == [(k, k) for k in range(40)]


def brute_links(texts, n=3, percent=90):
    sets = [frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if (w := words(t)) else frozenset() for t in texts]
    different = {s for s in sets if s}
    return [len({o for o in different if o != s and 100 * len(s & o) >= percent * len(s | o)}) if s else 0 for s in sets]


def test_class_links_equal_brute_force(spark):
    rng = random.Random(11)
    texts = []
    for base in sample_texts(12, 6, vocabulary=400, length=160):
        w = (base + " " + base[::-1]).split()
        for _ in range(8):
            edited = list(w)
            edited[rng.randrange(len(w))] = f"z{rng.randrange(9)}"
            texts += [" ".join(edited)] * rng.randrange(1, 3)
    texts += [None, "", "a b", "a b", "A  b"]
    rows = jaccard.jaccard_classes(documents(spark, texts)).collect()
    assert {r.doc_id: r.class_links for r in rows} == dict(enumerate(brute_links(texts)))
    assert max(r.class_links for r in rows) > 2


def test_language_model_of_repeated_rows_and_extra_columns(spark):
    docs = documents(spark, ["a b a", "a b a", None, "", "x " * 500])
    docs = docs.unionByName(docs).selectExpr("*", "1 as row", "2 as word", "3 as sequence", "4 as token")
    rows = hmm.language_model_report(docs).collect()
    assert len(rows) == 10 and len({(r.doc_id, r.n_tokens, round(r.score, 9), round(r.base_score, 9)) for r in rows}) == 5
    assert {r.n_tokens for r in rows if r.doc_id in (2, 3)} == {1}


def test_languages_of_ties_repeated_rows_and_null_texts(spark):
    docs = documents(spark, ["der hund und die katze"] * 4 + ["the dog and the cat"] * 4 + [None, "", "123", "qqq"], ["de"] * 4 + ["en"] * 4 + [None] * 4)
    rows = language.language_report(docs.unionByName(docs).selectExpr("*", "1 as language")).collect()
    assert len(rows) == 24 and len({tuple(r) for r in rows}) == 12
    assert {r.lang_pred for r in rows if r.doc_id in (8, 9, 10)} == {"und"}
    # Both languages need as many phrases for letters that neither has: the first in order wins.
    assert {r.lang_pred for r in rows if r.doc_id == 11} == {"de"}


def test_tokens_of_empty_tables_repeated_rows_and_unbroken_words(spark):
    docs = documents(spark, ["one two", None, "", "x" * 20_000])
    assert tokens.section_tokens(docs.limit(0)).count() == 0
    once, twice = tokens.section_tokens(docs).collect(), tokens.section_tokens(docs.unionByName(docs)).collect()
    assert sorted(map(str, twice)) == sorted(map(str, once * 2))


def test_shards_of_rows_without_text_and_id(spark):
    docs = spark.createDataFrame([(None, None)] * 400 + [(i, "ab") for i in range(10)], "doc_id long, text string")
    rows = sharding.shard_by_bytes(docs, shards=8).collect()
    assert len(rows) == 410
    for shard in {r.shard for r in rows}:
        slots = sorted(r.slot for r in rows if r.shard == shard)
        assert slots == list(range(len(slots)))


def test_toxicity_keeps_columns_and_learns_from_long_texts(spark):
    texts = ["plain words here " * 3, "grumble grumble here", "grumble " * 30_000, "plain " * 30_000]
    docs = clashing(documents(spark, texts * 10))
    labels = spark.createDataFrame([(i, 1, int("grumble" in (texts * 10)[i])) for i in range(40)], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, labels)
    scored = toxicity.with_toxicity(docs, model)
    assert scored.columns == [*docs.columns, "toxicity"]
    rows = scored.collect()
    assert {tuple(r[c] for c in CLASH) for r in rows} == {tuple(range(len(CLASH)))}
    assert min(r.toxicity for r in rows if "grumble" in r.text) > max(r.toxicity for r in rows if "grumble" not in r.text)
    # A bound that holds one bag only: nothing is skipped for its length.
    assert toxicity.train(docs, labels, most_entries=1 << 17) is not None
    bag = toxicity.with_bag(documents(spark, ["", None, "ab"])).collect()
    assert [len(r.bag) for r in bag][:2] == [0, 0] and len(np.frombuffer(bag[2].bag, np.uint16)) % 2 == 0


@pytest.mark.parametrize("rows", [[], [(None, None, None, None, None)] * 3, [(1, "", None, None, 0), (2, "few words", "en", "a", 9)]])
def test_pipeline_of_little(spark, tmp_path, rows):
    import corpus_pipeline

    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []  # the quality rules reject all of these


def test_pipeline_of_odd_rows_and_clashing_columns(spark, tmp_path):
    import corpus_pipeline

    good = [" ".join(f"w{k}x{i}" for i in range(60)) for k in range(12)]
    rows = [(i, t, None if i % 3 else "en", None if i % 4 == 0 else f"s{i % 4}", None) for i, t in enumerate([*good, good[0], *ODD])]
    rows += [(None, " ".join(f"n{i}" for i in range(40)), None, None, None)]
    docs = clashing(spark.createDataFrame(rows, DOCS))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, good[3]), (None, good[4])], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    got = out.collect()
    assert set(docs.columns) <= set(out.columns)
    assert {r.doc_id for r in got} <= {None, *range(12)} - {3} and len({r.doc_id for r in got}) >= 8
    assert {tuple(r[c] for c in CLASH) for r in got} == {tuple(range(len(CLASH)))}
    assert all(r.text == dict((i, t) for i, t, *_ in rows)[r.doc_id] for r in got)
    assert out.groupBy("shard", "slot").count().filter(F.col("count") > 1).count() == 0
