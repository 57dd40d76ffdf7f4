"""The corpus queries that SQL can express, against DuckDB."""

import os

import pytest

from tests.oracle import connect, differences
from trailwork.llm import queries

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    assert differences(spark, connect(FOLDER), queries.queries()[name], queries.oracle_sql()[name], FOLDER) == []


def test_pipeline(spark):
    import corpus_pipeline

    documents = spark.read.parquet(f"{FOLDER}/documents.parquet")
    docs = documents
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, FOLDER)
        assert docs.columns == documents.columns
    rows = corpus_pipeline.run(spark, FOLDER).collect()
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in docs.select("doc_id").collect())
    assert {r.shard for r in rows} == set(range(8))
