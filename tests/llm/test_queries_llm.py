"""Queries with SQL against it; the registry; the pipeline's stages on small data."""

import pytest
from compare import compare, connection

import corpus_pipeline
from concord.llm.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def database(folder):
    return connection(folder)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(name, spark, folder, database):
    assert compare(QUERIES[name](spark, folder), database, ORACLES[name]) is None


def test_every_operator_is_registered():
    import __spark_entry__

    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(__spark_entry__.queries())


def test_stages_keep_columns_and_work_in_order(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, number = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stored(stage(spark, docs, folder), name)
        assert docs.columns == columns
        assert docs.select("doc_id").distinct().count() == docs.count() <= number
        number = docs.count()
    assert number > 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in docs.collect()}
    ran = {(r.doc_id, r.start, r.ids_crc32) for r in corpus_pipeline.run(spark, folder).collect()}
    assert ran == {(r.doc_id, r.start, r.ids_crc32) for r in packed.collect()}


@pytest.mark.parametrize("stage", range(5))
def test_stages_take_odd_rows(spark, folder, stage):
    rows = [(1, None, None, None, None), (1, None, None, None, None), (2, "", "en", None, 0), (None, "some words " * 80, "en", "s", 880), (3, "one", "en", "s", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for given in (docs, docs.limit(0)):
        out = corpus_pipeline.STAGES[stage][1](spark, given, folder)
        assert out.count() <= 6
        assert stage == 4 or out.columns == docs.columns
