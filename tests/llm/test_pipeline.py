"""The pipeline's stages on the operators' fixture."""

import corpus_pipeline
from test_llm_operators import DOCS, rows

from riskweave.session import stage


def test_stages_keep_columns_and_take_effect(spark):
    docs = spark.createDataFrame(rows(), DOCS).repartition(3)
    columns = docs.columns
    for name, function in corpus_pipeline.STAGES[:-1]:
        docs = stage(function(spark, docs, ""), "test-stage")
        assert docs.columns == columns, name
    ids = {r["doc_id"] for r in docs.collect()}
    assert 4 not in ids and 8 not in ids and len({0, 1, 2} & ids) <= 1
    assert not docs.where("text LIKE '%4111 1111%'").count()
    last = corpus_pipeline.STAGES[-1][1](spark, docs, "")
    assert last.count() == docs.count() and "ids_sha256" in last.columns


def test_empty_table(spark):
    docs = spark.createDataFrame([], DOCS)
    for _, function in corpus_pipeline.STAGES:
        docs = stage(function(spark, docs, ""), "test-stage")
        assert docs.count() == 0
