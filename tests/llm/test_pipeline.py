"""The pipeline by stages, the queries next to their SQL, and the entry."""

import os

import pytest

import corpus_pipeline
from gradewright.llm.queries import ORACLES, QUERIES
from gradewright.session import cut_lineage
from tests import oracle
from tests.llm.cases import hard_documents, no_documents, plain

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    assert oracle.compare(spark, oracle.connect(SF), SF, QUERIES[name], ORACLES.get(name)) is None


def test_every_operator_has_a_query():
    import __spark_entry__ as entry

    assert {q.split("_")[0] for q in QUERIES} == {f"op{n}" for n in range(1, 14)}
    assert {*QUERIES, "pipeline"} <= set(entry.queries())
    assert set(ORACLES) <= set(entry.oracle_sql())


def test_stages_on_the_smallest_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, left = docs.columns, docs.count()
    for name, function in corpus_pipeline.STAGES[:-1]:
        docs = cut_lineage(function(spark, docs, SF))
        assert docs.columns == columns and 0 < docs.count() <= left
        left = docs.count()
    packed = cut_lineage(corpus_pipeline.STAGES[-1][1](spark, docs, SF))
    assert {r["doc_id"] for r in packed.select("doc_id").collect()} == {r["doc_id"] for r in docs.select("doc_id").collect()}
    assert plain(packed, "doc_id", "start", "length", "ids_crc32") == plain(
        corpus_pipeline.run(spark, SF), "doc_id", "start", "length", "ids_crc32")


@pytest.mark.parametrize("k", range(len(corpus_pipeline.STAGES)))
def test_each_stage_bears_hard_rows(spark, k):
    name, function = corpus_pipeline.STAGES[k]
    docs = hard_documents(spark)
    made = function(spark, docs, SF)
    if name != "packing":
        assert made.columns == docs.columns
    assert 0 < made.count()
    assert function(spark, no_documents(spark), SF).count() == 0
