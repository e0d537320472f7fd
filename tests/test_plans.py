"""Shapes of the physical plans that matter at scale."""

import os
import re

import pytest
from pyspark.sql import functions as F

from gradewright.functions import text as tx
from gradewright.operators import curate, guard, keywords, sample
from gradewright.plans import grading
from gradewright.session import cut_lineage, settle
from tests.oracle import plan

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def inference(docs):
    return docs.select(
        F.col("doc_id").alias("image_id"), F.col("source").alias("image_path"), F.col("text").alias("prediction"), F.col("text").alias("ground_truth")
    )


def test_grading_does_not_shuffle(inference):
    for made in (grading.grade_by_keywords(inference), grading.grade_with_answers(inference)):
        assert "Exchange" not in plan(made)


def test_a_filter_on_the_verdict_does_not_repeat_the_text_work(inference):
    passed = grading.grade_by_keywords(inference).where("quality_verdict = 'PASS'").groupBy("priority_level").count()
    text = plan(passed)
    assert text.count("regexp_replace(prediction") == 1
    assert text.count("[^ \\t\\n\\x0B\\f\\r]*+") == 1


def test_unused_columns_are_not_read(docs):
    text = plan(guard.calibrated_guard(docs, "text").groupBy("reason_code").count())
    assert re.findall(r"ReadSchema: (.*)", text) == ["struct<text:string>"]


def test_filters_reach_the_scan(docs):
    assert "EqualTo(lang,en)" in plan(curate.equal_if_present(docs, "lang", "en"))
    turns = docs.sparkSession.read.parquet(f"{SF}/conversations.parquet").where("role = 'assistant'")
    assert "EqualTo(role,assistant)" in plan(turns.select(tx.token_count("text")))


def test_funnel_is_one_scan_and_one_aggregate(docs):
    _, counts = curate.funnel(docs, "source", "text")
    text = plan(counts)
    assert len(re.findall(r"^.*Scan parquet +\(", text, re.M)) == 1
    assert text.count("Exchange (") == 1


def test_words_are_searched_once(docs):
    words = {"thon": "a", "than": "b"}
    text = plan(keywords.frequency(docs, "text", words))
    assert text.count("Contains(text#") == len(words)


def test_hash_is_computed_once(docs):
    rows = sample.with_hash(docs, "doc_id", 1).where("_hash < '0a'").withColumn("again", F.substring("_hash", 1, 4))
    assert plan(rows).count("md5(") == 1


def test_python_gets_only_undecided_texts(inference):
    text = plan(guard.rule_guard(inference))
    assert re.search(r"test\(CASE WHEN .*_dirty.* THEN assistant_text", text)


def test_metadata_joins_as_a_broadcast_only_by_size(spark, docs):
    meta = spark.read.parquet(f"{SF}/labels.parquet").select(F.col("doc_id").cast("string").alias("image"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(curate.merge_metadata(docs, meta, "source"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "Broadcast" not in text and "SortMergeJoin" in text


def test_the_size_of_written_tables_decides_on_a_broadcast(spark, docs):
    keys = cut_lineage(docs.select("doc_id"))
    assert "BroadcastHashJoin" in plan(docs.join(keys, "doc_id"))
    wide = cut_lineage(spark.range(3_000_000).select(F.col("id").alias("doc_id")))
    assert "BroadcastHashJoin" not in plan(wide.join(wide.select("doc_id"), "doc_id"))


def test_settled_columns_keep_nulls_and_rows(spark):
    df = spark.createDataFrame([(1, None), (2, "a")], "i int, t string")
    made = settle(df, t=F.upper("t"), n=F.length("t"))
    assert sorted(map(tuple, made.select("i", "t", "n").collect())) == [(1, None, None), (2, "A", 1)]


def test_cut_lineage_keeps_the_schema(spark):
    df = spark.createDataFrame([(1, "漢", [1.0], {"a": 1})], "`列 1` int, s string, a array<double>, m map<string,int>")
    cut = cut_lineage(df)
    assert cut.schema == df.schema and cut.collect() == df.collect()


def test_counts_of_reasons_run_no_structure_rules(spark):
    from gradewright.catalog import QUERIES, registry

    rule = registry.TYPE_RULES[0][1][0][0]
    assert rule in plan(QUERIES["r06_r07_scored_14_columns"](spark, SF))
    for name in ("a01_reason_counts", "a03_verdict_rates"):
        assert rule not in plan(QUERIES[name](spark, SF))
