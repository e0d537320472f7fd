"""Sources (S), sinks (K) and incremental runs (T). Each query writes what it
derives from the tables to a fresh folder and reads it back."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradewright.catalog import evaluating as ev
from gradewright.catalog import grading as gr
from gradewright.catalog.registry import query, rounded, sql_tokens, table
from gradewright.functions import text as tx
from gradewright.operators import curate, guard, score
from gradewright.session import fresh_folder
from gradewright.sources import readers, writers
from gradewright.streaming import incremental

TEXTS = "doc_id long, lang string, text string"


@query("s01_master_table", "SELECT source || '/' || doc_id || '.txt' AS path, text FROM documents")
def s01(spark, d):
    folder = fresh_folder(spark, "master")
    path = F.concat_ws("/", "source", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    table(spark, d, "documents").select(path.alias("path"), "text").write.parquet(folder)
    return readers.read_master(spark, folder, "path", "text")


@query("s02_k01_k02_csv", "SELECT doc_id, lang, text FROM documents")
def s02(spark, d):
    folder = fresh_folder(spark, "csv")
    writers.write_csv(table(spark, d, "documents").select("doc_id", "lang", "text"), folder)
    return readers.read_csv(spark, folder, TEXTS)


def _evaluations(spark, d):
    """Evaluation documents of the stages, with their per-sample arrays, as files.

    An array per stage is the format of these files; the samples stay rows
    everywhere else. Buckets of 1,000 sample ids bound each array.
    """
    samples = ev.samples(spark, d).withColumn("bucket", F.floor(F.col("sample_id") / 1000))
    fields = ("image_id", "cosine_similarity", "euclidean_distance", "manhattan_distance", "ground_truth_length", "prediction_length")
    named = samples.withColumn("image_id", F.col("sample_id").cast("string"))
    grouped = named.groupBy("stage", "bucket").agg(
        F.collect_list(F.struct(*fields)).alias("per_sample_results"), F.count(F.lit(1)).alias("n"), F.avg("cosine_similarity").alias("mean")
    )
    doc = grouped.select(
        F.struct(F.concat_ws("-", "stage", "bucket").alias("model_name"), F.col("n").alias("n_samples")).alias("metadata"),
        F.struct(F.struct("mean").alias("cosine_similarity")).alias("overall_metrics"), "per_sample_results",
    )
    folder = fresh_folder(spark, "evaluations")
    writers.write_json(doc, folder)
    return folder


@query("s03_k03_nested_json", f"""
SELECT stage || '-' || CAST(floor(sample_id / 1000) AS BIGINT) AS model_name, CAST(count(*) AS BIGINT) AS n_samples, round(avg(cosine_similarity), 6) AS mean,
  CAST(count(*) AS INTEGER) AS listed FROM {ev.SAMPLES} GROUP BY ALL""")
def s03(spark, d):
    read = readers.read_evaluations(spark, _evaluations(spark, d))
    return rounded(read.select("metadata.model_name", "metadata.n_samples", F.col("overall_metrics.cosine_similarity.mean").alias("mean"),
                               F.size("per_sample_results").alias("listed")), "mean")


@query("s04_file_manifest", """
SELECT doc_id, doc_id % 7 <> 0 AND lang = 'es' AS file_missing, count(*) FILTER (WHERE doc_id % 7 <> 0 AND lang = 'es') OVER () AS audited FROM documents""")
def s04(spark, d):
    """Documents written to files, in folders with blanks and accents; their rows
    name the file they are in, as address or plain path, or one that is not there."""
    folder = fresh_folder(spark, "manifest files é")
    docs = table(spark, d, "documents").select("doc_id", "lang", F.concat("source", F.lit(" ñ")).alias("place"))
    docs.where("lang <> 'es'").write.partitionBy("place").json(folder)
    there = spark.read.schema("doc_id long, lang string").json(folder).select("doc_id", F.col("_metadata.file_path").alias("path"))
    absent = docs.where("lang = 'es'").select("doc_id", F.concat(F.lit(folder + "/"), "place", F.lit("/none.json")).alias("path"))
    rows = there.unionByName(absent).withColumn("path", F.when(F.col("doc_id") % 7 == 0, "").when(F.col("doc_id") % 3 == 0, tx.plain_path("path")).otherwise(F.col("path")))
    manifest = readers.file_manifest(spark, folder, "*.json")
    marked = curate.mark_missing_files(rows, manifest, "path").select("doc_id", "file_missing")
    return marked.withColumn("audited", curate.missing_file_audit(rows, manifest, "path").select("missing").scalar())


@query("s05_per_sample_scores", f"SELECT round(cosine_similarity, 6) AS cosine_similarity FROM {ev.SAMPLES}")
def s05(spark, d):
    folder = fresh_folder(spark, "scores")
    writers.write_csv(ev.samples(spark, d).select(F.col("cosine_similarity").alias("Cosine score")), folder)
    empty = fresh_folder(spark, "no-samples")
    one = table(spark, d, "embeddings").groupBy().agg(F.struct(F.count(F.lit(1)).alias("n_samples")).alias("metadata"))
    writers.write_json(one, empty)
    return rounded(readers.per_sample_scores(spark, empty, folder), "cosine_similarity")


@query("s05_per_sample_arrays", f"SELECT round(cosine_similarity, 6) AS cosine_similarity FROM {ev.SAMPLES} WHERE cosine_similarity IS NOT NULL")
def s05_arrays(spark, d):
    return rounded(readers.per_sample_scores(spark, _evaluations(spark, d)), "cosine_similarity")


@query("s06_stages", "SELECT doc_id, lang AS stage FROM documents")
def s06(spark, d):
    base = fresh_folder(spark, "stages")
    writers.write_splits(table(spark, d, "documents").select("doc_id", "lang"), base, "lang")
    return readers.read_stages(spark, {s: f"{base}/lang={s}" for s in ("en", "fr", "de", "es", "absent")})


@query("s07_rules", f"""
SELECT o_orderkey, round({gr.sql_points('damage_type', 'o_orderpriority', gr.ORDER_TABLES)}, 6) AS from_file, 0.5::DOUBLE AS from_default FROM orders""")
def s07(spark, d):
    folder = fresh_folder(spark, "rules")
    rules = table(spark, d, "orders").groupBy().agg(
        F.map_from_entries(F.array_sort(F.collect_set(F.struct(
            F.col("o_orderpriority"), gr.score.points("damage_type", "o_orderpriority", gr.ORDER_RULES)
        )))).alias("damage_type_scores")
    )
    writers.write_json(rules.coalesce(1), folder)
    found, default = score.load_rules(spark, folder), score.load_rules(spark, folder + "-absent")
    made = table(spark, d, "orders").select(
        "o_orderkey", score.points("damage_type", "o_orderpriority", found).alias("from_file"),
        score.points("damage_type", "o_orderpriority", default).alias("from_default"),
    )
    return rounded(made, "from_file")


@query("k04_record_stages", """
SELECT doc_id, 'description' AS stage, '{"description":"' || lang || '"}' AS content FROM documents
UNION ALL SELECT doc_id, 'size', '{"size":' || length(text) || '}' FROM documents""")
def k04(spark, d):
    folder = fresh_folder(spark, "record-stages")
    df = table(spark, d, "documents").withColumn("size", F.length("text"))
    writers.write_record_stages(df, folder, "doc_id", {"description": "lang", "size": "size"})
    return spark.read.parquet(folder)


@query("k05_summary_csv", f"""
SELECT CAST(stage AS VARCHAR) AS stage, {", ".join(f"printf('%.6f', {c}) AS {c}" for c in ('mean', 'std', 'median', 'q25', 'q75', 'min', 'max'))} FROM {ev.SUMMARY}""")
def k05(spark, d):
    folder = fresh_folder(spark, "summary")
    writers.write_summary(ev.summary(spark, d), folder)
    return readers.read_csv(spark, folder)


@query("k06_splits", "SELECT doc_id, lang AS split FROM documents")
def k06(spark, d):
    folder = fresh_folder(spark, "splits")
    writers.write_splits(table(spark, d, "documents").select("doc_id", F.col("lang").alias("split")), folder)
    return spark.read.parquet(folder)


DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@query("t01_k07_incremental_run", f"""
SELECT doc_id, token_count, {gr.sql_calibrated('text', 'token_count')} AS reason_code FROM (SELECT doc_id, text, {sql_tokens('text')} AS token_count FROM documents)""")
def t01(spark, d):
    """The guard over a folder, run twice: the second run finds nothing new."""
    output, checkpoint = fresh_folder(spark, "guarded"), fresh_folder(spark, "guarded-progress")
    guarded = lambda s: guard.calibrated_guard(s, "text", **gr.GUARD).select("doc_id", "token_count", "reason_code")
    for _ in range(2):
        stream = incremental.read_table_stream(spark, f"{d}/documents.parquet", DOCUMENTS)
        incremental.run_incrementally(stream, guarded, output, checkpoint)
    return spark.read.schema(guarded(stream).schema).parquet(output)


@query("t02_skip_done", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def t02(spark, d):
    done = table(spark, d, "labels").where("quality = 1")
    return incremental.skip_done(table(spark, d, "documents").select("doc_id"), done, "doc_id")


@query("t03_running_counters", f"""
SELECT CASE WHEN {gr.sql_calibrated('text', 'token_count')} = 'High Quality' THEN 'PASS' ELSE 'FAIL' END AS quality_verdict, CAST(count(*) AS BIGINT) AS n
FROM (SELECT text, {sql_tokens('text')} AS token_count FROM documents) GROUP BY ALL""")
def t03(spark, d):
    output, checkpoint = fresh_folder(spark, "counters"), fresh_folder(spark, "counters-progress")
    stream = incremental.read_table_stream(spark, f"{d}/documents.parquet", DOCUMENTS)
    incremental.run_counters(guard.calibrated_guard(stream, "text", **gr.GUARD), ["quality_verdict"], output, checkpoint)
    return incremental.latest_counters(spark, output)


@query("e03_evaluate_from_file", f"""
SELECT CAST(sample_id AS VARCHAR) AS filename, round(cosine_similarity, 6) AS cosine_similarity, round(euclidean_distance, 6) AS euclidean_distance,
  round(manhattan_distance, 6) AS manhattan_distance, ground_truth_length, prediction_length FROM {ev.SAMPLES}""")
def e03(spark, d):
    """Texts from CSV under their own column names, vectors from a table by key."""
    from gradewright.operators import evaluate

    folder = fresh_folder(spark, "evaluate")
    pairs = ev.pairs(spark, d).withColumn("filename", F.col("sample_id").cast("string"))
    writers.write_csv(pairs.select("filename", F.col("ground_truth").alias("text"), "prediction"), folder)
    texts = readers.read_csv(spark, folder)
    vectors = pairs.select("filename", "truth_vector", "prediction_vector")
    made = evaluate.evaluate(evaluate.align(texts, vectors, "filename"), "filename", truth="text")
    return rounded(made, "cosine_similarity", "euclidean_distance", "manhattan_distance")
