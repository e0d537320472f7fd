"""Vector metrics (X16, X17), evaluation (E) and stage comparison (W) on embeddings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradewright.catalog.registry import ORACLES, long_rows, query, rounded, sql_long, table
from gradewright.functions import vectors as vec
from gradewright.operators import compare, evaluate, stats

COST = {"1": 1.38, "2": 2.93, "3": 4.53, "4": 4.53}
# Cosines of the test vectors are low, so the tiers are too.
TIERS = (("excellent", 0.3), ("good", 0.15), ("acceptable", 0.0), ("poor", -0.15))
TIER_BOUNDS = "(VALUES (0, 'excellent', 0.3, 9.0), (1, 'good', 0.15, 0.3), (2, 'acceptable', 0.0, 0.15), (3, 'poor', -0.15, 0.0), (4, 'very_poor', -9.0, -0.15)) AS x(position, tier, lo, hi)"


def pairs(spark, d):
    """Each vector paired with the next one; stage 1 to 4 by label."""
    e = table(spark, d, "embeddings")
    truth = e.select(
        F.col("vec_id").alias("sample_id"), F.col("embedding").alias("truth_vector"), (F.col("label") % 4 + 1).alias("stage"),
        F.col("vec_id").cast("string").alias("ground_truth"),
    )
    prediction = e.select(
        (F.col("vec_id") - 1).alias("sample_id"), F.col("embedding").alias("prediction_vector"), F.col("label").cast("string").alias("prediction")
    )
    return evaluate.align(truth, prediction, "sample_id")


def samples(spark, d):
    return evaluate.evaluate(pairs(spark, d), "sample_id", by=["stage"])


SAMPLES = """(SELECT a.vec_id AS sample_id, CAST(a.label % 4 + 1 AS INTEGER) AS stage,
  list_sum(list_transform(list_zip(x, y), lambda p: p[1] * p[2])) / (sqrt(list_sum(list_transform(x, lambda v: v * v))) * sqrt(list_sum(list_transform(y, lambda v: v * v)))) AS cosine_similarity,
  sqrt(list_sum(list_transform(list_zip(x, y), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) AS euclidean_distance,
  list_sum(list_transform(list_zip(x, y), lambda p: abs(p[1] - p[2]))) AS manhattan_distance,
  CAST(length(CAST(a.vec_id AS VARCHAR)) AS INTEGER) AS ground_truth_length, CAST(length(CAST(b.label AS VARCHAR)) AS INTEGER) AS prediction_length
FROM (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings) a JOIN (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS y FROM embeddings) b ON b.vec_id = a.vec_id + 1)"""

SUMMARY = f"""(SELECT stage, count(*) AS n, avg(cosine_similarity) AS mean, stddev_pop(cosine_similarity) AS std, median(cosine_similarity) AS median, min(cosine_similarity) AS min,
  max(cosine_similarity) AS max, quantile_cont(cosine_similarity, 0.25) AS q25, quantile_cont(cosine_similarity, 0.75) AS q75 FROM {SAMPLES} GROUP BY stage)"""
STAT_COLUMNS = ("mean", "std", "median", "min", "max", "q25", "q75")


def summary(spark, d):
    return compare.stage_summary(samples(spark, d))


@query("x16_x17_vector_columns", f"""
SELECT sample_id, round(cosine_similarity, 6) AS cosine, round(euclidean_distance, 6) AS euclidean, round(manhattan_distance, 6) AS manhattan FROM {SAMPLES}""")
def x16(spark, d):
    """As built-in column expressions; the evaluation uses one Arrow pass instead."""
    a, b = "truth_vector", "prediction_vector"
    made = pairs(spark, d).select(
        "sample_id", vec.cosine_similarity(a, b).alias("cosine"), vec.euclidean_distance(a, b).alias("euclidean"),
        vec.manhattan_distance(a, b).alias("manhattan"),
    )
    return rounded(made, "cosine", "euclidean", "manhattan")


@query("j03_alignment", """
SELECT CAST(count(*) FILTER (e > 0 AND l > 0) AS BIGINT) AS matched, CAST(count(*) FILTER (l = 0) AS BIGINT) AS left_only, CAST(count(*) FILTER (e = 0) AS BIGINT) AS right_only,
  CAST(count(*) FILTER (e > 1 OR l > 1) AS BIGINT) AS repeated
FROM (SELECT id, sum(e) AS e, sum(l) AS l FROM (SELECT doc_id AS id, 1 AS e, 0 AS l FROM documents UNION ALL SELECT doc_id * 2, 0, 1 FROM labels) GROUP BY id)""")
def j03(spark, d):
    left = table(spark, d, "documents").select(F.col("doc_id").alias("id"))
    right = table(spark, d, "labels").select((F.col("doc_id") * 2).alias("id"))
    return evaluate.alignment_report(left, right, "id")


@query("e01_per_sample", f"""
SELECT sample_id, round(cosine_similarity, 6) AS cosine_similarity, round(euclidean_distance, 6) AS euclidean_distance, round(manhattan_distance, 6) AS manhattan_distance,
  ground_truth_length, prediction_length FROM {SAMPLES}""")
def e01(spark, d):
    return rounded(evaluate.evaluate(pairs(spark, d), "sample_id"), *vec.METRICS)


def sql_overall() -> str:
    calls = {"mean": "avg({m})", "std": "stddev_pop({m})", "median": "median({m})", "min": "min({m})", "max": "max({m})", "q25": "quantile_cont({m}, 0.25)", "q75": "quantile_cont({m}, 0.75)"}
    return ", ".join(f"round({calls[k].format(m=m)}, 6) AS {m}_{k}" for m, kept in evaluate.OVERALL.items() for k in kept)


@query("e02_overall_metrics", f"SELECT CAST(count(*) AS BIGINT) AS n, {sql_overall()} FROM {SAMPLES}")
def e02(spark, d):
    overall = evaluate.overall_metrics(samples(spark, d))
    return rounded(overall, *[c for c in overall.columns if c != "n"])


@query("e02_tiers", f"""
SELECT CAST(position AS INTEGER) AS position, tier, CAST(count(*) FILTER (cosine_similarity >= lo AND cosine_similarity < hi) AS BIGINT) AS n,
  round(count(*) FILTER (cosine_similarity >= lo AND cosine_similarity < hi) * 100.0::DOUBLE / count(*), 6) AS pct FROM {SAMPLES}, {TIER_BOUNDS} GROUP BY position, tier""")
def e02_tiers(spark, d):
    return rounded(stats.tier_distribution(samples(spark, d), "cosine_similarity", tiers=TIERS), "pct")


@query("e04_w07_stage_summary", f"""
SELECT stage, CAST(n AS BIGINT) AS n, {", ".join(f"round({c}, 6) AS {c}" for c in STAT_COLUMNS)}, CAST(0 AS BIGINT) AS invalid FROM {SUMMARY}""")
def e04(spark, d):
    return rounded(summary(spark, d), *STAT_COLUMNS)


@query("e04_stage_tiers", f"""
SELECT stage, CAST(position AS INTEGER) AS position, tier, CAST(count(*) FILTER (cosine_similarity >= lo AND cosine_similarity < hi) AS BIGINT) AS n,
  round(count(*) FILTER (cosine_similarity >= lo AND cosine_similarity < hi) * 100.0::DOUBLE / count(*), 6) AS pct FROM {SAMPLES}, {TIER_BOUNDS} GROUP BY stage, position, tier""")
def e04_tiers(spark, d):
    return rounded(stats.tier_distribution(samples(spark, d), "cosine_similarity", ["stage"], TIERS), "pct")


@query("w01_w02_versus_baseline", f"""
SELECT stage, round(mean, 6) AS mean, round(base, 6) AS baseline_mean, round(i, 6) AS improvement, round(i / base * 100, 4) AS improvement_pct,
  CASE WHEN i > 0 THEN '↑' WHEN i < 0 THEN '↓' WHEN i = 0 THEN '↔' END AS direction
FROM (SELECT *, CASE WHEN stage > (SELECT min(stage) FROM {SUMMARY}) THEN mean - base END AS i FROM (SELECT *, first_value(mean) OVER (ORDER BY stage) AS base FROM {SUMMARY}))""")
def w01(spark, d):
    made = compare.versus_baseline(summary(spark, d)).select("stage", "mean", "baseline_mean", "improvement", "improvement_pct", "direction")
    return rounded(rounded(made, "mean", "baseline_mean", "improvement"), "improvement_pct", digits=4)


@query("w03_steps", f"SELECT stage, round(mean - lag(mean) OVER (ORDER BY stage), 6) AS step FROM {SUMMARY}")
def w03(spark, d):
    return rounded(compare.steps(summary(spark, d)).select("stage", "step"), "step")


@query("w03_w04_progression", f"""
SELECT CAST(count(*) AS BIGINT) AS stages, round(avg(step), 6) AS average_step, bool_or(back <= 2 AND abs(step) < 0.01) AS plateau
FROM (SELECT mean - lag(mean) OVER (ORDER BY stage) AS step, row_number() OVER (ORDER BY stage DESC) AS back FROM {SUMMARY})""")
def w04(spark, d):
    return rounded(compare.progression(summary(spark, d)), "average_step")


@query("w05_l04_best_stage", f"""
SELECT stage, round(mean, 6) AS mean FROM {SUMMARY} ORDER BY mean DESC, stage LIMIT 1""")
def w05(spark, d):
    return rounded(compare.best_stage(summary(spark, d)), "mean")


@query("w05_most_in_top_tier", f"""
SELECT stage, CAST(count(*) FILTER (cosine_similarity >= 0.3) AS BIGINT) AS n FROM {SAMPLES} GROUP BY stage ORDER BY n DESC, stage LIMIT 1""")
def w05_top(spark, d):
    tiers = stats.tier_distribution(samples(spark, d), "cosine_similarity", ["stage"], TIERS)
    return compare.best_stage(tiers.where(F.col("tier") == "excellent"), "n")


@query("w06_efficiency", f"""
WITH c AS (SELECT stage, mean, CAST(CASE stage WHEN 1 THEN 1.38 WHEN 2 THEN 2.93 WHEN 3 THEN 4.53 WHEN 4 THEN 4.53 END AS DOUBLE) AS cost FROM {SUMMARY}),
g AS (SELECT *, mean - first_value(mean) OVER (ORDER BY stage) AS gain, cost - first_value(cost) OVER (ORDER BY stage) AS extra_cost FROM c),
e AS (SELECT *, CASE WHEN stage = 1 THEN mean / cost WHEN extra_cost > 0 THEN gain / extra_cost ELSE 0 END AS efficiency FROM g)
SELECT stage, round(mean, 6) AS mean, cost, round(gain, 6) AS gain, round(extra_cost, 6) AS extra_cost, round(efficiency, 6) AS efficiency,
  stage = (SELECT stage FROM e WHERE stage > 1 AND extra_cost > 0 ORDER BY efficiency DESC, stage LIMIT 1) AS recommended FROM e""")
def w06(spark, d):
    return rounded(compare.efficiency(summary(spark, d), COST), "mean", "gain", "extra_cost", "efficiency")


@query("w07_metric_table", f"""
SELECT CAST(p AS INTEGER) AS position, m AS metric, {", ".join(f'round(max(v) FILTER (stage = {s}), 6) AS "{s}"' for s in (1, 2, 3, 4))}
FROM (SELECT stage, unnest([0, 1, 2, 3, 4]) AS p, unnest(['mean', 'std', 'min', 'max', 'median']) AS m, unnest([mean, std, min, max, median]) AS v FROM {SUMMARY}) GROUP BY p, m""")
def w07(spark, d):
    return rounded(compare.metric_table(summary(spark, d), [1, 2, 3, 4]), "1", "2", "3", "4")


OVERALL_COLUMNS = [f"{m}_{k}" for m, kept in evaluate.OVERALL.items() for k in kept]


@query("e02_x15_evaluation_json", " UNION ALL ".join([
    sql_long("overall", ORACLES["e02_overall_metrics"], [], ["n", *OVERALL_COLUMNS]),
    sql_long("tiers", ORACLES["e02_tiers"], ["tier"], ["n", "pct"]),
]))
def e02_json(spark, d):
    """The JSON text, read back and laid out as rows."""
    text = evaluate.evaluation_json(samples(spark, d), TIERS, "given vectors").withColumnRenamed("evaluation", "j")

    def number(path):
        return F.get_json_object("j", f"$.{path}").cast("double")

    overall = text.select(number("metadata.n_samples").alias("n"), *[
        number(f"overall_metrics.{m}.{k}").alias(f"{m}_{k}") for m, kept in evaluate.OVERALL.items() for k in kept])
    tiers = [name for name, _ in TIERS] + ["very_poor"]
    each = text.select(F.explode(F.array(*[
        F.struct(F.lit(t).alias("tier"), number(f"quality_distribution.{t}.count").alias("n"), number(f"quality_distribution.{t}.percentage").alias("pct"))
        for t in tiers])).alias("t")).select("t.*")
    return long_rows("overall", overall, [], ["n", *OVERALL_COLUMNS]).unionByName(long_rows("tiers", each, ["tier"], ["n", "pct"]))


# Table of the report: SQL of the same table, its keys and its numbers.
REPORT = {
    "summary": (ORACLES["e04_w07_stage_summary"], ["stage"], ["n", *STAT_COLUMNS]),
    "distribution": (ORACLES["e04_stage_tiers"], ["stage", "tier"], ["n", "pct"]),
    "versus_baseline": (ORACLES["w01_w02_versus_baseline"], ["stage"], ["mean", "baseline_mean", "improvement"]),
    "progression": (ORACLES["w03_w04_progression"], [], ["stages", "average_step", "plateau"]),
    "best": (ORACLES["w05_l04_best_stage"], ["stage"], ["mean"]),
    "most_in_top_tier": (ORACLES["w05_most_in_top_tier"], ["stage"], ["n"]),
    "efficiency": (ORACLES["w06_efficiency"], ["stage"], ["mean", "cost", "gain", "extra_cost", "efficiency", "recommended"]),
    "rollup": (f"""SELECT stage, count(*) FILTER (cosine_similarity >= 0) * 100.0::DOUBLE / count(*) AS acceptable_pct,
      count(*) FILTER (cosine_similarity < 0) * 100.0::DOUBLE / count(*) AS poor_pct FROM {SAMPLES} GROUP BY stage""", ["stage"], ["acceptable_pct", "poor_pct"]),
}


@query("e05_progress_report", " UNION ALL ".join(sql_long(n, *made) for n, made in REPORT.items()))
def e05(spark, d):
    """All tables of the report in one long table."""
    tables = compare.progress_report(samples(spark, d), tiers=TIERS, cost=COST)
    parts = [long_rows(n, tables[n], keys, columns) for n, (_, keys, columns) in REPORT.items()]
    return reduce(DataFrame.unionByName, parts)
