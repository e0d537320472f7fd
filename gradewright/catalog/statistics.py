"""Aggregations (A) over documents, orders and lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradewright.catalog.registry import query, rounded, sql_tokens, table
from gradewright.functions import text as tx
from gradewright.operators import stats

TOKENS = f"(SELECT doc_id, lang, {sql_tokens('text')} AS token_count FROM documents)"
QUARTILES = ("mean", "std", "median", "min", "max", "q25", "q75")


def tokens(spark, d):
    return table(spark, d, "documents").select("doc_id", "lang", tx.token_count("text").alias("token_count"))


def sql_summary(value: str) -> str:
    return f"""CAST(count({value}) AS BIGINT) AS n, round(avg({value}), 6) AS mean, round(stddev_pop({value}), 6) AS std, round(median({value}), 6) AS median,
  round(min({value}), 6) AS min, round(max({value}), 6) AS max, round(quantile_cont({value}, 0.25), 6) AS q25, round(quantile_cont({value}, 0.75), 6) AS q75,
  CAST(count(*) - count({value}) AS BIGINT) AS invalid"""


@query("a05_summary", f"SELECT {sql_summary('v')} FROM (SELECT CASE WHEN l_orderkey % 10 <> 3 THEN l_extendedprice END AS v FROM lineitem)")
def a05(spark, d):
    value = F.when(F.col("l_orderkey") % 10 == 3, F.lit(float("nan"))).otherwise(F.col("l_extendedprice"))
    return rounded(stats.summary(table(spark, d, "lineitem"), value), *QUARTILES)


@query("a05_summary_by_group", f"SELECT l_returnflag, {sql_summary('l_extendedprice')} FROM lineitem GROUP BY l_returnflag")
def a05_group(spark, d):
    return rounded(stats.summary(table(spark, d, "lineitem"), "l_extendedprice", ["l_returnflag"]), *QUARTILES)


@query("a05_percentiles_narrowed", """
SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.05), 6) AS p5, round(quantile_cont(l_extendedprice, 0.5), 6) AS p50,
  round(quantile_cont(l_extendedprice, 0.95), 6) AS p95 FROM lineitem GROUP BY l_returnflag""")
def a05_narrowed(spark, d):
    points = {"p5": 0.05, "p50": 0.5, "p95": 0.95}
    found = stats.percentiles(table(spark, d, "lineitem"), "l_extendedprice", points, ["l_returnflag"])
    return rounded(found, *points)


@query("a07_distinct_counts_of_orders", """
SELECT CAST(count(DISTINCT o_orderpriority) AS BIGINT) AS n_o_orderpriority, CAST(count(DISTINCT o_orderstatus) AS BIGINT) AS n_o_orderstatus,
  CAST(count(DISTINCT o_custkey) AS BIGINT) AS n_o_custkey FROM orders""")
def a07(spark, d):
    return stats.distinct_counts(table(spark, d, "orders"), "o_orderpriority", "o_orderstatus", "o_custkey")


@query("a07_distinct_counts_approximate", "SELECT count(DISTINCT o_custkey) AS exact, TRUE AS near FROM orders")
def a07_approximate(spark, d):
    """The exact count, and whether the estimate is within three of its deviations of 5 %."""
    orders = table(spark, d, "orders")
    about = stats.distinct_counts(orders, "o_custkey", approximate=True).select("n_o_custkey").scalar()
    exact = stats.distinct_counts(orders, "o_custkey").select(F.col("n_o_custkey").alias("exact"))
    return exact.withColumn("near", F.abs(about - F.col("exact")) <= 0.15 * F.col("exact"))


@query("a08_tier_distribution", """
WITH t AS (SELECT l_returnflag, CASE WHEN l_linenumber = 7 THEN NULL ELSE 1 - l_discount * 7 END AS v FROM lineitem),
tiers AS (SELECT * FROM (VALUES (0, 'excellent', 0.85, 9e9), (1, 'good', 0.75, 0.85), (2, 'acceptable', 0.65, 0.75), (3, 'poor', 0.5, 0.65), (4, 'very_poor', -9e9, 0.5)) AS x(position, tier, lo, hi))
SELECT l_returnflag, CAST(position AS INTEGER) AS position, tier, CAST(count(*) FILTER (v >= lo AND v < hi) AS BIGINT) AS n,
  round(count(*) FILTER (v >= lo AND v < hi) * 100.0::DOUBLE / count(*), 6) AS pct FROM t, tiers GROUP BY l_returnflag, position, tier""")
def a08(spark, d):
    value = F.when(F.col("l_linenumber") == 7, F.lit(float("nan"))).otherwise(1 - F.col("l_discount") * 7)
    return rounded(stats.tier_distribution(table(spark, d, "lineitem"), value, ["l_returnflag"]), "pct")


@query("a16_tier_rollup", """
SELECT l_returnflag, round(count(*) FILTER (v >= 0.65) * 100.0::DOUBLE / count(*), 6) AS acceptable_pct, round(count(*) FILTER (v < 0.65) * 100.0::DOUBLE / count(*), 6) AS poor_pct
FROM (SELECT l_returnflag, 1 - l_discount * 7 AS v FROM lineitem) GROUP BY l_returnflag""")
def a16(spark, d):
    tiers = stats.tier_distribution(table(spark, d, "lineitem"), 1 - F.col("l_discount") * 7, ["l_returnflag"])
    return rounded(stats.tier_rollup(tiers, ["l_returnflag"]), "acceptable_pct", "poor_pct")


@query("a12_histogram", f"""
SELECT CAST(b AS INTEGER) AS bin, CAST(count(*) FILTER ((token_count >= b AND token_count < b + 10) OR (b = 190 AND token_count = 200)) AS BIGINT) AS n,
  CAST(count(*) FILTER (token_count < 0) AS BIGINT) AS below, CAST(count(*) FILTER (token_count > 200) AS BIGINT) AS above
FROM {TOKENS}, generate_series(0, 190, 10) AS g(b) GROUP BY b""")
def a12(spark, d):
    return stats.histogram(tokens(spark, d), "token_count")


@query("a13_token_percentiles", f"""
SELECT lang, round(quantile_cont(token_count, 0.05), 6) AS p5, round(quantile_cont(token_count, 0.25), 6) AS p25, round(quantile_cont(token_count, 0.5), 6) AS p50,
  round(quantile_cont(token_count, 0.75), 6) AS p75, round(quantile_cont(token_count, 0.95), 6) AS p95, CAST(max(token_count) AS INTEGER) AS max FROM {TOKENS} GROUP BY lang""")
def a13(spark, d):
    return rounded(stats.token_percentiles(tokens(spark, d), by=["lang"]), "p5", "p25", "p50", "p75", "p95")


@query("a13_token_percentiles_approximate", f"""
SELECT lang, CAST(count(*) AS BIGINT) AS n, TRUE AS p5, TRUE AS p25, TRUE AS p50, TRUE AS p75, TRUE AS p95 FROM {TOKENS} GROUP BY lang""")
def a13_approximate(spark, d):
    """Whether each estimate's rank is within 1 / 1000 of the rows, and a row, of the one asked for."""
    df = tokens(spark, d)
    about = stats.token_percentiles(df, accuracy=1000, by=["lang"])
    points = {"p5": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95}
    joined = df.join(about, "lang")
    ranks = joined.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), *[
        F.count_if(F.col("token_count") < F.col(p)).alias(f"_lo_{p}") for p in points], *[
        F.count_if(F.col("token_count") <= F.col(p)).alias(f"_hi_{p}") for p in points])
    slack = F.col("n") / 1000 + 1
    return ranks.select("lang", "n", *[
        ((F.col(f"_lo_{p}") <= x * F.col("n") + slack) & (F.col(f"_hi_{p}") >= x * F.col("n") - slack)).alias(p) for p, x in points.items()])


@query("a14_threshold_calibration", f"""
WITH t AS (SELECT token_count, (SELECT quantile_cont(token_count, 0.05) FROM {TOKENS}) AS p5, (SELECT quantile_cont(token_count, 0.95) FROM {TOKENS}) AS p95 FROM {TOKENS}),
candidates AS (SELECT 'learned' AS candidate, p5 AS low, p95 AS high FROM t LIMIT 1), every AS (SELECT * FROM candidates UNION ALL SELECT 'older', 98.0, 202.0 UNION ALL SELECT 'newer', 30.0, 200.0)
SELECT candidate, round(CAST(low AS DOUBLE), 6) AS low, round(CAST(high AS DOUBLE), 6) AS high, CAST(count(*) FILTER (token_count < low) AS BIGINT) AS too_short,
  CAST(count(*) FILTER (token_count > high) AS BIGINT) AS too_long, CAST(count(token_count) AS BIGINT) AS n FROM t, every GROUP BY candidate, low, high""")
def a14(spark, d):
    df = tokens(spark, d)
    low, high = stats.calibrate(df)
    return rounded(stats.threshold_rejections(df, [("learned", low, high), ("older", 98, 202), ("newer", 30, 200)]), "low", "high")
