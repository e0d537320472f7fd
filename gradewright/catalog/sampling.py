"""Stratified samples and splits (M) of documents by language and label."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradewright.catalog import curating as cu
from gradewright.catalog.registry import long_rows, query, rounded, sql_long, table
from gradewright.operators import sample, stats
from gradewright.plans import curation

STRATA = ["lang", "quality"]
N = 100
TRAIN = (50, 120)

CORPUS = """(SELECT doc_id, lang, coalesce(CAST(quality AS VARCHAR), 'unknown') AS quality, length(text) AS len
FROM documents LEFT JOIN labels USING (doc_id))"""


def corpus(spark, d):
    df = table(spark, d, "documents").select("doc_id", "lang", F.length("text").alias("len"))
    df = df.join(table(spark, d, "labels"), "doc_id", "left").drop("toxic")
    return df.withColumn("quality", F.coalesce(F.col("quality").cast("string"), F.lit("unknown")))


def sql_targets(source: str, n: int, by: str = "") -> str:
    """Allocation written the slow way: list all units and drop the surplus."""
    return f"""
    sizes AS (SELECT lang, quality, count(*) AS size FROM {source} GROUP BY ALL),
    rounded AS (SELECT *, CAST(round_even(size / (SELECT sum(size) FROM sizes)::DOUBLE * {n}, 0) AS BIGINT) AS t FROM sizes),
    surplus AS (SELECT sum(t) - {n} AS s FROM rounded),
    ranked AS (SELECT *, row_number() OVER (ORDER BY t DESC, size DESC, lang, quality) AS r FROM rounded),
    units AS (SELECT lang, quality, row_number() OVER (ORDER BY unit DESC, r) AS u
              FROM (SELECT lang, quality, r, unnest(generate_series(1, t)) AS unit FROM ranked)),
    lost AS (SELECT lang, quality, count(*) AS k FROM units, surplus WHERE u <= s GROUP BY ALL),
    targets AS (SELECT ranked.lang, ranked.quality, size,
        t - coalesce(k, 0) + CASE WHEN r = 1 AND s < 0 THEN -s ELSE 0 END AS target
      FROM ranked CROSS JOIN surplus LEFT JOIN lost ON ranked.lang = lost.lang AND ranked.quality = lost.quality)"""


def sql_sample(source: str, seed: int) -> str:
    return f"""
      SELECT c.doc_id, c.lang, c.quality, c.len FROM (
        SELECT *, row_number() OVER (PARTITION BY lang, quality ORDER BY md5(doc_id || '|' || '{seed}'), doc_id) AS place FROM {source}) c
      JOIN targets t ON c.lang = t.lang AND c.quality = t.quality WHERE place <= target"""


@query("m01_allocation", f"""
WITH {sql_targets(CORPUS, N)} SELECT lang, quality, CAST(size AS BIGINT) AS size, CAST(target AS BIGINT) AS target FROM targets""")
def m01(spark, d):
    sizes = sample.strata_counts(corpus(spark, d), STRATA)
    return sample.allocate(sizes, STRATA, N)


@query("m01_allocation_surplus", f"""
WITH {sql_targets("(SELECT source AS lang, lang AS quality FROM documents)", 170)}
SELECT lang AS source, quality AS lang, CAST(size AS BIGINT) AS size, CAST(target AS BIGINT) AS target FROM targets""")
def m01_surplus(spark, d):
    sizes = sample.strata_counts(table(spark, d, "documents"), ["source", "lang"])
    return sample.allocate(sizes, ["source", "lang"], 170)


@query("m01_shortfall", f"""
WITH {sql_targets(CORPUS, 1500)} SELECT CAST(sum(target) AS BIGINT) AS requested, CAST(sum(least(target, size)) AS BIGINT) AS drawn,
  CAST(sum(greatest(target - size, 0)) AS BIGINT) AS short FROM targets""")
def m01_shortfall(spark, d):
    return sample.shortfall(sample.allocate(sample.strata_counts(corpus(spark, d), STRATA), STRATA, 1500))


@query("m02_stratified_sample", f"WITH {sql_targets(CORPUS, N)} {sql_sample(CORPUS, 42)}")
def m02(spark, d):
    return sample.stratified_sample(corpus(spark, d), N, STRATA, "doc_id").select("doc_id", "lang", "quality", "len")


@query("m02_one_stratum", f"""
SELECT doc_id FROM documents ORDER BY md5(doc_id || '|' || '7'), doc_id LIMIT {N}""")
def m02_one(spark, d):
    df = table(spark, d, "documents").select("doc_id", F.lit("unknown").alias("component_type"))
    return sample.stratified_sample(df, N, ["component_type"], "doc_id", seed=7).select("doc_id")


@query("m03_hold_out", f"""
WITH {sql_targets(CORPUS, N)}, test AS ({sql_sample(CORPUS, 42)})
SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM test) THEN 'test' ELSE 'pool' END AS split FROM documents""")
def m03(spark, d):
    test, pool = sample.hold_out(corpus(spark, d), N, STRATA, "doc_id")
    return test.select("doc_id", F.lit("test").alias("split")).unionByName(pool.select("doc_id", F.lit("pool").alias("split")))


def sql_splits(source: str, n: int, sizes) -> str:
    """Test set, pool and training sets of a source."""
    drawn = ", ".join(f"t{k} AS (WITH {sql_targets('pool', k)} {sql_sample('pool', 42 + k)})" for k in sizes)
    parts = " ".join(f"UNION ALL SELECT 'train_{k}' AS split, * FROM t{k}" for k in sizes)
    return f"""t0 AS (WITH {sql_targets(source, n)} {sql_sample(source, 42)}),
pool AS (SELECT * FROM {source} WHERE doc_id NOT IN (SELECT doc_id FROM t0)), {drawn},
splits AS (SELECT 'test' AS split, * FROM t0 {parts})"""


SPLIT_SQL = f"WITH {sql_splits(CORPUS, N, TRAIN)}"


def splits(spark, d):
    test, pool = sample.hold_out(corpus(spark, d), N, STRATA, "doc_id")
    trains = sample.training_sets(pool, TRAIN, STRATA, "doc_id")
    named = trains.withColumn("split", F.concat(F.lit("train_"), F.col("train_size").cast("string"))).drop("train_size")
    return test.withColumn("split", F.lit("test")).unionByName(named)


@query("m03_repeated_keys", f"""
SELECT CAST(count(*) + count(*) FILTER (WHERE doc_id % 5 = 0) AS BIGINT) AS rows, CAST({N} AS BIGINT) AS test,
  CAST(count(*) + count(*) FILTER (WHERE doc_id % 5 = 0) - {N} AS BIGINT) AS rest, CAST(0 AS BIGINT) AS shared, CAST(0 AS BIGINT) AS moved FROM documents""")
def m03_repeated(spark, d):
    """Every fifth key twice: the parts add up, share no key, and do not depend on the partitioning."""
    copies = F.when(F.col("doc_id") % 5 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    df = corpus(spark, d).withColumn("copy", F.explode(copies))
    test, pool = sample.hold_out(df.repartition(3), N, STRATA, "doc_id")
    again, _ = sample.hold_out(df.repartition(7), N, STRATA, "doc_id")
    report = sample.hold_out_report(df, test, pool).select("rows", "test", (F.col("pool") + F.col("dropped")).alias("rest"))
    moved = test.exceptAll(again).agg(F.count(F.lit(1)).alias("moved"))
    return report.withColumns({"shared": sample.overlap(test, pool, "doc_id").scalar(), "moved": moved.scalar()})


@query("m04_training_sets", f"{SPLIT_SQL} SELECT split, doc_id, lang, quality FROM splits")
def m04(spark, d):
    return splits(spark, d).select("split", "doc_id", "lang", "quality")


@query("m04_pool_too_small", """
SELECT 1000000 AS train_size, doc_id FROM labels""")
def m04_small(spark, d):
    pool = table(spark, d, "labels").withColumn("stratum", F.lit("all"))
    return sample.training_sets(pool, [1000000], ["stratum"], "doc_id").select("train_size", "doc_id")


@query("m05_random_split", """
SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY md5(doc_id || '|' || '42'), doc_id)
  <= ceil(0.2 * (SELECT count(*) FROM documents)) THEN 'validation' ELSE 'train' END AS split FROM documents""")
def m05(spark, d):
    return sample.random_split(table(spark, d, "documents").select("doc_id"), "doc_id")


@query("m06_overlap", "SELECT CAST(0 AS BIGINT) AS shared")
def m06(spark, d):
    test, pool = sample.hold_out(corpus(spark, d), N, STRATA, "doc_id")
    return sample.overlap(test, sample.training_sets(pool, TRAIN, STRATA, "doc_id"), "doc_id")


@query("a06_length_summary", f"""{SPLIT_SQL}
SELECT split, CAST(count(len) AS BIGINT) AS n, round(avg(len), 6) AS mean, round(quantile_cont(len, 0.5), 6) AS median,
  round(stddev_samp(len), 6) AS std, CAST(min(len) AS INTEGER) AS min, CAST(max(len) AS INTEGER) AS max FROM splits GROUP BY split""")
def a06(spark, d):
    return rounded(stats.length_summary(splits(spark, d), "len", ["split"]), "mean", "median", "std")


@query("a07_distinct_counts", f"""{SPLIT_SQL}
SELECT split, CAST(count(DISTINCT lang) AS BIGINT) AS n_lang, CAST(count(DISTINCT quality) AS BIGINT) AS n_quality FROM splits GROUP BY split""")
def a07(spark, d):
    return stats.distinct_counts(splits(spark, d), "lang", "quality", by=["split"])


@query("a18_split_sizes", f"""{SPLIT_SQL}, counts AS (SELECT split, count(*) AS n FROM splits GROUP BY split)
SELECT split, CAST(n AS BIGINT) AS n, round(n * 100.0::DOUBLE / (n + CASE WHEN split = 'test'
  THEN (SELECT max(n) FROM counts WHERE split <> 'test') ELSE (SELECT n FROM counts WHERE split = 'test') END), 6) AS pct FROM counts""")
def a18(spark, d):
    return rounded(sample.split_sizes(splits(spark, d)), "pct")


CURATED = f"""WITH classed AS MATERIALIZED {cu.sql_classed("(SELECT * FROM " + cu.MASTER + " WHERE text IS NOT NULL)", "doc_id")},
kept AS MATERIALIZED (SELECT doc_id, {cu.sql_kept()} AS text FROM classed GROUP BY doc_id),
cleaned AS MATERIALIZED (SELECT m.doc_id, m.path, coalesce(k.text, '') AS text FROM {cu.MASTER} m LEFT JOIN kept k USING (doc_id)),
corpus AS MATERIALIZED (SELECT path AS doc_id, coalesce(CAST(toxic AS VARCHAR), 'unknown') AS lang, CASE WHEN toxic = 1 THEN 'toxic' ELSE 'unknown' END AS quality, length(text) AS len
  FROM (SELECT * FROM {cu.sql_staged("cleaned")} WHERE stage IS NULL) s LEFT JOIN (SELECT * FROM labels WHERE quality <> 0) l ON s.doc_id = l.doc_id),
{sql_splits("corpus", 20, (30, 60))}"""


@query("e09_curated_splits", f"""{CURATED}
SELECT split, doc_id AS path, lang AS component_type, quality AS damage_type, CAST(len AS INTEGER) AS text_length FROM splits""")
def e09(spark, d):
    curated = _curated(spark, d)
    return curated.splits.select("split", "path", "component_type", "damage_type", "text_length")


TEST_ROWS = "(SELECT * FROM splits WHERE split = 'test')"
# Table of the report: SQL over the CTEs of CURATED, its keys and its numbers.
REPORT = {
    "funnel": ("""SELECT stage, removed, n - sum(removed) OVER (ORDER BY position) AS remaining, (n - sum(removed) OVER (ORDER BY position)) * 100.0::DOUBLE / n AS retention_pct
      FROM (SELECT position, s.stage, count(r.doc_id) AS removed FROM (SELECT unnest(range(5)) AS position,
        unnest(['initial', 'missing_values', 'length_constraint', 'excluded_patterns', 'missing_keywords']) AS stage) s LEFT JOIN staged r ON r.stage = s.stage GROUP BY ALL),
      (SELECT count(*) AS n FROM staged)""", ["stage"], ["removed", "remaining", "retention_pct"]),
    "split_sizes": ("""SELECT split, n, n * 100.0::DOUBLE / (n + CASE WHEN split = 'test' THEN (SELECT max(n) FROM counts WHERE split <> 'test')
      ELSE (SELECT n FROM counts WHERE split = 'test') END) AS pct FROM counts""", ["split"], ["n", "pct"]),
    "component_types": (f"SELECT lang AS component_type, count(*) AS n, count(*) * 100.0::DOUBLE / (SELECT count(*) FROM {TEST_ROWS}) AS pct FROM {TEST_ROWS} GROUP BY lang", ["component_type"], ["n", "pct"]),
    "damage_types": (f"SELECT quality AS damage_type, count(*) AS n, count(*) * 100.0::DOUBLE / (SELECT count(*) FROM {TEST_ROWS}) AS pct FROM {TEST_ROWS} GROUP BY quality", ["damage_type"], ["n", "pct"]),
    "lengths": ("""SELECT split, count(len) AS n, avg(len) AS mean, quantile_cont(len, 0.5) AS median, stddev_samp(len) AS std, min(len) AS min, max(len) AS max
      FROM splits GROUP BY split""", ["split"], ["n", "mean", "median", "std", "min", "max"]),
    "distinct": ("SELECT split, count(DISTINCT lang) AS n_component_type, count(DISTINCT quality) AS n_damage_type FROM splits GROUP BY split", ["split"], ["n_component_type", "n_damage_type"]),
    "noise": (f"""SELECT sum(t) AS temporal_removed, sum(m) AS maintenance_removed, count(*) FILTER (t + m > 0) AS rows_affected,
        (SELECT count(*) FROM cleaned JOIN (SELECT doc_id, text AS given FROM {cu.MASTER}) USING (doc_id) WHERE given <> '' AND text = '') AS rows_emptied
      FROM (SELECT doc_id, count(*) FILTER (class = 'temporal') AS t, count(*) FILTER (class = 'maintenance') AS m, count(*) FILTER (class = 'kept') AS k
        FROM classed GROUP BY doc_id)""", [], ["temporal_removed", "maintenance_removed", "rows_affected", "rows_emptied"]),
}


@query("e06_dataset_report", f"""{CURATED}, counts AS (SELECT split, count(*) AS n FROM splits GROUP BY split),
staged AS MATERIALIZED (SELECT * FROM {cu.sql_staged("cleaned")})
{" UNION ALL ".join(sql_long(n, *made) for n, made in REPORT.items())}""")
def e06(spark, d):
    """All tables of the report in one long table."""
    tables = curation.dataset_report(_curated(spark, d), _settings())
    parts = [long_rows(n, tables[n], keys, columns) for n, (_, keys, columns) in REPORT.items()]
    return reduce(DataFrame.unionByName, parts)


def _settings():
    return curation.CurationSettings(
        path="path", text="text", temporal=cu.TEMPORAL, maintenance=cu.MAINTENANCE, sentence_end=".",
        funnel=cu.FUNNEL, test_size=20, train_sizes=(30, 60),
    )


def _curated(spark, d):
    master = cu.master(spark, d).drop("lang", "doc_id")
    return curation.curate_corpus(master, cu.metadata(spark, d), _settings())
