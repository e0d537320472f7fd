"""Filters (F), joins (J) and the curation steps on documents and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradewright.catalog.registry import query, rounded, sql_strip, table
from gradewright.functions import text as tx
from gradewright.operators import curate, stats

# Sentences ending in a full stop; word parts stand for the two pattern classes.
TEMPORAL = (("thth", r"thth(ere|ing|ou)"), ("èvi", r"èvi"), ("erung", r"erung.{0,15}en"))
MAINTENANCE = (("with", r"with( the)?"), r"keit|lich", ("ción", r"(el|la)s? .{0,15}ción"))
EXCLUDED = (r"\s*$", r"[^\s]+\s*$", r"The ")
KEYWORDS = ("thon", "eau", "ung", "mente", "erin")
LOW, HIGH = 200, 5000


def master(spark, d):
    """Documents as a master table: some without text, some blank, some without path."""
    text = (
        F.when(F.col("doc_id") % 97 == 0, F.lit(None).cast("string"))
        .when(F.col("doc_id") % 89 == 0, F.lit(" 　\n"))
        .otherwise(F.col("text"))
    )
    path = F.when(F.col("doc_id") % 83 != 0, F.concat_ws("/", "source", F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))))
    return table(spark, d, "documents").select("doc_id", path.alias("path"), text.alias("text"), "lang")


MASTER = """(SELECT doc_id, lang,
  CASE WHEN doc_id % 83 <> 0 THEN source || '/' || doc_id || '.txt' END AS path,
  CASE WHEN doc_id % 97 = 0 THEN NULL WHEN doc_id % 89 = 0 THEN ' ' || chr(12288) || chr(10) ELSE text END AS text
FROM documents)"""

def sql_staged(source: str) -> str:
    """Rows of a source with the stage of the funnel that removes them."""
    return rf"""(SELECT *, CASE
  WHEN path IS NULL OR text IS NULL OR {sql_strip('text')} = '' THEN 'missing_values'
  WHEN length(text) < {LOW} OR length(text) > {HIGH} THEN 'length_constraint'
  WHEN regexp_matches({sql_strip('text')}, '^([^\s]+\s*$|The )') THEN 'excluded_patterns'
  WHEN NOT ({' OR '.join(f"contains(text, '{k}')" for k in KEYWORDS)}) THEN 'missing_keywords' END AS stage
FROM {source})"""


STAGED = sql_staged(MASTER)

FUNNEL = dict(low=LOW, high=HIGH, excluded=EXCLUDED, keywords=KEYWORDS)


@query("f01_drop_missing", f"SELECT doc_id FROM {MASTER} WHERE path IS NOT NULL AND text IS NOT NULL")
def f01(spark, d):
    return curate.drop_missing(master(spark, d), "path", "text").select("doc_id")


@query("f02_drop_blank", f"SELECT doc_id FROM {MASTER} WHERE {sql_strip('text')} <> ''")
def f02(spark, d):
    return curate.drop_blank(master(spark, d), "text").select("doc_id")


@query("f03_length_between", f"SELECT doc_id FROM documents WHERE length(text) BETWEEN {LOW} AND {HIGH}")
def f03(spark, d):
    return table(spark, d, "documents").where(F.length("text").between(LOW, HIGH)).select("doc_id")


@query("f04_excluded_patterns", rf"SELECT doc_id FROM documents WHERE NOT regexp_matches({sql_strip('text')}, '^(\s*$|[^\s]+\s*$|The )')")
def f04(spark, d):
    anchored = [f"^(?:{p})" for p in EXCLUDED]
    return table(spark, d, "documents").where(~tx.matches_any(tx.strip("text"), anchored)).select("doc_id")


@query("f05_required_keywords", "SELECT doc_id FROM documents WHERE contains(text, 'tion') OR contains(text, 'keit')")
def f05(spark, d):
    return table(spark, d, "documents").where(tx.contains_any("text", ("tion", "keit"))).select("doc_id")


@query("f06_filter_funnel", f"SELECT doc_id, path, text, CAST(length(text) AS INTEGER) AS text_length FROM {STAGED} WHERE stage IS NULL")
def f06(spark, d):
    kept, _ = curate.funnel(master(spark, d), "path", "text", **FUNNEL)
    return kept.select("doc_id", "path", "text", "text_length")


@query("f06_funnel_counts", f"""
SELECT CAST(count(*) AS BIGINT) AS initial_count,
  CAST(count(*) FILTER (stage = 'missing_values') AS BIGINT) AS missing_values,
  CAST(count(*) FILTER (stage = 'length_constraint') AS BIGINT) AS length_constraint,
  CAST(count(*) FILTER (stage = 'excluded_patterns') AS BIGINT) AS excluded_patterns,
  CAST(count(*) FILTER (stage = 'missing_keywords') AS BIGINT) AS missing_keywords,
  CAST(count(*) FILTER (stage IS NULL) AS BIGINT) AS final_count,
  CAST(count(*) FILTER (stage IS NOT NULL) AS BIGINT) AS total_removed,
  round(count(*) FILTER (stage IS NULL) * 100.0::DOUBLE / count(*), 6) AS retention_pct
FROM {STAGED}""")
def f06_counts(spark, d):
    _, counts = curate.funnel(master(spark, d), "path", "text", **FUNNEL)
    return rounded(counts, "retention_pct")


@query("a19_funnel_table", f"""
WITH removed AS (
  SELECT 0 AS position, 'initial' AS stage, 0 AS removed UNION ALL
  SELECT 1, 'missing_values', count(*) FILTER (stage = 'missing_values') FROM {STAGED} UNION ALL
  SELECT 2, 'length_constraint', count(*) FILTER (stage = 'length_constraint') FROM {STAGED} UNION ALL
  SELECT 3, 'excluded_patterns', count(*) FILTER (stage = 'excluded_patterns') FROM {STAGED} UNION ALL
  SELECT 4, 'missing_keywords', count(*) FILTER (stage = 'missing_keywords') FROM {STAGED}),
counted AS (SELECT count(*) AS n FROM documents)
SELECT CAST(position AS INTEGER) AS position, stage, CAST(removed AS BIGINT) AS removed,
  CAST(n - sum(removed) OVER (ORDER BY position) AS BIGINT) AS remaining,
  round((n - sum(removed) OVER (ORDER BY position)) * 100.0::DOUBLE / n, 6) AS retention_pct
FROM removed, counted""")
def a19(spark, d):
    _, counts = curate.funnel(master(spark, d), "path", "text", **FUNNEL)
    return rounded(curate.funnel_table(counts), "retention_pct")


@query("f07_equal_if_present", "SELECT doc_id FROM documents WHERE lang = 'en'")
def f07(spark, d):
    df = curate.equal_if_present(table(spark, d, "documents"), "lang", "en")
    return curate.equal_if_present(df, "no_such_column", "x").select("doc_id")


@query("f08_training_rows", f"SELECT doc_id FROM {MASTER} WHERE text IS NOT NULL AND length(text) >= 300")
def f08(spark, d):
    return curate.training_rows(master(spark, d), "text", 300).select("doc_id")


@query("f09_require_columns", "SELECT doc_id, text FROM documents")
def f09(spark, d):
    return curate.require_columns(table(spark, d, "documents"), "doc_id", "text").select("doc_id", "text")


ERRORS = "(SELECT CASE WHEN doc_id % 13 = 0 THEN 'ERROR: file not found' ELSE text END AS prediction FROM documents)"


@query("f11_error_summary", f"""
SELECT CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (NOT contains(prediction, 'ERROR')) AS BIGINT) AS successful,
  CAST(count(*) FILTER (contains(prediction, 'ERROR')) AS BIGINT) AS errors,
  round(avg(length(prediction)) FILTER (NOT contains(prediction, 'ERROR')), 6) AS mean_length
FROM {ERRORS}""")
def f11(spark, d):
    prediction = F.when(F.col("doc_id") % 13 == 0, "ERROR: file not found").otherwise(F.col("text"))
    df = table(spark, d, "documents").select(prediction.alias("prediction"))
    return rounded(stats.error_summary(df), "mean_length")


@query("f12_is_number", "SELECT event_id, value FROM events WHERE event_id % 7 NOT IN (0, 1) AND value IS NOT NULL AND NOT isnan(value)")
def f12(spark, d):
    from gradewright.functions.grades import is_number

    value = F.when(F.col("event_id") % 7 == 0, F.lit(float("nan"))).when(F.col("event_id") % 7 != 1, F.col("value"))
    df = table(spark, d, "events").select("event_id", value.alias("value"))
    return df.where(is_number("value"))


def manifest(spark, d):
    """Files that exist: those of documents that have a label."""
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    return docs.select(F.concat_ws("/", "source", F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("path"))


@query("f13_missing_files", f"""
SELECT doc_id, path, path IS NOT NULL AND doc_id NOT IN (SELECT doc_id FROM labels) AS file_missing FROM {MASTER}""")
def f13(spark, d):
    return curate.mark_missing_files(master(spark, d).select("doc_id", "path"), manifest(spark, d), "path")


@query("f14_missing_file_audit", f"""
SELECT CAST(count(*) AS BIGINT) AS missing, min(path) AS first_missing FROM {MASTER}
WHERE path IS NOT NULL AND doc_id NOT IN (SELECT doc_id FROM labels)""")
def f14(spark, d):
    return curate.missing_file_audit(master(spark, d), manifest(spark, d), "path")


def sql_classed(source: str, key: str) -> str:
    """Sentences of a source with their class; blank ones are left out."""
    return rf"""(SELECT {key}, position, sentence,
  CASE WHEN regexp_matches({sql_strip('sentence')}, 'thth(ere|ing|ou)|èvi|erung[^\n]{{0,15}}en') THEN 'temporal'
       WHEN regexp_matches({sql_strip('sentence')}, 'with( the)?|keit|lich|(el|la)s? [^\n]{{0,15}}ción') THEN 'maintenance' ELSE 'kept' END AS class
FROM (SELECT {key}, i AS position, p[i] || CASE WHEN i < len(p) THEN '.' ELSE '' END AS sentence
      FROM (SELECT {key}, p, unnest(generate_series(1, len(p))) AS i
            FROM (SELECT {key}, string_split(text, '.') AS p FROM {source})))
WHERE {sql_strip('sentence')} <> '')"""


def sql_kept(text: str = "sentence") -> str:
    return sql_strip(f"coalesce(string_agg({text}, '' ORDER BY position) FILTER (class = 'kept'), '')")


CLASSED = sql_classed("documents", "doc_id")


def denoised(spark, d):
    return curate.denoise(table(spark, d, "documents"), "text", TEMPORAL, MAINTENANCE, ".")


@query("x09_denoise", f"""
SELECT doc_id, {sql_kept()} AS text,
  CAST(count(*) FILTER (class = 'temporal') AS INTEGER) AS temporal,
  CAST(count(*) FILTER (class = 'maintenance') AS INTEGER) AS maintenance,
  CAST(count(*) FILTER (class = 'kept') AS INTEGER) AS kept
FROM {CLASSED} GROUP BY doc_id""")
def x09(spark, d):
    return denoised(spark, d).select("doc_id", "text", "noise.temporal", "noise.maintenance", "noise.kept")


@query("a09_denoise_totals", f"""
SELECT CAST(sum(t) AS BIGINT) AS temporal_removed, CAST(sum(m) AS BIGINT) AS maintenance_removed,
  CAST(count(*) FILTER (t + m > 0) AS BIGINT) AS rows_affected, CAST(count(*) FILTER (k = 0) AS BIGINT) AS rows_emptied
FROM (SELECT doc_id, count(*) FILTER (class = 'temporal') AS t, count(*) FILTER (class = 'maintenance') AS m,
        count(*) FILTER (class = 'kept') AS k FROM {CLASSED} GROUP BY doc_id)""")
def a09(spark, d):
    return curate.denoise_totals(denoised(spark, d))


def metadata(spark, d):
    """Labels as metadata of two quantizations."""
    labels = table(spark, d, "labels")
    return labels.select(
        F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("image"),
        F.when(F.col("quality") == 0, "Q8_0").otherwise("Q5_K_M").alias("quantization"),
        F.col("toxic").cast("string").alias("component_type"),
        F.when(F.col("toxic") == 1, "toxic").alias("damage_type"),
    )


@query("j01_merge_metadata", f"""
SELECT doc_id, path, coalesce(component_type, 'unknown') AS component_type, coalesce(damage_type, 'unknown') AS damage_type
FROM {MASTER} m LEFT JOIN (
  SELECT doc_id AS label_id, CAST(toxic AS VARCHAR) AS component_type, CASE WHEN toxic = 1 THEN 'toxic' END AS damage_type
  FROM labels WHERE quality <> 0) l ON m.path IS NOT NULL AND m.doc_id = l.label_id""")
def j01(spark, d):
    merged = curate.merge_metadata(master(spark, d), metadata(spark, d), "path")
    return merged.select("doc_id", "path", "component_type", "damage_type")


@query("j01_duplicate_keys", "SELECT source, CAST(count(*) AS BIGINT) AS n FROM documents GROUP BY source HAVING count(*) > 1")
def j01_duplicates(spark, d):
    return curate.duplicate_keys(table(spark, d, "documents"), "source")


@query("j02_u02_pool_without_test", """
SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def j02(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left_anti").select("doc_id", "lang")


@query("j05_lookup", """
SELECT o_orderkey, CAST(CASE o_orderpriority WHEN '1-URGENT' THEN 1.0 WHEN '2-HIGH' THEN 0.6 WHEN '5-LOW' THEN 0.3 ELSE 0.5 END AS DOUBLE) AS points FROM orders""")
def j05(spark, d):
    from gradewright.functions.grades import lookup

    table_of = {"1-URGENT": 1.0, "2-HIGH": 0.6, "5-LOW": 0.3}
    return table(spark, d, "orders").select("o_orderkey", lookup("o_orderpriority", table_of, 0.5).alias("points"))


@query("j07_membership", "SELECT doc_id FROM documents WHERE lang IN ('fr', 'de') AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def j07(spark, d):
    good = table(spark, d, "labels").where("quality = 1")
    return table(spark, d, "documents").where(F.col("lang").isin("fr", "de")).join(good, "doc_id", "left_semi").select("doc_id")


@query("l01_first_rows", "SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 50")
def l01(spark, d):
    return curate.first_rows(table(spark, d, "documents"), 50, "doc_id").select("doc_id", "lang")


@query("u01_union_of_splits", "SELECT doc_id, 'labelled' AS split FROM labels UNION ALL SELECT doc_id, 'all' FROM documents")
def u01(spark, d):
    labelled = table(spark, d, "labels").select("doc_id", F.lit("labelled").alias("split"))
    return labelled.unionByName(table(spark, d, "documents").select("doc_id", F.lit("all").alias("split")))


@query("u03_distinct_clauses", f"""
SELECT doc_id, CAST(len(p) AS INTEGER) AS clauses, CAST(len(list_distinct(p)) AS INTEGER) AS distinct_clauses FROM (
  SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '[.,\\n]'), lambda s: {sql_strip('s')}), lambda s: length(s) > 5) AS p FROM documents)""")
def u03(spark, d):
    parts = table(spark, d, "documents").select("doc_id", tx.clauses("text", ".,\n").alias("p"))
    return parts.select("doc_id", F.size("p").alias("clauses"), F.size(F.array_distinct("p")).alias("distinct_clauses"))
