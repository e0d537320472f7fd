"""Whole grading runs: guard, structure, score. Each is one narrow pass over the
inference results, apart from the optional joins of the rule guard."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradewright import fixed_values as fv
from gradewright.functions import text as tx
from gradewright.operators import guard, score, structure
from gradewright.operators.curate import require_columns
from gradewright.session import settle

STRUCTURE_COLUMNS = ("damage_type", "severity_level", "location", "risk_factor")


def _cosine(df: DataFrame) -> DataFrame:
    return df if "cosine_similarity" in df.columns else df.withColumn("cosine_similarity", F.lit(None).cast("double"))


def grade_by_keywords(inference: DataFrame, guard_options: dict | None = None, structure_rules: dict | None = None,
                      rules: score.ScoreRules = score.DEFAULT_RULES, columns: Sequence[str] = fv.SCORED_14) -> DataFrame:
    """Calibrated guard, keyword structure and score: 14 columns, no shuffle.

    With fewer `columns`, rules that none of them needs do not run: costly columns
    are computed behind generators, which the optimizer does not prune.
    """
    df = _cosine(require_columns(inference, "image_id", "image_path", "prediction"))
    df = settle(df, assistant_text=F.coalesce(tx.answer_after_pattern("prediction"), F.lit("")))
    df = guard.calibrated_guard(df, "assistant_text", **(guard_options or {}))
    if set(columns) <= {*df.columns}:
        return df.select(*columns)
    df = structure.add_keyword_structure(df, "assistant_text", **(structure_rules or {}))
    passed = F.col("quality_verdict") == "PASS"
    df = df.withColumns({c: F.when(passed, F.col(c)) for c in STRUCTURE_COLUMNS})
    df = score.score_guarded(df, rules, components=False, no_score=fv.NO_SCORE)
    return df.select(*columns)


def grade_with_answers(inference: DataFrame, answers: DataFrame | None = None, manifest: DataFrame | None = None,
                       guard_rules: guard.GuardRules = guard.BATCH_RULES,
                       rules: score.ScoreRules = score.DEFAULT_RULES, key: str = "image_id") -> DataFrame:
    """Rule guard, judge answers where given, and score: 22 columns.

    `guard_elapsed_sec` is NULL: rows are evaluated column-wise, so there is no
    time of a single row. `assistant_text` is filled for rows of missing files too.
    """
    df = _cosine(require_columns(inference, key, "image_path", "prediction", "ground_truth"))
    df = guard.rule_guard(df, "prediction", guard_rules, manifest)
    if answers is not None:
        df = guard.apply_answers(df, answers, key)
    else:
        df = df.withColumns({c: F.lit(None).cast("string") for c in STRUCTURE_COLUMNS})
    df = score.score_guarded(df, rules, components=True)
    df = df.withColumn("guard_elapsed_sec", F.lit(None).cast("double"))
    extra = ["fallback_used"] if answers is not None else []
    return df.select(*fv.SCORED_22, *extra)


def flat_report(results: DataFrame, limit: int = 200) -> DataFrame:
    """Report rows of nested results: image_name, structure, score, description,
    processing_time, status. Rows in error have NULL attributes."""
    good = F.col("status") == "success"

    def when_good(value, name: str):
        return F.when(good, value).alias(name)

    return results.select(
        "image_name",
        *[when_good(F.col(f"structure.{c}"), c) for c in ("damage_type", "severity", "location", "risk")],
        when_good(F.col("score.raw_score"), "priority_score"),
        when_good(F.col("score.priority_level"), "priority_level"),
        when_good(F.col("score.priority_description"), "priority_description"),
        when_good(tx.shorten("description", limit), "description"),
        "processing_time",
        "status",
    )


def nested_results(df: DataFrame, path: str, description: str, structure_rules: dict | None = None,
                   rules: score.ScoreRules = score.DEFAULT_RULES) -> DataFrame:
    """Structure and score each described file into nested columns. A file without
    a description is an error row."""
    made = structure.structure_batch(df, description, name="structure", **(structure_rules or {}))
    values = {a: F.col(f"structure.{a}") for a in score.ATTRIBUTES}
    good = F.col(description).isNotNull()
    return made.select(
        F.col(path).alias("image_path"),
        tx.file_name(path).alias("image_name"),
        F.coalesce(F.col(description), F.lit("")).alias("description"),
        "structure",
        F.when(good, score.score_struct(values, rules)).alias("score"),
        F.when(good, "success").otherwise("error").alias("status"),
        F.when(~good, "no description").alias("error"),
        F.lit(None).cast("double").alias("processing_time"),
    )
