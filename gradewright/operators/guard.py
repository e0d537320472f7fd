"""Quality guards: PASS or FAIL with a reason, from ordered rules on the text.

A guard adds columns; it never shuffles, except for the optional file check and
the optional table of judge answers.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradewright import fixed_values as fv
from gradewright.functions import answers as an
from gradewright.functions import text as tx
from gradewright.functions.repeats import repeated_block
from gradewright.operators.curate import mark_missing_files
from gradewright.session import settle


@dataclass(frozen=True)
class GuardRules:
    """Vocabulary and thresholds of the rule guard with duplicate tests."""

    low: int = fv.CLASSIC_LOW_TOKENS
    damage_words: Sequence[str] = fv.DAMAGE_WORDS
    vague_words: Sequence[str] = fv.VAGUE_WORDS
    clause_delimiters: str = fv.CLAUSE_DELIMITERS
    smallest_block: int = fv.MIN_BLOCK
    across_lines: bool = False
    answer_by_pattern: bool = True
    test_blocks: bool = True


CLASSIC_RULES = GuardRules(
    damage_words=fv.CLASSIC_DAMAGE_WORDS,
    vague_words=fv.CLASSIC_VAGUE_WORDS,
    across_lines=True,
    answer_by_pattern=False,
)
BATCH_RULES = GuardRules()


def calibrated_reason(text: Column, tokens: Column, low: int = fv.LOW_TOKENS, high: int = fv.HIGH_TOKENS,
                      damage_words: Sequence[str] = fv.DAMAGE_WORDS,
                      vague_words: Sequence[str] = fv.VAGUE_WORDS) -> Column:
    """Reason by length first, then by vocabulary."""
    damage = tx.contains_any(text, damage_words)
    return (
        F.when(tokens < low, fv.REASON_TOO_SHORT)
        .when(tokens > high, fv.REASON_TOO_LONG)
        .when(damage, fv.REASON_HIGH_QUALITY)
        .when(tx.contains_any(text, vague_words), fv.REASON_NOT_RECOGNIZED)
        .otherwise(fv.REASON_NO_DAMAGE)
    )


def calibrated_guard(df: DataFrame, text: str = "assistant_text", **options) -> DataFrame:
    """Add token_count, quality_verdict and reason_code. A NULL text counts as
    empty: it has 0 tokens and is too short."""
    given = F.coalesce(F.col(text), F.lit(""))
    counted = settle(df, token_count=tx.token_count(given))
    judged = settle(counted, reason_code=calibrated_reason(given, F.col("token_count"), **options))
    passed = F.col("reason_code") == fv.REASON_HIGH_QUALITY
    return judged.withColumn("quality_verdict", F.when(passed, "PASS").otherwise("FAIL"))


def add_rule_reason(df: DataFrame, text: str, tokens: str, rules: GuardRules = CLASSIC_RULES,
                    name: str = "rule_reason", checked: Column | None = None) -> DataFrame:
    """Add the FAIL reason of the rules, NULL where the text passes them all.

    The block test runs in Python. It gets only texts the cheap rules leave
    undecided, NULL for all others, so their characters stay in the JVM.
    `checked` limits the rules to some rows, the others pass.
    """
    long_enough = F.col(tokens) >= rules.low
    applies = F.lit(True) if checked is None else checked
    df = settle(
        df,
        _applies=applies,
        _damage=tx.contains_any(text, rules.damage_words),
        _dirty=applies & long_enough & tx.has_duplicate_clause(text, rules.clause_delimiters),
    )
    dirty = F.col("_dirty")
    if rules.test_blocks:
        undecided = F.when(F.col("_applies") & long_enough & ~F.col("_dirty"), F.col(text))
        df = df.withColumn("_block", repeated_block(undecided, rules.smallest_block, rules.across_lines))
        dirty = dirty | F.coalesce(F.col("_block"), F.lit(False))
    reason = (
        F.when(~F.col("_applies"), F.lit(None).cast("string"))
        .when(~long_enough & ~F.col("_damage"), fv.REASON_NOT_RECOGNIZED)
        .when(~long_enough, fv.REASON_SHORT)
        .when(dirty, fv.REASON_DIRTY)
        .when(~F.col("_damage") & tx.contains_any(text, rules.vague_words), fv.REASON_NOT_RECOGNIZED)
    )
    return settle(df, **{name: reason}).drop("_applies", "_damage", "_dirty", "_block")


def answer_text(prediction: str, rules: GuardRules = CLASSIC_RULES) -> Column:
    return tx.answer_after_pattern(prediction) if rules.answer_by_pattern else tx.answer_after_marker(prediction)


def rule_guard(df: DataFrame, prediction: str = "prediction", rules: GuardRules = CLASSIC_RULES,
               manifest: DataFrame | None = None, path: str = "image_path") -> DataFrame:
    """Rules only: add assistant_text, token_count, quality_verdict, reason_code,
    rule_triggered and llm_used.

    With a manifest of existing files, a row whose path is missing fails first,
    with 0 tokens. A NULL prediction counts as empty, so it fails the rules.
    """
    if manifest is not None:
        df = mark_missing_files(df, manifest, path)
    else:
        df = df.withColumn("file_missing", F.lit(False))
    missing = F.col("file_missing")
    df = settle(df, assistant_text=F.coalesce(answer_text(prediction, rules), F.lit("")))
    df = settle(df, token_count=F.when(missing, 0).otherwise(tx.token_count("assistant_text")))
    df = add_rule_reason(df, "assistant_text", "token_count", rules, "_rule", ~missing)
    failed = F.when(missing, fv.REASON_MISSING_FILE).otherwise(F.col("_rule"))
    return df.withColumns({
        "quality_verdict": F.when(failed.isNull(), "PASS").otherwise("FAIL"),
        "reason_code": F.coalesce(failed, F.lit(fv.REASON_RULE_ONLY)),
        "rule_triggered": failed.isNotNull(),
        "llm_used": F.lit(False),
    }).drop("_rule", "file_missing")


def apply_answers(guarded: DataFrame, answers: DataFrame, key: str, values=None, defaults=None) -> DataFrame:
    """Let a judge decide the rows the rules passed.

    `answers` has the key, `judge_answer` and `structure_answer`. A FAIL keeps
    the judge's reason; a PASS gets the attributes of its structure answer.
    `fallback_used` is true where that answer had no readable JSON, so all
    attributes are defaults. A passed row without an answer stays rule-only.

    Of several answers to a key the one whose judge answer sorts first counts, a
    missing one last; `curate.duplicate_keys(answers, key)` reports them.
    """
    defaults = defaults or fv.STRUCTURE_DEFAULTS
    order = F.struct(F.col("judge_answer").isNull(), "judge_answer", "structure_answer")
    single = answers.where(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(F.struct("judge_answer", "structure_answer"), order).alias("_answer"))
    joined = guarded.join(single.select(key, "_answer.*"), key, "left")
    judged = (F.col("quality_verdict") == "PASS") & F.col("judge_answer").isNotNull()
    joined = settle(joined, _judged=judged, _verdict=F.when(judged, an.tagged_verdict("judge_answer")))
    passed = F.col("_verdict") == "PASS"
    structure = F.coalesce("structure_answer", F.lit(""))
    block = F.regexp_extract(structure, fv.FLAT_BLOCK, 0)
    readable = F.from_json(block, "map<string,string>", an.STRICT_JSON).isNotNull() & (block != "")
    joined = settle(
        joined,
        _structure=F.when(passed, an.flat_structure(structure, values, defaults)),
        fallback_used=F.when(passed, ~readable),
        _reason=F.when(passed, fv.REASON_HIGH_QUALITY)
        .when(F.col("_judged"), an.tagged_reason("judge_answer"))
        .otherwise(F.col("reason_code")),
    )
    return joined.withColumns({
        **{field: F.col("_structure")[field] for field in defaults},
        "reason_code": F.col("_reason"),
        "quality_verdict": F.coalesce("_verdict", "quality_verdict"),
        "llm_used": F.col("_judged"),
    }).drop("_judged", "_verdict", "_structure", "_reason", "judge_answer", "structure_answer")


def guard_struct(guarded: DataFrame, name: str = "guard") -> DataFrame:
    """Guard columns as one struct column."""
    fields = ["quality_verdict", "reason_code", "token_count", "rule_triggered", "llm_used"]
    return guarded.withColumn(name, F.struct(*[F.col(f) for f in fields])).drop(*fields)
