"""Priority score: weighted lookups, combination bonuses, cap and level."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradewright import fixed_values as fv
from gradewright.functions.grades import lookup, round_half_even
from gradewright.functions.text import col, or_default
from gradewright.session import cut_lineage, settle

ATTRIBUTES = ("damage_type", "severity", "location", "risk")


@dataclass(frozen=True)
class ScoreRules:
    """Tables, weights, thresholds and bonuses of the score."""

    tables: Mapping[str, Mapping[str, float]] = field(default_factory=lambda: fv.SCORE_TABLES)
    weights: Mapping[str, float] = field(default_factory=lambda: fv.WEIGHTS)
    thresholds: Mapping[int, float] = field(default_factory=lambda: fv.LEVEL_THRESHOLDS)
    texts: Mapping[int, str] = field(default_factory=lambda: fv.LEVEL_TEXTS)
    # Each bonus: {"condition": {attribute: value, ...}, "bonus": number}
    bonuses: Sequence[Mapping] = ()


DEFAULT_RULES = ScoreRules()


def load_rules(spark, path: str | None) -> ScoreRules:
    """Rules from a JSON file, the defaults if there is none. A table or a weight
    the file lacks keeps its default."""
    if path is None or not _exists(spark, path):
        return DEFAULT_RULES
    (text,) = spark.read.text(path, wholetext=True).first()
    given = json.loads(text)
    tables = {a: given.get(f"{a}_scores", fv.SCORE_TABLES[a]) for a in ATTRIBUTES}
    levels = given.get("priority_thresholds", fv.LEVEL_THRESHOLDS)
    texts = given.get("priority_descriptions", fv.LEVEL_TEXTS)
    weights = {a: float(given.get("weights", {}).get(a, fv.WEIGHTS[a])) for a in ATTRIBUTES}
    return ScoreRules(
        weights=weights,
        tables=tables,
        thresholds={int(k): float(v) for k, v in levels.items()},
        texts={int(k): v for k, v in texts.items()},
        bonuses=tuple(given.get("combination_bonuses", ())),
    )


def _exists(spark, path: str) -> bool:
    try:
        spark.read.text(path, wholetext=True).schema  # noqa: B018 - resolves the path
        return True
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return False
        raise


def points(attribute: str, value: Column | str, rules: ScoreRules = DEFAULT_RULES) -> Column:
    """Table value of one attribute, 0.5 for an unlisted value."""
    table = {k: float(v) for k, v in rules.tables[attribute].items()}
    return lookup(value, table, fv.DEFAULT_POINTS)


def weighted_sum(scores: Mapping[str, Column], weights: Mapping[str, float] = fv.WEIGHTS) -> Column:
    return reduce(lambda a, b: a + b, [scores[a] * F.lit(float(weights[a])) for a in ATTRIBUTES])


def bonus(values: Mapping[str, Column | str], bonuses: Sequence[Mapping]) -> Column:
    """Sum of the bonuses whose conditions all hold; for a handful of rules."""
    total = F.lit(0.0)
    for rule in bonuses:
        holds = reduce(
            lambda a, b: a & b,
            [col(values[a]).eqNullSafe(F.lit(v)) for a, v in rule.get("condition", {}).items()],
            F.lit(True),
        )
        total = total + F.when(holds, float(rule.get("bonus", 0.0))).otherwise(0.0)
    return total


def bonus_by_table(df: DataFrame, rules: DataFrame, name: str = "bonus",
                   attributes: Sequence[str] = ATTRIBUTES) -> DataFrame:
    """Sum of the bonuses of a rules table, for any number of rules.

    A rule row constrains the attributes it has a value for. Rules are summed by what
    they constrain and written; there are at most 2 ** attributes such sets. Per set, a row
    looks its values up by equality, so no row is compared with every rule and `df` is
    read once. The size of the sums decides whether a look-up is a broadcast, which needs
    no shuffle of the rows.
    """
    given = [F.col(a).cast("string") for a in attributes]
    mask = reduce(lambda x, y: x + y, [F.when(v.isNull(), 0).otherwise(1 << i) for i, v in enumerate(given)], F.lit(0))
    keys = [f"_rule_{i}" for i in range(len(attributes))]
    sums = rules.select(mask.alias("_set"), *[v.alias(k) for v, k in zip(given, keys)], "bonus")
    sums = cut_lineage(sums.groupBy("_set", *keys).agg(F.sum("bonus").alias("_sum")))
    total = F.lit(0.0)
    out = df
    for number in sorted(r[0] for r in sums.select("_set").distinct().collect()):
        kept = [i for i in range(len(attributes)) if number >> i & 1]
        own = sums.where(F.col("_set") == number)
        if not kept:
            total = total + F.coalesce(own.select("_sum").scalar(), F.lit(0.0))
            continue
        own = own.select(*[F.col(keys[i]).alias(f"_set_{number}_{i}") for i in kept], F.col("_sum").alias(f"_sum_{number}"))
        same = [F.col(attributes[i]).cast("string") == F.col(f"_set_{number}_{i}") for i in kept]
        out = out.join(own, reduce(lambda x, y: x & y, same), "left")
        total = total + F.coalesce(F.col(f"_sum_{number}"), F.lit(0.0))
    return out.select(*[F.col(f"`{c}`") for c in df.columns if c != name], total.alias(name))


def level(score: Column | str, thresholds: Mapping[int, float] = fv.LEVEL_THRESHOLDS) -> Column:
    """Highest level whose threshold the score reaches, else 1; NULL for NULL."""
    score = col(score)
    chain = F.when(score.isNull() | F.isnan(score), F.lit(None).cast("int"))
    for number in sorted(thresholds, reverse=True):
        chain = chain.when(score >= float(thresholds[number]), number)
    return chain.otherwise(1)


def level_text(number: Column | str, texts: Mapping[int, str] = fv.LEVEL_TEXTS) -> Column:
    return lookup(number, texts, fv.LEVEL_TEXT_DEFAULT)


def score_struct(values: Mapping[str, Column | str], rules: ScoreRules = DEFAULT_RULES) -> Column:
    """Struct of score, level, text, the four component scores and the bonus."""
    scores = {a: points(a, values[a], rules) for a in ATTRIBUTES}
    extra = bonus(values, rules.bonuses)
    raw = F.least(F.lit(1.0), weighted_sum(scores, rules.weights) + extra)
    number = level(raw, rules.thresholds)
    return F.struct(
        raw.alias("raw_score"),
        number.alias("priority_level"),
        level_text(number, rules.texts).alias("priority_description"),
        *[scores[a].alias(f"{a}_score") for a in ATTRIBUTES],
        extra.alias("combination_bonus"),
    )


def score_rows(df: DataFrame, columns: Mapping[str, str] | None = None, rules: ScoreRules = DEFAULT_RULES,
               severity_default: str = "low") -> DataFrame:
    """Score every row as added columns. A NULL attribute takes its default."""
    names = columns or {a: a for a in ATTRIBUTES}
    defaults = dict.fromkeys(ATTRIBUTES, "unknown") | {"severity": severity_default}
    values = {a: F.coalesce(F.col(names[a]), F.lit(defaults[a])) for a in ATTRIBUTES}
    df = settle(
        df, **{f"{a}_score": points(a, values[a], rules) for a in ATTRIBUTES}, combination_bonus=bonus(values, rules.bonuses)
    )
    raw = weighted_sum({a: F.col(f"{a}_score") for a in ATTRIBUTES}, rules.weights)
    return (
        df.withColumn("raw_score", F.least(F.lit(1.0), raw + F.col("combination_bonus")))
        .withColumn("priority_level", level("raw_score", rules.thresholds))
        .withColumn("priority_description", level_text("priority_level", rules.texts))
    )


def score_guarded(df: DataFrame, rules: ScoreRules = DEFAULT_RULES, components: bool = True,
                  no_score: str = fv.NO_SCORE_CLASSIC) -> DataFrame:
    """Score the PASS rows of a guarded table with damage_type, severity_level,
    location and risk_factor.

    FAIL: NULL score, level 0 and a message. PASS without a structure: the same
    with another message. Empty attributes take the defaults unknown and medium.
    """
    fields = dict(zip(ATTRIBUTES, ("damage_type", "severity_level", "location", "risk_factor")))
    passed = F.col("quality_verdict") == "PASS"
    scored = passed & (F.coalesce(F.col("damage_type"), F.lit("")) != "")
    values = {a: or_default(c, "medium" if a == "severity" else "unknown") for a, c in fields.items()}
    scores = {a: points(a, values[a], rules) for a in ATTRIBUTES}
    raw = F.least(F.lit(1.0), weighted_sum(scores, rules.weights) + bonus(values, rules.bonuses))
    df = settle(df, _raw=F.when(scored, raw))
    number = F.coalesce(level("_raw", rules.thresholds), F.lit(0))
    text = F.when(scored, level_text(number, rules.texts)).when(passed, fv.RULE_ONLY_SCORE).otherwise(no_score)
    made = {"priority_score": round_half_even("_raw", 4), "priority_level": number, "priority_description": text}
    if components:
        for name, a in (("damage", "damage_type"), ("severity", "severity"), ("location", "location")):
            made[f"raw_{name}_score"] = F.when(scored, round_half_even(scores[a], 4))
    return df.withColumns(made).drop("_raw")
