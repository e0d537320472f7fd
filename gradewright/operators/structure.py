"""Attributes of a text from ordered keyword rules or from JSON answers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradewright import fixed_values as fv
from gradewright.functions import answers as an
from gradewright.functions import text as tx
from gradewright.functions.grades import lookup
from gradewright.functions.text import col
from gradewright.session import settle

Rules = Sequence[tuple[str, Sequence[Sequence[str]]]]


def rule_holds(text: Column, alternatives: Sequence[Sequence[str]], folded: Column | None = None) -> Column:
    """True if all words of one alternative occur. ASCII words are looked up in
    the folded text, if one is given."""

    def found(word: str) -> Column:
        place = folded if folded is not None and word.isascii() else text
        return place.contains(word)

    return reduce(
        lambda a, b: a | b,
        [reduce(lambda a, b: a & b, [found(w) for w in words]) for words in alternatives],
    )


def first_rule(text: Column | str, rules: Rules, default: str, fold_ascii: bool = False) -> Column:
    """Label of the first rule that holds."""
    text = col(text)
    folded = F.lower(text) if fold_ascii else None
    label = reduce(
        lambda chain, rule: chain.when(rule_holds(text, rule[1], folded), rule[0]), rules, F.when(F.lit(False), "")
    )
    return label.otherwise(default)


def keyword_structure(text: Column | str, types: Rules = fv.TYPE_RULES, severities: Rules = fv.SEVERITY_RULES,
                      locations: Rules = fv.LOCATION_RULES, risks: Mapping[str, str] = fv.RISK_OF_TYPE) -> Column:
    """Struct of damage type, severity, location and the risk that follows from
    the type."""
    damage = first_rule(text, types, "unknown")
    return F.struct(
        damage.alias("damage_type"),
        first_rule(text, severities, "medium").alias("severity_level"),
        first_rule(text, locations, "unknown").alias("location"),
        lookup(damage, risks, "unknown").alias("risk_factor"),
    )


def add_keyword_structure(df: DataFrame, text: str = "assistant_text", **rules) -> DataFrame:
    """keyword_structure as four columns, each rule evaluated once."""
    df = settle(
        df,
        damage_type=first_rule(text, rules.get("types", fv.TYPE_RULES), "unknown"),
        severity_level=first_rule(text, rules.get("severities", fv.SEVERITY_RULES), "medium"),
        location=first_rule(text, rules.get("locations", fv.LOCATION_RULES), "unknown"),
    )
    return df.withColumn("risk_factor", lookup("damage_type", rules.get("risks", fv.RISK_OF_TYPE), "unknown"))


def bilingual_structure(text: Column | str, types: Rules = fv.BILINGUAL_TYPE_RULES,
                        severities: Rules = fv.BILINGUAL_SEVERITY_RULES,
                        locations: Rules = fv.BILINGUAL_LOCATION_RULES, risks: Rules = fv.BILINGUAL_RISK_RULES,
                        features: Rules = fv.FEATURE_RULES) -> Column:
    """Struct of attributes, the text, the features found and a fixed confidence."""
    text = col(text)
    found = F.array(*[F.when(rule_holds(text, words), F.lit(label)) for label, words in features])
    return F.struct(
        first_rule(text, types, "unknown", fold_ascii=True).alias("damage_type"),
        first_rule(text, severities, "low").alias("severity"),
        first_rule(text, locations, "unknown", fold_ascii=True).alias("location"),
        first_rule(text, risks, "aesthetic").alias("risk"),
        text.alias("description_ja"),
        F.array_compact(found).alias("key_features"),
        F.lit(fv.RULE_CONFIDENCE).alias("confidence"),
    )


def structure_with_fallback(answer: Column | str, text: Column | str, **rules) -> Column:
    """The answer's JSON if it is complete, else the bilingual rules on the text."""
    return F.coalesce(an.json_structure(answer), bilingual_structure(text, **rules))


def structure_batch(df: DataFrame, text: str, answer: str | None = None, name: str = "structure", **rules) -> DataFrame:
    """Structure every row; NULL for a NULL text."""
    made = bilingual_structure(text, **rules) if answer is None else structure_with_fallback(answer, text, **rules)
    return settle(df, **{name: F.when(F.col(text).isNotNull(), made)})
