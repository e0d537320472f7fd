"""Parsing of judge and structurer answers with built-in regex and JSON functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gradewright import fixed_values as fv
from gradewright.functions.text import col, strip

STRICT_JSON = {"mode": "PERMISSIVE", "allowSingleQuotes": "false"}


def tagged_verdict(answer: Column | str) -> Column:
    """PASS only where the answer says `VERDICT: PASS`, else FAIL."""
    word = F.regexp_extract(col(answer), f"(?iuU){fv.VERDICT_PATTERN}", 1)
    return F.when(F.upper(word) == "PASS", "PASS").otherwise("FAIL")


def tagged_reason(answer: Column | str, high_quality: str = fv.REASON_HIGH_QUALITY,
                  unspecified: str = fv.REASON_UNSPECIFIED) -> Column:
    """5 to 80 characters after `REASON_CODE:`, else a default by verdict."""
    answer = col(answer)
    found = F.regexp_extract(answer, f"(?iudU){fv.REASON_PATTERN}", 1)
    default = F.when(tagged_verdict(answer) == "PASS", high_quality).otherwise(unspecified)
    return F.when(found != "", strip(found)).otherwise(default)


def flat_structure(answer: Column | str, values: dict[str, tuple[str, ...]] | None = None,
                   defaults: dict[str, str] | None = None) -> Column:
    """First flat JSON block as a struct; values outside the allowed set, missing
    fields and unreadable JSON give the default. Other keys are dropped."""
    values = values or fv.STRUCTURE_VALUES
    defaults = defaults or fv.STRUCTURE_DEFAULTS
    schema = ", ".join(f"{field} string" for field in defaults)
    block = F.regexp_extract(col(answer), fv.FLAT_BLOCK, 0)
    parsed = F.from_json(block, schema, STRICT_JSON)
    return F.struct(
        *[
            F.when(parsed[field].isin(*values[field]), parsed[field]).otherwise(default).alias(field)
            for field, default in defaults.items()
        ]
    )


def json_candidates(answer: Column | str, pattern: str, group: int) -> Column:
    """All texts in one kind of place that may be a JSON object."""
    return F.transform(F.regexp_extract_all(col(answer), F.lit(pattern), F.lit(group)), strip)


def json_structure(answer: Column | str) -> Column:
    """First candidate that is a JSON object with all required fields, as a
    struct; NULL if there is none. A later kind of place is searched only where
    the earlier ones give nothing."""
    schema = "damage_type string, severity string, location string, risk string, description_ja string, confidence double"

    def complete(text: Column) -> Column:
        keys = F.map_keys(F.from_json(text, "map<string,string>", STRICT_JSON))
        return F.coalesce(F.size(F.array_intersect(keys, F.array(*map(F.lit, fv.REQUIRED_FIELDS)))) == 4, F.lit(False))

    best = F.coalesce(*[F.get(F.filter(json_candidates(answer, p, g), complete), F.lit(0)) for p, g in fv.JSON_PLACES])
    parsed = F.transform(
        F.array_compact(F.array(best)),
        lambda text: F.struct(
            F.from_json(text, schema, STRICT_JSON).alias("fields"),
            F.from_json(F.get_json_object(text, "$.key_features"), "array<string>", STRICT_JSON).alias("features"),
        ),
    )

    def finish(p: Column) -> Column:
        return F.struct(
            *[p["fields"][f].alias(f) for f in fv.REQUIRED_FIELDS],
            F.coalesce(p["fields"]["description_ja"], F.lit("")).alias("description_ja"),
            F.coalesce(p["features"], F.array().cast("array<string>")).alias("key_features"),
            F.coalesce(p["fields"]["confidence"], F.lit(fv.ANSWER_CONFIDENCE)).alias("confidence"),
        )

    return F.get(F.transform(parsed, finish), F.lit(0))


def as_json(*columns: Column | str) -> Column:
    """JSON object of the columns, NULL fields kept."""
    return F.to_json(F.struct(*[col(c) for c in columns]), {"ignoreNullFields": "false"})
