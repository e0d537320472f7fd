"""Tiers, rounding, clipping and category lookups."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from gradewright import fixed_values as fv
from gradewright.functions.text import col


def is_number(value: Column | str) -> Column:
    """Neither NULL nor NaN."""
    value = col(value)
    return value.isNotNull() & ~F.isnan(value)


def tier(value: Column | str, tiers: Sequence[tuple[str, float]] = fv.TIERS,
         lowest: str = fv.LOWEST_TIER) -> Column:
    """Label of the first tier whose lower bound is reached; NULL for NULL and
    NaN (Spark orders NaN above every number)."""
    value = col(value)
    label = F.when(~is_number(value), F.lit(None).cast("string"))
    for name, bound in tiers:
        label = label.when(value >= bound, name)
    return label.otherwise(lowest)


def tier_names(tiers: Sequence[tuple[str, float]] = fv.TIERS, lowest: str = fv.LOWEST_TIER) -> list[str]:
    return [name for name, _ in tiers] + [lowest]


def round_half_even(value: Column | str, digits: int = 4) -> Column:
    return F.bround(col(value), digits)


def clip_unit(value: Column | str) -> Column:
    """Value limited to [0, 1]; NULL stays NULL."""
    value = col(value)
    return F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0)))


def lookup(key: Column | str, table: Mapping, default) -> Column:
    """Value of a small driver-side table, with a default."""
    pairs = F.create_map(*[F.lit(x) for x in chain.from_iterable(table.items())])
    return F.coalesce(F.try_element_at(pairs, col(key)), F.lit(default))


def ordinal(key: Column | str, attribute: str, tables: Mapping[str, Mapping[str, int]] = fv.ORDINALS) -> Column:
    """Number of a category, 0 if unknown."""
    table = {k: float(v) for k, v in tables.get(attribute, {}).items()}
    return lookup(key, table, 0.0) if table else F.lit(0.0)
