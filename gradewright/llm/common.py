"""What the operators of this package share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Runs of anything but the six ASCII white-space characters.
SPACED_WORD = r"[^\x20\x09-\x0D]+"


def col(c: Column | str) -> Column:
    return F.col(f"`{c}`") if isinstance(c, str) else c


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Names like the wanted ones that no column of the table has."""
    taken = {c.lower() for c in df.columns}
    made = []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        made.append(name)
    return made


def stage(df: DataFrame, **columns: Column) -> DataFrame:
    """Add or replace columns that are computed once per row.

    A generator keeps the optimizer from copying their expressions into every
    later use, which counts here: they are arrays of all words of a text.
    """
    kept = [col(c) for c in df.columns if c.lower() not in {n.lower() for n in columns}]
    made = F.struct(*[c.alias(n) for n, c in columns.items()])
    return df.select(*kept, F.inline(F.array(made)))


def without(df: DataFrame, *names: str) -> DataFrame:
    """Columns that would clash with those an operator adds give way."""
    gone = {n.lower() for n in names}
    return df.select(*[col(c) for c in df.columns if c.lower() not in gone])
