"""Markdown of report tables. The lines are a column, so a table may have any number of rows."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _cell(df: DataFrame, name: str) -> Column:
    kind, value = df.schema[name].dataType.simpleString(), F.col(f"`{name}`")
    if kind == "boolean":
        made = F.when(value, "yes").otherwise("no")
        return F.when(value.isNull(), "-").otherwise(made)
    if kind in ("tinyint", "smallint", "int", "bigint"):
        made = F.format_number(value, 0)
    elif kind in ("float", "double"):
        made = F.format_string("%.4f", value.cast("double"))
        made = F.when(value.isNotNull(), made)
    else:
        made = F.replace(value.cast("string"), F.lit("|"), F.lit("\\|"))
    return F.coalesce(made, F.lit("-"))


def markdown_lines(df: DataFrame) -> DataFrame:
    """Lines of one Markdown table: place and line. Rows keep their order."""
    spark = df.sparkSession
    head = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    row = F.concat(F.lit("| "), F.concat_ws(" | ", *[_cell(df, c) for c in df.columns]), F.lit(" |"))
    rows = df.select(F.monotonically_increasing_id().alias("place"), row.alias("line"))
    return spark.createDataFrame([(i - 2, line) for i, line in enumerate(head)], "place long, line string").unionByName(rows)


def report_lines(title: str, tables: Mapping[str, DataFrame]) -> DataFrame:
    """Lines of a report: section, place and line; to be written, or joined if short."""
    spark = next(iter(tables.values())).sparkSession
    texts = [(0, 0, f"# {title}")]
    parts = []
    for i, (name, df) in enumerate(tables.items(), 1):
        texts += [(i, -5, ""), (i, -4, f"## {name.replace('_', ' ').capitalize()}"), (i, -3, "")]
        parts.append(markdown_lines(df).select(F.lit(i).alias("section"), "place", "line"))
    heads = spark.createDataFrame(texts, "section int, place long, line string")
    return reduce(DataFrame.unionByName, parts, heads)


def markdown_table(df: DataFrame) -> str:
    """One Markdown table as text, line by line through the driver."""
    return "\n".join(r["line"] for r in markdown_lines(df).orderBy("place").toLocalIterator())


def markdown_report(title: str, tables: Mapping[str, DataFrame]) -> str:
    """The report as text, for one that a person reads; write `report_lines` otherwise."""
    lines = report_lines(title, tables).orderBy("section", "place")
    return "\n".join(r["line"] for r in lines.toLocalIterator()) + "\n"
