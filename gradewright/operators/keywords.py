"""How often dictionary words occur, alone and together."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from gradewright import fixed_values as fv
from gradewright.functions.text import matching_words
from gradewright.operators.stats import share

# Neither a member nor a damage label.
NONE = ""


def _counted(df: DataFrame, text: str, members: Mapping[str, str], damages: Mapping[str, str],
             by: Sequence[str]) -> DataFrame:
    """Rows per (member, damage) pair, per member, per damage and in all, from one
    scan. A row is exploded into the pairs of its own labels, at most the size of
    the two dictionaries, and combined before the shuffle. A text in which several
    words of one label occur counts once for the label."""
    marked = df.select(
        *by,
        F.array_append(F.array_distinct(matching_words(text, members)), F.lit(NONE)).alias("_m"),
        F.array_append(F.array_distinct(matching_words(text, damages)), F.lit(NONE)).alias("_d"),
    )
    # The arrays are never empty; for a plain explode the optimizer would test
    # that first, by searching all words once more.
    pairs = marked.select(*by, F.explode_outer("_m").alias("member"), "_d").select(
        *by, "member", F.explode_outer("_d").alias("damage")
    )
    return pairs.groupBy(*by, "member", "damage").agg(F.count(F.lit(1)).alias("n"))


def frequency(df: DataFrame, text: str, words: Mapping[str, str], by: Sequence[str] = ()) -> DataFrame:
    """Texts that contain each label's word, and their percentage of all texts.
    Labels that never occur are left out."""
    counts = _counted(df, text, words, {}, by)
    whole = F.max(F.when(F.col("member") == NONE, F.col("n"))).over(W.Window.partitionBy(*by))
    return (
        counts.withColumn("pct", share(F.col("n"), whole))
        .where(F.col("member") != NONE)
        .select(*by, F.col("member").alias("label"), "n", "pct")
    )


def top_labels(counts: DataFrame, label: str, k: int, by: Sequence[str] = ()) -> DataFrame:
    """The k most frequent labels, ties in label order."""
    place = F.row_number().over(W.Window.partitionBy(*by).orderBy(F.desc("n"), label))
    return counts.withColumn("_place", place).where(F.col("_place") <= k).drop("_place")


def cooccurrence(df: DataFrame, text: str, members: Mapping[str, str] = fv.MEMBER_WORDS,
                 damages: Mapping[str, str] = fv.DAMAGE_TYPE_WORDS, k: int = fv.TOP_LABELS,
                 by: Sequence[str] = ()) -> DataFrame:
    """Texts with both words, for the k most frequent members and damages, zeros
    included, in long form. Everything follows from one scan; what comes after
    works on at most (members + 1) x (damages + 1) counts per group."""
    counts = _counted(df, text, members, damages, by)
    groups = counts.groupBy(*by).agg(
        F.collect_list(
            F.when((F.col("damage") == NONE) & (F.col("member") != NONE),
                   F.struct((-F.col("n")).alias("order"), F.col("member").alias("label")))
        ).alias("_ms"),
        F.collect_list(
            F.when((F.col("member") == NONE) & (F.col("damage") != NONE),
                   F.struct((-F.col("n")).alias("order"), F.col("damage").alias("label")))
        ).alias("_ds"),
        F.map_from_entries(
            F.collect_list(F.struct(F.concat_ws("\x00", "member", "damage").alias("key"), F.col("n").alias("value")))
        ).alias("_n"),
    )
    # The dictionaries bound the collected lists.
    grid = (
        groups.select(*by, F.explode(F.slice(F.array_sort("_ms"), 1, k)).alias("m"), "_ds", "_n")
        .select(*by, "m", F.explode(F.slice(F.array_sort("_ds"), 1, k)).alias("d"), "_n")
        .select(*by, F.col("m.label").alias("member"), F.col("d.label").alias("damage"), "_n")
    )
    both = F.try_element_at("_n", F.concat_ws("\x00", "member", "damage"))
    return grid.select(*by, "member", "damage", F.coalesce(both, F.lit(0)).cast("bigint").alias("n"))


def as_matrix(long: DataFrame, damages: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Wide form: a row per member, a column per damage."""
    return long.groupBy(*by, "member").pivot("damage", list(damages)).agg(F.first("n"))
