"""Comparison of stages. Everything here works on one summary row per stage."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from gradewright import fixed_values as fv
from gradewright.functions.grades import lookup
from gradewright.operators import stats
from gradewright.session import cut_lineage


def in_order(*order: Column | str) -> W.WindowSpec:
    """All stages in order; a stage is one row."""
    return W.Window.partitionBy().orderBy(*order)


def stage_summary(samples: DataFrame, value: str = "cosine_similarity", stage: str = "stage") -> DataFrame:
    return stats.summary(samples, value, [stage])


def direction(step: Column) -> Column:
    return F.when(step > 0, "↑").when(step < 0, "↓").when(step == 0, "↔")


def versus_baseline(summary: DataFrame, stage: str = "stage", mean: str = "mean") -> DataFrame:
    """Difference to the first stage, in points and percent, with its direction.
    NULL for the first stage itself."""
    order = in_order(stage)
    base = F.first(mean).over(order.rowsBetween(W.Window.unboundedPreceding, W.Window.currentRow))
    later = F.row_number().over(order) > 1
    return (
        summary.withColumn("baseline_mean", base)
        .withColumn("_later", later)
        .withColumn("improvement", F.when(F.col("_later"), F.col(mean) - F.col("baseline_mean")))
        .withColumn("improvement_pct", F.try_divide(F.col("improvement"), F.col("baseline_mean")) * 100)
        .withColumn("direction", direction(F.col("improvement")))
        .drop("_later")
    )


def steps(summary: DataFrame, stage: str = "stage", mean: str = "mean") -> DataFrame:
    """Difference to the stage before."""
    return summary.withColumn("step", F.col(mean) - F.lag(mean).over(in_order(stage)))


def progression(summary: DataFrame, stage: str = "stage", mean: str = "mean", small: float = fv.PLATEAU_STEP) -> DataFrame:
    """One row: stages, average step, and whether one of the last two steps is
    smaller than `small`. Needs three stages, else both are NULL."""
    placed = steps(summary, stage, mean).withColumn("_back", F.row_number().over(in_order(F.desc(stage))))
    flat = (F.col("_back") <= 2) & (F.abs("step") < small)
    n = F.count(F.lit(1))
    return placed.agg(
        n.alias("stages"),
        F.when(n >= 3, F.avg("step")).alias("average_step"),
        F.when(n >= 3, F.coalesce(F.bool_or(flat), F.lit(False))).alias("plateau"),
    )


def best_stage(table: DataFrame, value: str = "mean", stage: str = "stage") -> DataFrame:
    """The stage of highest value, the first one on a tie."""
    place = F.row_number().over(in_order(F.desc_nulls_last(value), stage))
    return table.withColumn("_place", place).where(F.col("_place") == 1).select(stage, value)


def efficiency(summary: DataFrame, cost: Mapping[str, float] = fv.STAGE_HOURS, stage: str = "stage",
               mean: str = "mean") -> DataFrame:
    """Gain over the first stage per unit of extra cost, 0 without extra cost. The
    first stage has its mean per unit of cost. `recommended` marks the later stage
    of highest gain per extra cost."""
    order = in_order(stage)
    first = order.rowsBetween(W.Window.unboundedPreceding, W.Window.currentRow)
    costed = (
        summary.withColumn("cost", lookup(F.col(stage).cast("string"), {str(k): float(v) for k, v in cost.items()}, 0.0))
        .withColumn("_place", F.row_number().over(order))
        .withColumn("gain", F.col(mean) - F.first(mean).over(first))
        .withColumn("extra_cost", F.col("cost") - F.first("cost").over(first))
    )
    rated = costed.withColumn(
        "efficiency",
        F.when(F.col("_place") == 1, F.try_divide(F.col(mean), F.col("cost")))
        .when(F.col("extra_cost") > 0, F.col("gain") / F.col("extra_cost"))
        .otherwise(0.0),
    )
    usable = F.when((F.col("_place") > 1) & (F.col("extra_cost") > 0), F.col("efficiency"))
    top = F.row_number().over(in_order(F.desc_nulls_last(usable), stage)) == 1
    return rated.withColumn("recommended", top & usable.isNotNull()).select(
        stage, mean, "cost", "gain", "extra_cost", "efficiency", "recommended"
    )


def metric_table(summary: DataFrame, stages: Sequence, stage: str = "stage",
                 metrics: Sequence[str] = ("mean", "std", "min", "max", "median")) -> DataFrame:
    """Metrics as rows, stages as columns."""
    cells = F.array(
        *[F.struct(F.lit(i).alias("position"), F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for i, m in enumerate(metrics)]
    )
    long = summary.select(stage, F.explode(cells).alias("c")).select(stage, "c.*")
    return long.groupBy("position", "metric").pivot(stage, list(stages)).agg(F.first("v"))


def progress_report(samples: DataFrame, value: str = "cosine_similarity", stage: str = "stage",
                    tiers: Sequence[tuple[str, float]] = fv.TIERS, cost: Mapping[str, float] = fv.STAGE_HOURS) -> dict[str, DataFrame]:
    """All tables of a progress report by name."""
    # A row per stage; written out, since every table below starts from it.
    summary = cut_lineage(stage_summary(samples, value, stage))
    distribution = cut_lineage(stats.tier_distribution(samples, value, [stage], tiers))
    top = distribution.where(F.col("tier") == tiers[0][0])
    return {
        "summary": summary,
        "distribution": distribution,
        "versus_baseline": versus_baseline(summary, stage),
        "progression": progression(summary, stage),
        "best": best_stage(summary, "mean", stage),
        "most_in_top_tier": best_stage(top, "n", stage),
        "efficiency": efficiency(summary, cost, stage),
        "rollup": stats.tier_rollup(distribution, [stage], [name for name, _ in tiers[:3]]),
    }
