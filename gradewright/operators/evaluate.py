"""Pairwise evaluation of predictions against the ground truth by their vectors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradewright import fixed_values as fv
from gradewright.functions import vectors as vec
from gradewright.operators import stats

OVERALL = {
    "cosine_similarity": ("mean", "std", "median", "min", "max", "q25", "q75"),
    "euclidean_distance": ("mean", "std", "median"),
    "manhattan_distance": ("mean", "std", "median"),
}


def alignment_report(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys on both sides, on one side only, and repeated on a side.

    Both sides are counted per key in one aggregation, so a hot key is combined
    before the shuffle and nothing is joined.
    """
    sides = left.select(key, F.lit(1).alias("_l"), F.lit(0).alias("_r")).unionByName(
        right.select(key, F.lit(0).alias("_l"), F.lit(1).alias("_r"))
    )
    per_key = sides.groupBy(key).agg(F.sum("_l").alias("l"), F.sum("_r").alias("r"))
    return per_key.agg(
        F.count_if((F.col("l") > 0) & (F.col("r") > 0)).alias("matched"),
        F.count_if(F.col("r") == 0).alias("left_only"),
        F.count_if(F.col("l") == 0).alias("right_only"),
        F.count_if((F.col("l") > 1) | (F.col("r") > 1)).alias("repeated"),
    )


def align(truth: DataFrame, predictions: DataFrame, key: str) -> DataFrame:
    """Pair truth and prediction by key; other columns must differ in name."""
    return truth.join(predictions, key)


def pair_metrics(df: DataFrame, truth_vector: str, prediction_vector: str) -> DataFrame:
    """Add cosine similarity, euclidean and manhattan distance."""
    return df.withColumn("_m", vec.all_metrics(truth_vector, prediction_vector)).select("*", "_m.*").drop("_m")


def evaluate(pairs: DataFrame, key: str, truth_vector: str = "truth_vector", prediction_vector: str = "prediction_vector",
             truth: str | None = "ground_truth", prediction: str | None = "prediction", by: Sequence[str] = ()) -> DataFrame:
    """Per-sample table: key, three metrics and, where texts are given, lengths."""
    lengths = [F.length(c).alias(n) for c, n in ((truth, "ground_truth_length"), (prediction, "prediction_length")) if c]
    return pair_metrics(pairs, truth_vector, prediction_vector).select(*by, key, *vec.METRICS, *lengths)


def overall_metrics(samples: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One wide row per group: the statistics of each metric."""
    found = stats.summaries(samples, {f"{m}_": m for m in OVERALL}, by)
    kept = [f"{m}_{s}" for m, names in OVERALL.items() for s in names]
    return found.select(*by, F.col("cosine_similarity_n").alias("n"), *kept)


def evaluation_json(samples: DataFrame, tiers: Sequence[tuple[str, float]] = fv.TIERS, model_name: str = "") -> DataFrame:
    """The overall result as one JSON text: metadata, overall metrics and tiers.
    Per-sample rows stay a table of their own."""
    overall = overall_metrics(samples, ())
    grouped = overall.select(
        F.col("n"),
        F.struct(
            *[F.struct(*[F.col(f"{m}_{k}").alias(k) for k in kept]).alias(m) for m, kept in OVERALL.items()]
        ).alias("overall_metrics"),
    )
    cells = stats.tier_distribution(samples, "cosine_similarity", tiers=tiers).groupBy().agg(
        F.map_from_entries(
            F.array_sort(F.collect_list(F.struct("tier", F.struct(F.col("n").alias("count"), F.col("pct").alias("percentage")))))
        ).alias("quality_distribution")
    )
    joined = stats.join_groups(grouped, cells, ())
    metadata = F.struct(F.lit(model_name).alias("model_name"), F.col("n").alias("n_samples"))
    whole = F.struct(metadata.alias("metadata"), "overall_metrics", "quality_distribution")
    return joined.select(F.to_json(whole, {"ignoreNullFields": "false"}).alias("evaluation"))
