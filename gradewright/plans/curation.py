"""The whole curation of a paired corpus, from the master table to its splits."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradewright import fixed_values as fv
from gradewright.operators import curate, sample, stats
from gradewright.session import cut_lineage

STRATA = ("component_type", "damage_type")


@dataclass(frozen=True)
class CurationSettings:
    path: str = fv.PATH_COLUMN
    text: str = fv.TEXT_COLUMN
    temporal: Sequence[str] = fv.TEMPORAL_PATTERNS
    maintenance: Sequence[str] = fv.MAINTENANCE_PATTERNS
    sentence_end: str = fv.SENTENCE_END
    denoise: bool = True
    funnel: dict = field(default_factory=dict)
    test_size: int = fv.TEST_SIZE
    train_sizes: Sequence[int] = fv.TRAIN_SIZES
    seed: int = fv.SEED


@dataclass(frozen=True)
class Curated:
    splits: DataFrame
    noise: DataFrame | None
    funnel: DataFrame


def curate_corpus(master: DataFrame, metadata: DataFrame | None = None,
                  settings: CurationSettings = CurationSettings()) -> Curated:
    """Denoise, filter, add metadata, hold out a test set, draw the train sets.

    The path is the key of a row. The denoised and staged rows are written out once;
    the noise and funnel counts read their few columns from there, and nothing
    repeats the sentence work. The rows with metadata are written out too, so the
    passes of the sampler do not repeat the join.
    """
    s = settings
    curate.require_columns(master, s.path, s.text)
    df = curate.denoise(master, s.text, s.temporal, s.maintenance, s.sentence_end) if s.denoise else master
    staged = cut_lineage(curate.stage_rows(df, s.path, s.text, **s.funnel))
    noise = curate.denoise_totals(staged) if s.denoise else None
    counts = curate.funnel_counts(staged)
    kept = curate.passed_rows(staged.drop("noise"), s.text)
    corpus = curate.merge_metadata(kept, metadata, s.path)
    if metadata is not None:
        corpus = cut_lineage(corpus)
    test, pool = sample.hold_out(corpus, s.test_size, STRATA, s.path, s.seed)
    trains = sample.training_sets(pool, s.train_sizes, STRATA, s.path, s.seed)
    named = trains.withColumn("split", F.concat(F.lit("train_"), F.col("train_size").cast("string"))).drop("train_size")
    # Written once: whoever reads the splits does not draw them again.
    return Curated(cut_lineage(test.withColumn("split", F.lit("test")).unionByName(named)), noise, counts)


def dataset_report(curated: Curated, settings: CurationSettings = CurationSettings(), test: str = "test") -> dict[str, DataFrame]:
    """All tables of the dataset report by name."""
    splits = curated.splits
    held = splits.where(F.col("split") == test)
    tables = {
        "funnel": curate.funnel_table(curated.funnel),
        "split_sizes": sample.split_sizes(splits, "split", test),
        "component_types": stats.count_by(held, "component_type"),
        "damage_types": stats.count_by(held, "damage_type"),
        "lengths": stats.length_summary(splits, F.length(settings.text), ["split"]),
        "distinct": stats.distinct_counts(splits, *STRATA, by=["split"]),
    }
    if curated.noise is not None:
        tables["noise"] = curated.noise
    return tables
