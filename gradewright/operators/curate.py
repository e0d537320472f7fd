"""Curation of a text corpus: denoising, filter funnel, metadata, file checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from gradewright import fixed_values as fv
from gradewright.functions import text as tx
from gradewright.functions.text import col
from gradewright.operators.stats import share
from gradewright.session import cut_lineage, settle

FUNNEL_STAGES = fv.FUNNEL_STAGES


def require_columns(df: DataFrame, *columns: str) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; there are {df.columns}")
    return df


# --- simple filters ----------------------------------------------------------

def drop_missing(df: DataFrame, *columns: str) -> DataFrame:
    return df.dropna(subset=list(columns))


def drop_blank(df: DataFrame, column: str) -> DataFrame:
    return df.where(~tx.is_blank(column))


def equal_if_present(df: DataFrame, column: str, value) -> DataFrame:
    return df.where(F.col(column) == value) if column in df.columns else df


def training_rows(df: DataFrame, text: str = fv.TEXT_COLUMN, min_length: int = fv.MIN_TRAINING_LENGTH) -> DataFrame:
    """Rows long enough to learn from."""
    return df.where(F.length(text) >= min_length)


# --- sentence denoising ------------------------------------------------------

def graded_sentences(text: Column | str, temporal: Sequence[str] = fv.TEMPORAL_PATTERNS,
                     maintenance: Sequence[str] = fv.MAINTENANCE_PATTERNS, end: str = fv.SENTENCE_END) -> Column:
    """Non-blank sentences, each with its class: temporal, maintenance or kept. A
    sentence of both classes is temporal."""
    def grade(part: Column) -> Column:
        found = (
            F.when(tx.matches_any(part["stripped"], temporal), "temporal")
            .when(tx.matches_any(part["stripped"], maintenance), "maintenance")
            .otherwise("kept")
        )
        return F.struct(part["sentence"].alias("sentence"), found.alias("class"))

    parts = F.transform(
        tx.split_keeping_end(text, end), lambda s: F.struct(s.alias("sentence"), tx.strip(s).alias("stripped"))
    )
    return F.transform(F.filter(parts, lambda p: p["stripped"] != ""), grade)


def denoise(df: DataFrame, text: str = fv.TEXT_COLUMN, temporal: Sequence[str] = fv.TEMPORAL_PATTERNS,
            maintenance: Sequence[str] = fv.MAINTENANCE_PATTERNS, end: str = fv.SENTENCE_END,
            noise: str = "noise") -> DataFrame:
    """Replace the text by its in-scope sentences, joined as they were and stripped.

    Adds a struct: sentences removed as temporal, removed as maintenance, kept,
    and whether a text that held characters is left empty. A NULL text becomes
    the empty text.
    """
    given = F.coalesce(F.col(text), F.lit(""))
    graded = settle(df, _graded=graded_sentences(given, temporal, maintenance, end))

    def of_class(name: str) -> Column:
        return F.filter("_graded", lambda g: g["class"] == name)

    clean = tx.strip(F.array_join(F.transform(of_class("kept"), lambda g: g["sentence"]), ""))
    cleaned = settle(graded, _clean=clean)
    counts = F.struct(
        *[F.size(of_class(c)).alias(c) for c in ("temporal", "maintenance", "kept")],
        ((given != "") & (F.col("_clean") == "")).alias("emptied"),
    )
    return cleaned.withColumn(noise, counts).withColumn(text, F.col("_clean")).drop("_graded", "_clean")


def denoise_totals(denoised: DataFrame, noise: str = "noise") -> DataFrame:
    """Sentences removed per class, rows touched, rows left empty."""
    temporal, maintenance = F.col(f"{noise}.temporal"), F.col(f"{noise}.maintenance")
    return denoised.agg(
        F.coalesce(F.sum(temporal), F.lit(0)).cast("bigint").alias("temporal_removed"),
        F.coalesce(F.sum(maintenance), F.lit(0)).cast("bigint").alias("maintenance_removed"),
        F.count_if(temporal + maintenance > 0).alias("rows_affected"),
        F.count_if(F.col(f"{noise}.emptied")).alias("rows_emptied"),
    )


# --- filter funnel -----------------------------------------------------------

def funnel_stage(path: Column | str, text: Column | str, low: int = fv.MIN_TEXT_LENGTH, high: int = fv.MAX_TEXT_LENGTH,
                 excluded: Sequence[str] = fv.EXCLUDED_PATTERNS, keywords: Sequence[str] = fv.REQUIRED_KEYWORDS,
                 fold_case: bool = False, blank_is_missing: bool = True) -> Column:
    """Name of the first stage that removes the row, NULL if it stays."""
    path, text = col(path), col(text)
    missing = path.isNull() | text.isNull()
    if blank_is_missing:
        missing = missing | tx.is_blank(text)
    anchored = [f"^(?:{p})" for p in excluded]
    return (
        F.when(missing, FUNNEL_STAGES[0])
        .when(~F.length(text).between(low, high), FUNNEL_STAGES[1])
        .when(tx.matches_any(tx.strip(text), anchored), FUNNEL_STAGES[2])
        .when(~tx.contains_any(text, keywords, fold_case), FUNNEL_STAGES[3])
    )


def funnel_counts(staged: DataFrame, stage: str = "funnel_stage") -> DataFrame:
    """One row of counts: rows in, removed per stage, rows left, retention. Needs
    one pass over the marked rows, whatever the number of stages."""
    n = F.count(F.lit(1))
    return staged.agg(
        n.alias("initial_count"),
        *[F.count_if(F.col(stage) == s).alias(s) for s in FUNNEL_STAGES],
        F.count_if(F.col(stage).isNull()).alias("final_count"),
    ).withColumn("total_removed", F.col("initial_count") - F.col("final_count")).withColumn(
        "retention_pct", share(F.col("final_count"), F.col("initial_count"))
    )


def funnel_table(counts: DataFrame) -> DataFrame:
    """Stages as rows, with the rows left after each and their share of the start."""
    removed = [F.lit(0).cast("bigint"), *[F.col(s) for s in FUNNEL_STAGES]]
    cells = F.array(
        *[
            F.struct(F.lit(i).alias("position"), F.lit(name).alias("stage"), gone.alias("removed"))
            for i, (name, gone) in enumerate(zip(("initial", *FUNNEL_STAGES), removed))
        ]
    )
    rows = counts.select("initial_count", F.explode(cells).alias("c")).select("initial_count", "c.*")
    left = F.col("initial_count") - F.sum("removed").over(W.Window.partitionBy().orderBy("position"))
    return rows.withColumn("remaining", left).withColumn(
        "retention_pct", share(F.col("remaining"), F.col("initial_count"))
    ).drop("initial_count")


def stage_rows(df: DataFrame, path: str = fv.PATH_COLUMN, text: str = fv.TEXT_COLUMN, **options) -> DataFrame:
    """All rows with `funnel_stage`."""
    require_columns(df, path, text)
    return settle(df, funnel_stage=funnel_stage(path, text, **options))


def passed_rows(staged: DataFrame, text: str = fv.TEXT_COLUMN) -> DataFrame:
    """Rows no stage removes, with `text_length`."""
    kept = staged.where(F.col("funnel_stage").isNull()).drop("funnel_stage")
    return kept.withColumn("text_length", F.length(text))


def funnel(df: DataFrame, path: str = fv.PATH_COLUMN, text: str = fv.TEXT_COLUMN, **options) -> tuple[DataFrame, DataFrame]:
    """Rows that pass all stages, and the counts."""
    staged = stage_rows(df, path, text, **options)
    return passed_rows(staged, text), funnel_counts(staged)


# --- metadata ----------------------------------------------------------------

def prepare_metadata(meta: DataFrame, quantization: str = fv.QUANTIZATION) -> DataFrame:
    """Metadata of one quantization, keyed by `filename`, with the attributes it has.

    Columns come under the names of METADATA_NAMES; an attribute counts only where
    the column it depends on is there.
    """
    meta = equal_if_present(meta, "quantization", quantization).withColumnsRenamed(fv.METADATA_NAMES)
    there = set(meta.columns)
    return meta.select("filename", *[a for a, needed in fv.METADATA_ATTRIBUTES.items() if {a, needed} <= there])


def fill_attributes(df: DataFrame, attributes: Mapping[str, str]) -> DataFrame:
    """Constant for NULL, and as a new column where the attribute is absent."""
    for name, value in attributes.items():
        known = F.coalesce(F.col(name).cast("string"), F.lit(value)) if name in df.columns else F.lit(value)
        df = df.withColumn(name, known)
    return df


def merge_metadata(df: DataFrame, meta: DataFrame | None, path: str = fv.PATH_COLUMN, default: str = "unknown") -> DataFrame:
    """Left join on the file name, unknown where there is no metadata.

    The metadata has a row per file and grows with the corpus, so no side is
    forced to be broadcast; adaptive execution picks by measured size and splits
    skewed partitions. A file name that repeats in the metadata repeats rows.
    """
    if meta is not None:
        df = df.withColumn("filename", tx.file_name(path)).join(prepare_metadata(meta), "filename", "left")
    return fill_attributes(df, {"component_type": default, "damage_type": default})


def duplicate_keys(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


# --- files -------------------------------------------------------------------

def mark_missing_files(df: DataFrame, manifest: DataFrame, path: str = "image_path", mark: str = "file_missing") -> DataFrame:
    """True where a path is given but not in the manifest. NULL and '' are not checked.
    Both sides are compared without scheme and host.

    The distinct paths are written out first. The join is then between two plain
    tables: broadcast if the paths are few, else with adaptive splitting of a
    path that very many rows share.
    """
    present = cut_lineage(manifest.select(tx.plain_path("path").alias("_path")).distinct()).withColumn("_present", F.lit(True))
    given = F.nullif(tx.plain_path(path), F.lit(""))
    return (
        df.withColumn("_given", given)
        .join(present, F.col("_given") == F.col("_path"), "left")
        .withColumn(mark, F.col("_given").isNotNull() & F.col("_present").isNull())
        .drop("_path", "_present", "_given")
    )


def missing_file_audit(df: DataFrame, manifest: DataFrame, path: str = "image_path") -> DataFrame:
    """Number of rows whose file is missing and the first such path. NULL and '' are
    not checked, as in `mark_missing_files`. Paths are counted first, so a path
    used by many rows is joined once."""
    uses = df.where(F.col(path) != "").groupBy(F.col(path).alias("path")).agg(F.count(F.lit(1)).alias("n"))
    uses = uses.withColumn("_given", tx.plain_path("path"))
    lost = uses.join(manifest.select(tx.plain_path("path").alias("_given")), "_given", "left_anti")
    return lost.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("missing"), F.min("path").alias("first_missing"))


# --- ids ---------------------------------------------------------------------

def positional_ids(df: DataFrame, order: str, name: str = "image_id", prefix: str = "image_", width: int = 4,
                   tie_break: Sequence[str] = ()) -> DataFrame:
    """Ids `image_0000`, `image_0001`, ... in the order of a column.

    `tie_break` names columns that order equal values. What they leave equal is ordered by
    a hash of the whole row, so the ids never depend on the partitioning, and rows that
    agree in all columns by an ordinal, so not even a value that all rows share stays in
    one partition.

    Rows are range-partitioned by all of these and written out with the number of their
    partition; each partition is numbered on its own, starting after the rows of the
    partitions before it.
    """
    whole = F.md5(F.to_json(F.struct(F.lit(0).alias("_k"), *[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"}))
    sequence = [order, *tie_break, "_whole", "_ordinal"]
    placed = df.withColumns({"_whole": whole, "_ordinal": F.monotonically_increasing_id()}).repartitionByRange(*[F.col(c) for c in sequence])
    placed = cut_lineage(placed.withColumn("_part", F.spark_partition_id()))
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    starts = sizes.select("_part", (F.sum("_n").over(W.Window.partitionBy().orderBy("_part")) - F.col("_n")).alias("_start"))
    place = F.row_number().over(W.Window.partitionBy("_part").orderBy(*sequence)) - 1
    # One row per partition: at most spark.sql.shuffle.partitions.
    numbered = placed.withColumn("_place", place).join(F.broadcast(starts), "_part")
    digits = (F.col("_start") + F.col("_place")).cast("string")
    padded = F.when(F.length(digits) < width, F.lpad(digits, width, "0")).otherwise(digits)
    return numbered.withColumn(name, F.concat(F.lit(prefix), padded)).drop("_part", "_start", "_place", "_whole", "_ordinal")


def first_rows(df: DataFrame, n: int | None, *order: str) -> DataFrame:
    """The first n rows in a stated order, or all rows."""
    return df if n is None else df.orderBy(*order).limit(n)
