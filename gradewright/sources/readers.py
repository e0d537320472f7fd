"""Readers. Schemas are given, never inferred, except where a file decides them."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradewright import fixed_values as fv
from gradewright.functions.text import SCHEME, file_name, file_stem, plain_path
from gradewright.operators.curate import require_columns


def _fields(**columns: str) -> T.StructType:
    kinds = {"string": T.StringType(), "int": T.IntegerType(), "double": T.DoubleType(), "long": T.LongType()}
    return T.StructType([T.StructField(n, kinds[k]) for n, k in columns.items()])


MASTER = _fields(**{fv.PATH_COLUMN: "string", fv.TEXT_COLUMN: "string"})
METADATA = _fields(image="string", quantization="string", component_type="string", damage_type="string")
INFERENCE = _fields(
    image_id="string", image_path="string", prediction="string", prediction_length="int",
    ground_truth="string", ground_truth_length="int", cosine_similarity="double",
)
_SPREAD = "struct<mean:double, std:double, median:double>"
EVALUATION = (
    "metadata struct<timestamp:string, model_name:string, n_samples:bigint, device:string>, "
    "overall_metrics struct<cosine_similarity:struct<mean:double, std:double, median:double, min:double, max:double, "
    f"q25:double, q75:double>, euclidean_distance:{_SPREAD}, manhattan_distance:{_SPREAD}>, "
    "per_sample_results array<struct<image_id:string, cosine_similarity:double, euclidean_distance:double, "
    "manhattan_distance:double, ground_truth_length:int, prediction_length:int>>, "
    "quality_distribution map<string, struct<count:bigint, percentage:double>>"
)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None, encoding: str = "UTF-8",
             multi_line: bool = True) -> DataFrame:
    """CSV with a header. Without a schema all columns are text under the names of
    the header. A byte order mark is dropped.

    With quoted line breaks (`multi_line`) each file is read by one task, so tables
    of many GB have to come as many files or as Parquet; files without them are
    split with `multi_line=False`.
    """
    reader = spark.read.options(header=True, multiLine=multi_line, escape='"', encoding=encoding)
    reader = reader.schema(schema) if schema is not None else reader
    return reader.csv(path)


def read_master(spark: SparkSession, path: str, path_column: str = fv.PATH_COLUMN, text_column: str = fv.TEXT_COLUMN) -> DataFrame:
    """Master table from Parquet, or from CSV by its suffix. Spreadsheets are
    converted before."""
    df = read_csv(spark, path) if path.endswith(".csv") else spark.read.parquet(path)
    return require_columns(df, path_column, text_column)


def read_evaluations(spark: SparkSession, path: str, whole_files: bool | None = None) -> DataFrame:
    """Nested evaluation results: a document per line, or one per file, which may
    then be spread over lines.

    The form is told by the lines, unless it is given. Files of the other form are
    an error, so no document is lost. A file of one document is read by one task.
    """
    if whole_files is None:
        # A line that is no object of its own belongs to a document of several lines.
        odd = spark.read.text(path).where((F.trim("value") != "") & ~F.col("value").rlike(r"^\s*\{.*\}\s*$"))
        whole_files = not odd.isEmpty()
    if not whole_files:
        return spark.read.schema(EVALUATION).option("mode", "FAILFAST").json(path)
    text = F.col("value")
    several = F.raise_error(F.lit("a file with several documents: read it by lines"))
    # Documents in a row, which an array would part by a comma.
    one = F.when(text.rlike(r"\}\s*\n\s*\{"), several).otherwise(F.from_json(text, EVALUATION, {"mode": "FAILFAST"}))
    return spark.read.text(path, wholetext=True).where(F.trim(text) != "").select(one.alias("d")).select("d.*")


def file_manifest(spark: SparkSession, folder: str, pattern: str = "*.png", root: str | None = None) -> DataFrame:
    """Files of a folder and its partition folders by pattern: path, name, stem and length.

    Paths have no scheme; with `root` they are relative to it. Contents are not
    read, since the column is not selected.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    path = F.regexp_replace("path", SCHEME, "")  # no address: its percent signs stand for themselves
    if root is not None:
        base = plain_path(F.lit(root.rstrip("/") + "/"))
        path = F.when(F.startswith(path, base), F.substring(path, F.length(base) + 1, F.length(path))).otherwise(path)
    listed = files.select(path.alias("path"), "length")
    return listed.select("path", file_name("path").alias("name"), file_stem("path").alias("stem"), "length")


def per_sample_scores(spark: SparkSession, evaluation: str, table: str | None = None, whole_files: bool | None = None) -> DataFrame:
    """Non-NULL cosine scores from the per-sample arrays of an evaluation, or, where
    those are empty, from the first column of a CSV table named like `cosine`."""
    samples = read_evaluations(spark, evaluation, whole_files).select(F.explode("per_sample_results").alias("s"))
    scores = samples.select(F.col("s.cosine_similarity").alias("cosine_similarity"))
    if samples.isEmpty():
        if table is None:
            return scores
        rows = read_csv(spark, table)
        named = [c for c in rows.columns if "cosine" in c.lower()]
        if not named:
            return scores
        scores = rows.select(F.col(f"`{named[0]}`").try_cast("double").alias("cosine_similarity"))
    return scores.where(F.col("cosine_similarity").isNotNull())


def read_stages(spark: SparkSession, paths: Mapping[str, str], read=None) -> DataFrame:
    """All stages in one table with their name as `stage`. A stage without a file
    is skipped; with none at all the call fails."""
    read = read or (lambda path: spark.read.parquet(path))
    found = None
    for stage, path in paths.items():
        try:
            df = read(path).withColumn("stage", F.lit(stage))
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            continue
        found = df if found is None else found.unionByName(df, allowMissingColumns=True)
    if found is None:
        raise ValueError(f"no stage found in {dict(paths)}")
    return found
