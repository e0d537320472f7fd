"""Incremental runs over a folder that keeps growing."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_folder_stream(spark: SparkSession, folder: str, schema: T.StructType | str, pattern: str = "*.parquet",
                       files_per_batch: int | None = None) -> DataFrame:
    """Stream of the Parquet files of a folder."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def read_table_stream(spark: SparkSession, table: str, schema: T.StructType | str, files_per_batch: int | None = None) -> DataFrame:
    """Stream of a Parquet table, be it one file or a folder of part files.

    Part files may have any name, as in batch reading. The path's last character is made a
    pattern, which only it matches, since a stream refuses a plain path to a file.
    """
    path = table.rstrip("/")
    return read_folder_stream(spark, f"{path[:-1]}[{path[-1]}]", schema, "*", files_per_batch)


def run_incrementally(stream: DataFrame, transform: Callable[[DataFrame], DataFrame], output: str, checkpoint: str) -> None:
    """Process everything not yet processed, then stop. A killed run resumes from
    its checkpoint; every input file enters the output exactly once. The transform
    is the same function a batch run uses."""
    query = (
        transform(stream)
        .writeStream.format("parquet")
        .option("path", output)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def run_counters(stream: DataFrame, by: Sequence[str], output: str, checkpoint: str) -> None:
    """Running counts per value, as a snapshot numbered by its batch.

    A batch is counted by itself and added to the snapshot before it, so the stream holds
    no state. A new snapshot is written whole, then the pointer moves to it, then older
    ones but the last go: any number of batches leaves two. A stop between these steps
    loses nothing and counts nothing twice, since a batch that is run again starts from the
    snapshot before its own number. `latest_counters` reads the snapshot pointed to; where
    no batch has come yet, an empty one, which the first batch replaces.
    """

    def keep(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        counts = batch.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
        before = [v for v in _versions(spark, output) if v < number]
        if before:
            known = spark.read.schema(counts.schema).parquet(f"{output}/{_SNAPSHOT}{max(before)}")
            counts = known.unionByName(counts).groupBy(*by).agg(F.sum("n").alias("n"))
        counts.write.mode("overwrite").parquet(f"{output}/{_SNAPSHOT}{number}")
        _point(spark, output, number)
        for old in sorted(before)[:-1]:
            _delete(spark, f"{output}/{_SNAPSHOT}{old}")

    query = (
        stream.select(*by).writeStream.foreachBatch(keep)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    spark = stream.sparkSession
    if not _versions(spark, output):
        keep(spark.createDataFrame([], stream.select(*by).schema), 0)


def latest_counters(spark: SparkSession, output: str) -> DataFrame:
    """The counters of the snapshot that the pointer names; of the last finished one, should a
    stop have come while the pointer was replaced."""
    files, place = _files(spark, f"{output}/{_POINTER}")
    number = spark.read.text(f"{output}/{_POINTER}").first()[0] if files.exists(place) else max(_versions(spark, output))
    return spark.read.parquet(f"{output}/{_SNAPSHOT}{number}")


_SNAPSHOT, _POINTER = "snapshot-", "current"


def _files(spark: SparkSession, path: str):
    """The file system of a path, and the path in its own form."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def _versions(spark: SparkSession, output: str) -> list[int]:
    """Numbers of the finished snapshots; there are few."""
    files, place = _files(spark, output)
    if not files.exists(place):
        return []
    found = [(status.getPath().getName(), status.getPath().toString()) for status in files.listStatus(place)]
    names = [(name.removeprefix(_SNAPSHOT), path) for name, path in found if name.startswith(_SNAPSHOT)]
    return [int(n) for n, path in names if n.isdigit() and files.exists(_files(spark, f"{path}/_SUCCESS")[1])]


def _point(spark: SparkSession, output: str, number: int) -> None:
    """Name a snapshot in the pointer, by replacing the file whole."""
    files, fresh = _files(spark, f"{output}/_{_POINTER}-{number}")
    out = files.create(fresh, True)
    out.write(bytearray(str(number), "ascii"))
    out.close()
    _, place = _files(spark, f"{output}/{_POINTER}")
    if not files.rename(fresh, place):
        files.delete(place, False)  # where a rename does not replace
        files.rename(fresh, place)


def _delete(spark: SparkSession, path: str) -> None:
    files, place = _files(spark, path)
    files.delete(place, True)


BUCKETS = 256


def mark_done(done: DataFrame, folder: str, *keys: str, buckets: int = BUCKETS) -> None:
    """Add finished keys to a folder of hash buckets."""
    marked = done.select(*keys).distinct().withColumn("bucket", _bucket(keys, buckets))
    marked.repartition("bucket").write.mode("append").partitionBy("bucket").parquet(folder)


def skip_marked(inputs: DataFrame, folder: str, *keys: str, buckets: int = BUCKETS) -> DataFrame:
    """Inputs whose key has not been marked by `mark_done` with as many buckets.

    Only the buckets that inputs fall into are read; a folder that does not exist yet
    marks nothing. A NULL key is never marked.
    """
    spark = inputs.sparkSession
    files, place = _files(spark, folder)
    if not files.exists(place):
        return inputs
    touched = [r[0] for r in inputs.select(_bucket(keys, buckets).alias("b")).distinct().collect()]  # at most `buckets`
    done = spark.read.parquet(folder).where(F.col("bucket").isin(touched))
    return inputs.join(done.select(*keys).distinct(), list(keys), "left_anti")


def _bucket(keys: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def skip_done(inputs: DataFrame, done: DataFrame, *keys: str) -> DataFrame:
    """Inputs whose key is not in the output yet."""
    return inputs.join(done.select(*keys), list(keys), "left_anti")
