"""Session settings and the shared folder for checkpoints and written tables."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, tempfile.TemporaryDirectory] = {}


def build_session(master: str = "local[*]", app: str = "gradewright", partitions: int = 8,
                  memory: str = "8g") -> SparkSession:
    """A local session for tests and the bench. On a cluster, pass your own."""
    spark = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach: `spark.checkpoint.dir` where it is set.

    Only a session within one process, as in tests, may do without the setting: it
    gets a temporary folder that goes when the process ends. On a cluster a
    machine-local folder would die with its node. No setting is changed.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", "")):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    if "folder" not in _OWN:
        _OWN["folder"] = tempfile.TemporaryDirectory(prefix="gradewright-", ignore_cleanup_errors=True)
    return _OWN["folder"].name


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new, not yet existing folder below the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """The rows as a Parquet table in the shared folder.

    Computed once, survives lost executors, and later passes read only the
    columns they need. Its size is known, so joins are planned by it. The table
    stays until the shared folder is cleaned.
    """
    folder = fresh_folder(df.sparkSession, "table")
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def settle(df: DataFrame, **columns: Column) -> DataFrame:
    """Add or replace columns whose values are computed once per row.

    The optimizer copies the expression of a plain column into every filter and
    projection above it, so a regex behind a column may run many times per row.
    It cannot look into a generator; `inline` over one struct is the cheapest.
    """
    kept = [c for c in df.columns if c not in columns]
    made = F.struct(*[c.alias(n) for n, c in columns.items()])
    return df.select(*kept, F.inline(F.array(made)))
