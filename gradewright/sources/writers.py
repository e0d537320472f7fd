"""Writers. Every writer makes a folder of part files, one per task."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """CSV with a header in UTF-8. Part files carry no byte order mark: it would
    end up inside the data when parts are joined. Read them as UTF-8."""
    whole = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    df.write.mode(mode).options(header=True, encoding="UTF-8", escape='"', **whole).csv(path)


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """JSON Lines with NULL fields kept."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def write_splits(df: DataFrame, path: str, split: str = "split", mode: str = "errorifexists") -> None:
    """One folder per split in one write."""
    df.write.mode(mode).partitionBy(split).parquet(path)


def write_record_stages(df: DataFrame, path: str, key: str, stages: Mapping[str, str], mode: str = "errorifexists") -> None:
    """The intermediate results of every record as JSON text, one folder per stage
    keyed by id. `stages` maps a stage name to the column it keeps."""
    cells = F.array(
        *[
            F.struct(F.lit(s).alias("stage"), F.to_json(F.struct(F.col(c).alias(s)), {"ignoreNullFields": "false"}).alias("content"))
            for s, c in stages.items()
        ]
    )
    df.select(key, F.explode(cells).alias("c")).select(key, "c.*").write.mode(mode).partitionBy("stage").parquet(path)


def six_decimals(df: DataFrame, *columns: str) -> DataFrame:
    """Numbers as text with six decimals."""
    numbers = {c: F.col(c).cast("double") for c in columns}
    return df.withColumns({c: F.when(v.isNotNull(), F.format_string("%.6f", v)) for c, v in numbers.items()})


def write_summary(summary: DataFrame, path: str, stage: str = "stage", mode: str = "errorifexists") -> None:
    """Stage summary as CSV with six decimals."""
    numbers = ("mean", "std", "median", "q25", "q75", "min", "max")
    write_csv(six_decimals(summary.select(stage, *numbers), *numbers).orderBy(stage), path, mode)
