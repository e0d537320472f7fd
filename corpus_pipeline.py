"""From raw documents to packed training sequences, one written table per stage.

Every stage takes the rows its predecessor kept, in any number and order, with
whatever further columns they have; only `doc_id` and `text` are looked at, NULLs
included, as each operator's docstring says. Empty tables pass through.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradewright.llm import copies, packing, quality, surrogates, toxicity
from gradewright.session import fresh_folder


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents not scored as toxic by a classifier trained on the labelled ones."""
    model = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.keep_clean(docs, model)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass every quality rule, unchanged."""
    return quality.keep(docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of copies and near copies the document of the smallest id.

    Candidates are the classes of SimHash fingerprints and, for pairs beyond their three bits,
    bands of min-hashes. A link takes four fifths of the 5-word shingles, counted in whole texts.
    """
    return copies.one_of_each(docs)


def hide_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with surrogates for personal data in their text."""
    return surrogates.without_private(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 2048 tokens, with their ids."""
    made = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return made.withColumn("ids_crc32", F.crc32("ids"))


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", keep_good),
    ("copies", drop_copies),
    ("surrogates", hide_private),
    ("packing", pack),
]

# A trained classifier, fingerprints, keyed surrogates and packing have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages in order, each to the written rows of the one before."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES:
        folder = fresh_folder(spark, f"pipeline-{name}")
        function(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return docs
