"""A corpus for training: documents through five stages, each over all that the stage before kept.

Every stage takes the columns of ``documents`` and any others, whatever their names and types, and all but the last
give them back. An empty table gives an empty one. Rows without doc_id and repeated rows are rows like any
other; texts of any length are read as a whole. What each stage does with null and empty texts, it says itself.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxoffice.llm import bpe, compression, decontaminate, pii, simhash
from boxoffice.llm.labelled import fold
from boxoffice.llm.staging import staged

KEY = "test tables"


def counted(df: DataFrame) -> DataFrame:
    """``n_chars`` follows the text."""
    return df.withColumn("n_chars", F.length("text").cast(df.schema["n_chars"].dataType)) if "n_chars" in df.columns else df


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score by the compression classifier is at least 0.7.

    Repeated rows get one score and stay or go together. Null and empty texts have the score of the average good text
    over no bytes. Without labels of both classes the score is the share of good ones.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return compression.good(docs, compression.fitted(docs, labels, "quality", fold("doc_id", 4) != 2))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of SimHash near-duplicates, the one with the smallest doc_id.

    Of rows with this doc_id the least by text hash, then by its columns, stays. Null and empty texts are one group, with
    all that have no words. A group in which no row has a doc_id keeps one row.
    """
    return simhash.one_of_each(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of the benchmark; documents that were nothing else go.

    Null and empty texts have no passage and stay. Test items without words, and repeated ones, change nothing.
    """
    return counted(decontaminate.without_passages(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with replacements for personal data, the same for the same entity in all documents.

    Null and empty texts stay as they are. No row goes.
    """
    return counted(pii.without_private(docs, KEY))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, with the digests of the ids and of the text they decode to, one row per row.

    Null and empty texts have no ids. Columns other than doc_id and text are left out.
    """
    return bpe.encoded(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontaminated", decontaminated),
    ("private", private),
    ("encoded", encoded),
]

# Compression, fingerprints, keyed hashes and merges have no counterpart in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
