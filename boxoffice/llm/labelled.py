"""A bounded sample of labelled texts, to fit a classifier on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE_ROWS = 2000  # of each class
SAMPLE_CHARS = 20_000  # longer texts are not used for fitting


def fold(doc_id: str, folds: int) -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds


def label_rows(labels: DataFrame, label: str) -> DataFrame:
    """``(doc_id, label)``, one row per document; rows that lack either or contradict each other are left out."""
    known = labels.select("doc_id", F.col(label).cast("int").alias("label")).filter("doc_id IS NOT NULL AND label IN (0, 1)")
    return known.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("most")).filter("label = most").drop("most")


def sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> tuple[list[str], list[str], int, int]:
    """Texts of class 0 and of class 1, at most ``rows`` each, and how many labels each class has.

    Only labels for which ``learn`` (over ``doc_id``) holds are used, and of these only such as have a document with a text
    of 1 to ``chars`` characters. Of each class the smallest hashes of the ids are taken; of documents with the same
    id the smallest text. The class sizes count all labels.
    """
    known = label_rows(labels, label).filter(learn)
    counts = {r.label: r["count"] for r in known.groupBy("label").count().collect()}
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).filter(F.length("text").between(1, chars))
    usable = known.join(texts.select("doc_id"), "doc_id", "left_semi")
    chosen = usable.filter("label = 0").orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    chosen = chosen.unionByName(usable.filter("label = 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows))
    found = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text")).collect()
    found.sort(key=lambda r: r.doc_id)
    return [r.text for r in found if r.label == 0], [r.text for r in found if r.label == 1], counts.get(0, 0), counts.get(1, 0)
