"""Quality by compression: two zstandard dictionaries, one of good and one of bad text (operator 4).

Each text is compressed in blocks with either dictionary. The difference of the two sizes per byte says
which dictionary knows the text better, and a logistic fit turns it into a probability. Short texts say
little, so the difference starts from that of good text over ``PRIOR_BYTES`` bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxoffice.llm.labelled import SAMPLE_ROWS, sample
from boxoffice.llm.logistic import Logistic, class_weights
from boxoffice.llm.staging import packed, quoted

BLOCK = 512  # bytes compressed at a time; longer blocks would lean on themselves more than on the dictionary
DICTIONARY_BYTES = 112 << 10
LEVEL = 3
PRIOR_BYTES = 50
KEEP = 0.7  # the score from which a document counts as good


def blocks(raw: bytes, size: int = BLOCK) -> list[bytes]:
    return [raw[i : i + size] for i in range(0, len(raw), size)]


def dictionary(texts: list[str]) -> bytes:
    parts = [b for t in texts for b in blocks(t.encode(), 2 * BLOCK) if len(b) > 64]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, parts).as_bytes()
    except zstandard.ZstdError:  # too little text to choose from: take it as it is
        return b"".join(parts)[-DICTIONARY_BYTES:] or b"\0" * 8


class Compression:
    """Fitted on texts of class 0 and 1; ``n0`` and ``n1`` are the class sizes in all labels."""

    def __init__(self, bad: list[str], good: list[str], n0: int, n1: int):
        self.share = (n1 + 1) / (n0 + n1 + 2)
        self.fit: Logistic | None = None
        self.usual = 0.0
        # one half for the dictionaries, the other for the calibration
        half = max(1, min(len(bad), len(good)) // 2)
        if len(bad) <= half or len(good) <= half:
            return
        self.dictionaries = dictionary(bad[:half]), dictionary(good[:half])
        rest = [self.sizes(t) for t in good[half:]]
        self.usual = sum(d for d, _ in rest) / sum(n for _, n in rest)
        y = np.array([0] * len(bad[half:]) + [1] * len(rest))
        x = np.array([self.evidence(*s) for s in [self.sizes(t) for t in bad[half:]] + rest])[:, None]
        self.fit = Logistic(x, y, class_weights(y, n0, n1), ridge=0.1)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "compressors"}

    def sizes(self, text: str) -> tuple[int, int]:
        """How many bytes more the dictionary of class 0 needs, and the length in bytes."""
        if "compressors" not in self.__dict__:
            self.compressors = [
                zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_dict_id=False)
                for d in self.dictionaries
            ]
        raw = text.encode()
        bad, good = self.compressors
        return sum(len(bad.compress(b)) - len(good.compress(b)) for b in blocks(raw)), len(raw)

    def evidence(self, difference: int, size: int) -> float:
        return (difference + self.usual * PRIOR_BYTES) / (size + PRIOR_BYTES)

    def scores(self, texts: list[str]) -> np.ndarray:
        if self.fit is None:
            return np.full(len(texts), self.share)
        return self.fit(np.array([self.evidence(*self.sizes(t)) for t in texts])[:, None])


def fitted(docs: DataFrame, labels: DataFrame, label: str, learn: Column, rows: int = SAMPLE_ROWS) -> Compression:
    return Compression(*sample(docs, labels, label, learn, rows))


def packed_scores(docs: DataFrame, model: Compression) -> DataFrame:
    """``(row, text, score)``; ``row`` holds the columns other than text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    others = [c for c in docs.columns if c != "text"]
    rows = docs.select(packed(others).alias("row"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = shared.value.scores([t or "" for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], ["row", "text", "score"])

    return rows.mapInArrow(run, rows.withColumn("score", F.lit(0.0)).schema)


def unpacked(names: list[str]) -> list[Column]:
    return [F.col("text") if c == "text" else F.col(f"row.{quoted(c)}").alias(c) for c in names]


def scored(docs: DataFrame, model: Compression) -> DataFrame:
    """``docs`` with ``score``, the probability of label 1 for the whole text of each row.

    A text without evidence (null, empty) gets the score of the average good text over no bytes; without
    labels of both classes every score is the share of class 1. Rows and other columns stay as they are; a
    column called score is replaced.
    """
    return packed_scores(docs, model).select(*unpacked([c for c in docs.columns if c != "score"]), "score")


def good(docs: DataFrame, model: Compression, least: float = KEEP) -> DataFrame:
    """The rows of ``docs`` whose score is at least ``least``, with all their columns as they are."""
    return packed_scores(docs, model).filter(F.col("score") >= least).select(*unpacked(docs.columns))
