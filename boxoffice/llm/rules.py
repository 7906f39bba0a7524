"""Quality rules: gradient-boosted trees over document statistics (operator 9).

Statistics of the whole text come from numpy, many texts at a time. Two fixed rules drop texts that are too
short or repeat themselves; the rest is judged by boosted trees fitted on a bounded sample of labelled
texts, whose nodes are flat arrays. The score may only fall as a text has more symbols, repeated lines or
repeated words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxoffice.llm.labelled import SAMPLE_ROWS, sample
from boxoffice.llm.logistic import class_weights
from boxoffice.llm.trees import Trees
from boxoffice.llm.words import MIX_1, NOT_SPACE, mixed, pieces, span_hashes, texts, words

SYMBOLS = b"#*$%&|<>"
WINDOW = 3
LEAST_WORDS = 50
MOST_REPEATED = 50  # per cent of the words
KEEP = 0.5
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

# Features and the direction in which each may move the score
FEATURES = {
    "symbols per word": -1,
    "repeated words, share": -1,
    "repeated lines, share": -1,
    "characters per word": 0,
    "distinct words, share": 0,
    "capital letters per character": 0,
    "digits per character": 0,
    "punctuation per word": 0,
    "words per line": 0,
}


def chosen(*byte_values: int) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(byte_values)] = True
    return out


IS_SYMBOL = chosen(*SYMBOLS)
IS_CAPITAL = chosen(*range(0x41, 0x5B))
IS_DIGIT = chosen(*range(0x30, 0x3A))
IS_PUNCTUATION = chosen(*b".,;:!?'\"()[]{}-_/\\")
STARTS_CHARACTER = ~chosen(*range(0x80, 0xC0))


def repeated_lines(text: str) -> tuple[int, int]:
    """Lines with a word that equal an earlier line, and all lines with a word."""
    lines = [x for x in text.split("\n") if x.strip(" \t\n\v\f\r")]
    return len(lines) - len(set(lines)), len(lines)


def statistics(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``COUNTS`` and ``FEATURES`` of texts, a row each."""
    t = texts(column)
    w = words(t, NOT_SPACE)
    n = np.diff(w.first)
    in_word = NOT_SPACE[t.data]

    def count(of: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(of)])
        return total[t.begins[1:] - 1] - total[t.begins[:-1]]

    # words in windows that the text has twice
    rows = w.rows()
    hashes = span_hashes(t.data, w.starts, w.ends)
    spread = mixed(rows.astype(np.uint64) * MIX_1)  # a window counts within its text
    hit = np.zeros(len(rows) + WINDOW, bool)
    begins = np.flatnonzero(rows[: len(rows) - WINDOW + 1] == rows[WINDOW - 1 :]) if len(rows) >= WINDOW else np.zeros(0, np.int64)
    key = spread[begins]
    for k in range(WINDOW):
        key = mixed((key ^ hashes[begins + k]) * MIX_1 + np.uint64(k))
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(begins), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    for k in range(WINDOW):
        hit[begins[twice] + k] = True
    repeats = np.bincount(rows, hit[: len(rows)], len(t)).astype(np.int64)
    distinct_words = np.unique(mixed(hashes ^ spread), return_index=True)[1]
    distinct = np.bincount(rows[distinct_words], minlength=len(t))

    lines = np.array([repeated_lines(t.text(i).decode(errors="replace")) for i in range(len(t))], np.int64).reshape(-1, 2)
    word_chars = count(in_word & STARTS_CHARACTER[t.data])
    symbols = count(IS_SYMBOL[t.data])
    counts = np.stack([n, word_chars, symbols, lines[:, 0], repeats], axis=1).astype(np.int64)
    per = lambda a, b: a / np.maximum(b, 1)
    features = np.stack(
        [
            per(symbols, n),
            per(repeats, n),
            per(lines[:, 0], lines[:, 1]),
            per(word_chars, n),
            per(distinct, n),
            per(count(IS_CAPITAL[t.data]), word_chars),
            per(count(IS_DIGIT[t.data]), word_chars),
            per(count(IS_PUNCTUATION[t.data]), n),
            per(n, lines[:, 1]),
        ],
        axis=1,
    )
    return counts, features


def base_failed(counts: np.ndarray) -> np.ndarray:
    return (counts[:, 0] < LEAST_WORDS) | (100 * counts[:, 4] > MOST_REPEATED * counts[:, 0])


class Rules:
    """Fitted on texts of class 0 and 1 that pass the fixed rules; without both classes all such texts are kept."""

    def __init__(self, bad: list[str], good: list[str], n0: int, n1: int):
        self.trees: Trees | None = None
        parts = [statistics(pa.array(x, pa.large_string())) for x in (bad, good)]
        x = [features[~base_failed(counts)] for counts, features in parts]
        if len(x[0]) and len(x[1]):
            y = np.repeat([0, 1], [len(x[0]), len(x[1])])
            self.trees = Trees(np.concatenate(x), y, class_weights(y, n0, n1), list(FEATURES.values()))

    def judge(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Counts, whether the fixed rules fail, and scores."""
        counts, features = statistics(column)
        return counts, base_failed(counts), self.trees(features) if self.trees else np.ones(len(counts))


def fitted(docs: DataFrame, labels: DataFrame, label: str, learn: Column, rows: int = SAMPLE_ROWS) -> Rules:
    return Rules(*sample(docs, labels, label, learn, rows))


def judged(docs: DataFrame, model: Rules) -> DataFrame:
    """``(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, kept)``.

    Words are runs of other than ASCII white space. A null or empty text has no words and fails the fixed
    rules. ``kept`` is false if they fail, else whether the trees' score reaches ``KEEP``. Repeated rows
    keep a row each, with or without doc_id; other columns are ignored; no rows give no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column("text")
            for a, b in pieces(text):
                counts, failed, scores = shared.value.judge(text.slice(a, b - a))
                columns = [*map(pa.array, counts.T.copy()), pa.array(failed), pa.array(scores), pa.array(~failed & (scores >= KEEP))]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), *columns], ["doc_id", *COUNTS, "base_failed", "score", "kept"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        run, f"doc_id {kind}, {', '.join(f'{c} long' for c in COUNTS)}, base_failed boolean, score double, kept boolean"
    )
