"""Toxic passages as maximum-scoring segments of token log-odds (operator 2).

Learning: on labelled texts, the log-odds of a token are those of the number of toxic and of other texts
that hold it, with a Dirichlet prior. The prior of a word is the estimate of its longest prefix, whose
prior is that of a shorter one, down to even odds; so an unseen form of a known stem is not unknown.

Scoring: each token scores its log-odds less a constant, so that ordinary text sinks, and no more than that
where it only repeats. One linear scan finds
all maximal segments (no segment can be made better by being shortened or joined). In ordinary text the best
segment of m tokens follows an extreme-value law, P(best > s) = 1 - exp(-K m exp(-lambda s)); lambda and K
come from labelled ordinary texts, scored by log-odds learnt from the others. It says which passages are significant,
and what the best one and their number mean for the whole text, by a logistic fit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxoffice.llm.labelled import SAMPLE_ROWS, sample
from boxoffice.llm.logistic import Logistic, class_weights
from boxoffice.llm.words import ALPHANUMERIC, Texts, Words, pieces, span_hashes, texts, words

PREFIXES = (3, 4, 5, 7)  # bytes
PRIOR = 4.0  # texts that a prior counts for
SINK = 0.5  # taken off each token's log-odds
REPEATS = 2  # a token that is one of so many before it adds nothing: "En En En" is no passage
SIGNIFICANT = 0.01  # expected number of such segments in a text of ordinary tokens
STEEPEST = 5.0
FOLDS = 3
PASSAGE = pa.struct([("begin", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("e_value", pa.float64())])


def levels(t: Texts, w: Words) -> list[np.ndarray]:
    """Hashes of each word's prefixes, shortest first, and of the word."""
    ends = [np.minimum(w.ends, w.starts + n) for n in PREFIXES] + [w.ends]
    return [span_hashes(t.data, w.starts, e) for e in ends]


def maximal_segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal segments as ``(first, last, score)``, in one pass over ``scores``.

    A new segment looks for the nearest kept one that begins lower. Each kept segment points to the nearest that
    begins lower than itself, so a search goes from one to the next without the segments between, and never
    passes the same pointer twice. If none begins lower, nothing that comes can reach back: all kept segments are final.
    """
    final: list[tuple[int, int, float]] = []
    # first, last, the running total before and after, the nearest kept one that begins lower
    kept: list[tuple[int, int, float, float, int]] = []
    total = 0.0
    for i, s in enumerate(scores):
        if s <= 0:
            total += s
            continue
        first, before, after = i, total, total + s
        total = after
        j = len(kept) - 1
        while True:
            while j >= 0 and kept[j][2] >= before:
                j = kept[j][4]
            if j < 0:
                final += [(a, b, high - low) for a, b, low, high, _ in kept]
                kept = [(first, i, before, after, -1)]
                break
            if kept[j][3] >= after:
                kept.append((first, i, before, after, j))
                break
            first, _, before, _, back = kept[j]
            del kept[j:]
            j = back
    return final + [(a, b, high - low) for a, b, low, high, _ in kept]


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """`maximal_segments` of one text; runs of one sign are taken together, as no segment ends within."""
    if not (scores > 0).any():
        return []
    turns = np.flatnonzero(np.diff(scores > 0)) + 1
    bounds = np.concatenate([[0], turns, [len(scores)]])
    runs = np.add.reduceat(scores, bounds[:-1]).tolist()
    return [(int(bounds[a]), int(bounds[b + 1]) - 1, s) for a, b, s in maximal_segments(runs)]


class Toxicity:
    """Fitted on texts of class 0 and 1; ``n0`` and ``n1`` are the class sizes in all labels."""

    def __init__(self, clean: list[str], toxic: list[str], n0: int, n1: int):
        clean, toxic = sorted(set(clean) - set(toxic)), sorted(set(toxic))
        rng = np.random.default_rng(0)
        rng.shuffle(clean)
        rng.shuffle(toxic)
        self.share = (n1 + 1) / (n0 + n1 + 2)
        self.tables: list[tuple[np.ndarray, np.ndarray]] = []
        self.fit: Logistic | None = None
        self.steep, self.k = STEEPEST, 1.0
        if min(len(clean), len(toxic)) < FOLDS:
            return
        # calibrated on scores of texts that the log-odds have not seen
        unseen: list[list[np.ndarray]] = [[], []]
        for k in range(FOLDS):
            self.learn([x for i, x in enumerate(clean) if i % FOLDS != k], [x for i, x in enumerate(toxic) if i % FOLDS != k])
            for held, part in zip(unseen, (clean, toxic), strict=True):
                held += self.scored_tokens(pa.array(part[k::FOLDS], pa.large_string()))
        self.calibrate(unseen[0])
        x = np.array([self.features(s) for part in unseen for s in part])
        y = np.repeat([0, 1], [len(p) for p in unseen])
        self.fit = Logistic(x, y, class_weights(y, n0, n1), ridge=0.1)
        self.learn(clean, toxic)

    def learn(self, clean: list[str], toxic: list[str]) -> None:
        t = texts(pa.array(clean + toxic, pa.large_string()), lower=True)
        w = words(t, ALPHANUMERIC)
        self.tables = []
        rows = w.rows()
        is_toxic = rows >= len(clean)
        ratio = len(toxic) / len(clean)
        parent_of = np.zeros(len(rows), np.int64)  # the entry of the level before
        odds = np.array([0.5])  # share of toxic, by entry
        for hashes in levels(t, w):
            names, which = np.unique(hashes, return_inverse=True)
            parent = np.zeros(len(names), np.int64)
            parent[which] = parent_of
            once = np.unique(rows * len(names) + which, return_index=True)[1]  # a text counts once
            seen = [np.bincount(which[once][is_toxic[once] == k], minlength=len(names)) for k in (False, True)]
            prior = odds[parent]
            high, low = seen[1] + PRIOR * prior, seen[0] * ratio + PRIOR * (1 - prior)
            odds, parent_of = high / (high + low), which
            self.tables.append((names, np.log(odds / (1 - odds)).astype(np.float32)))

    def token_scores(self, t: Texts, w: Words) -> np.ndarray:
        whole = span_hashes(t.data, w.starts, w.ends)
        _, one, which = np.unique(whole, return_index=True, return_inverse=True)
        found = np.zeros(len(one), np.float64)
        some = Words(w.starts[one], w.ends[one], w.first)
        for hashes, (names, odds) in zip(levels(t, some), self.tables, strict=True):
            at = np.minimum(np.searchsorted(names, hashes), max(len(names) - 1, 0))
            known = names[at] == hashes if len(names) else np.zeros(len(hashes), bool)
            found[known] = odds[at[known]]
        out = found[which] - SINK
        for back in range(1, REPEATS + 1):
            again = np.flatnonzero(which[back:] == which[:-back]) + back
            again = again[(rows := w.rows())[again] == rows[again - back]]
            out[again] = np.minimum(out[again], -SINK)
        return out

    def scored_tokens(self, column: pa.Array) -> list[np.ndarray]:
        out = []
        for a, b in pieces(column):
            t = texts(column.slice(a, b - a), lower=True)
            w = words(t, ALPHANUMERIC)
            scores = self.token_scores(t, w)
            out += [scores[x:y] for x, y in zip(w.first[:-1], w.first[1:], strict=True)]
        return out

    def calibrate(self, clean: list[np.ndarray]) -> None:
        """lambda solves E exp(lambda s) = 1 over ordinary tokens; K is the likeliest for their best segments."""
        tokens = np.concatenate([*clean, [-SINK]])
        low, high = 0.0, STEEPEST
        if np.exp(np.minimum(high * tokens, 600)).mean() > 1:
            for _ in range(60):
                middle = (low + high) / 2
                low, high = (middle, high) if np.exp(np.minimum(middle * tokens, 600)).mean() < 1 else (low, middle)
        self.steep = max(high, 1e-3)
        best = [max((s for *_, s in segments(x)), default=0.0) for x in clean]
        self.k = len(clean) / max(1e-9, sum(max(1, len(x)) * np.exp(-self.steep * b) for x, b in zip(clean, best, strict=True)))

    def e_value(self, score: float, n: int) -> float:
        """Expected number of segments as good in ``n`` ordinary tokens."""
        return float(self.k * max(1, n) * np.exp(-self.steep * score))

    def features(self, scores: np.ndarray) -> tuple[float, float]:
        return self.summary([s for *_, s in segments(scores)], len(scores))

    def summary(self, found: list[float], n: int) -> tuple[float, float]:
        """Of the best segment its improbability in nats, up to a bound, and how many are significant."""
        values = [self.e_value(s, n) for s in found]
        best = min([1.0, *(-np.expm1(-v) for v in values)])
        return min(30.0, -np.log(max(best, 1e-300))), float(np.log1p(sum(v < SIGNIFICANT for v in values)))

    def judge(self, column: pa.Array) -> tuple[np.ndarray, list[list[dict]]]:
        """Scores of whole texts and their significant passages, in characters."""
        t = texts(column, lower=True)
        w = words(t, ALPHANUMERIC)
        if self.fit is None:
            return np.full(len(t), self.share), [[] for _ in range(len(t))]
        scores = self.token_scores(t, w)
        x, passages = np.zeros((len(t), 2)), []
        for row, (a, b) in enumerate(zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True)):
            found = segments(scores[a:b])
            x[row] = self.summary([s for *_, s in found], b - a)
            listed = []
            for i, j, s in found:
                if (e := self.e_value(s, b - a)) < SIGNIFICANT:
                    origin, begin, end = t.begins[row], w.starts[a + i], w.ends[a + j]
                    chars = [int(((t.data[origin:p] & 0xC0) != 0x80).sum()) for p in (begin, end)]
                    listed.append({"begin": chars[0], "end": chars[1], "score": float(s), "e_value": e})
            passages.append(listed)
        return self.fit(x), passages


def fitted(docs: DataFrame, labels: DataFrame, label: str, learn: Column, rows: int = SAMPLE_ROWS) -> Toxicity:
    return Toxicity(*sample(docs, labels, label, learn, rows))


def scored(docs: DataFrame, model: Toxicity) -> DataFrame:
    """``(doc_id, score, passages)`` of each row of ``docs(doc_id, text, ..)``.

    ``score`` is the probability that the whole text is toxic, ``passages`` its significant segments as
    (begin, end) in characters with score and expected number. Texts without words (null, empty) have no
    passages and the score of text without positive tokens; without labels of both classes every score is
    the share of class 1. Repeated rows keep a row each; other columns are ignored; no rows give no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column("text")
            for a, b in pieces(text):
                scores, passages = shared.value.judge(text.slice(a, b - a))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(scores, pa.float64()), pa.array(passages, pa.list_(PASSAGE))], ["doc_id", "score", "passages"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        run, f"doc_id {kind}, score double, passages array<struct<begin: long, end: long, score: double, e_value: double>>"
    )
