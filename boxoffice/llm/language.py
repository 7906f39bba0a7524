"""Language of whole texts, first the family, then the language within it (operator 13).

A text is the shares of its byte n-grams, hashed into a few thousand features. A linear support vector machine
for each family against the others names the family. Within it, one machine for each two languages votes. Margins become
probabilities by a logistic fit to texts that the machine had not seen.

Families of languages that are not listed in `FAMILIES` have one member each.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from itertools import combinations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boxoffice.llm.logistic import Logistic
from boxoffice.llm.words import MIX_1, Texts, mixed, pieces, texts

SAMPLE_ROWS = 4000  # to fit on, over all languages
SAMPLE_CHARS = 10_000  # longer texts are not used for fitting
MOST_LANGUAGES = 100  # the most frequent ones are learnt
UNKNOWN = "und"

# Well-known families by language code
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "is", "lb", "nb", "nl", "nn", "no", "sv"),
    "romance": ("ca", "es", "fr", "gl", "it", "oc", "pt", "ro"),
    "slavic": ("be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "baltic": ("lt", "lv"),
    "uralic": ("et", "fi", "hu"),
    "turkic": ("az", "kk", "tr", "uz"),
    "semitic": ("ar", "he", "mt"),
    "indo-aryan": ("bn", "gu", "hi", "mr", "ne", "pa", "ur"),
    "austronesian": ("id", "jv", "ms", "tl"),
}

# bits of the bins for the n-grams of one, two and three bytes
BITS = (8, 11, 12)
DIMS = sum(1 << bits for bits in BITS)
ROWS_AT_ONCE = 256
STEP = 1 << 21  # bytes that numpy works on at a time

# letters and bytes beyond ASCII stay, everything else is a space
FOLDED = np.full(256, 0x20, np.uint8)
FOLDED[0x61:0x7B] = np.arange(0x61, 0x7B)
FOLDED[0x41:0x5B] = np.arange(0x61, 0x7B)
FOLDED[0x80:] = np.arange(0x80, 0x100)
LETTER = regex.compile(r"\p{L}")


def bins(code: np.ndarray, n: int) -> np.ndarray:
    """Bins of n-grams, given as numbers of n bytes."""
    if n == 1:
        return code
    return (mixed(code.astype(np.uint64) * MIX_1 + np.uint64(n)) >> np.uint64(64 - BITS[n - 1])).astype(np.int64)


PAIR_BINS = bins(np.arange(1 << 16), 2)


def shares(t: Texts) -> np.ndarray:
    """The share of each feature among the n-grams of its length, for each text with a space after it. N-grams
    of spaces do not count."""
    rows = len(t)
    counts = [np.zeros(rows << bits, np.int64) for bits in BITS]
    for a in range(0, len(t.data) - 8, STEP):
        data = FOLDED[t.data[a : min(a + STEP + 2, len(t.data) - 8)]].astype(np.int64)
        row = np.searchsorted(t.begins, np.arange(a, a + len(data)), "right") - 1
        code, spaces = np.zeros(len(data), np.int64), 0
        for n, bits in enumerate(BITS, 1):
            size = min(len(data) - n + 1, STEP)
            if size <= 0:
                break
            code, spaces = code[: len(data) - n + 1] << 8 | data[n - 1 :], spaces << 8 | 0x20
            counted = (code[:size] != spaces) & (row[:size] == row[n - 1 : n - 1 + size])
            mine = code[:size][counted]
            feature = PAIR_BINS[mine] if n == 2 else bins(mine, n)
            counts[n - 1] += np.bincount((row[:size][counted] << bits) + feature, minlength=rows << bits)
    tables = [c.reshape(rows, -1) for c in counts]
    return np.concatenate([(c / np.maximum(c.sum(axis=1, keepdims=True), 1)).astype(np.float32) for c in tables], axis=1)


def has_letter(t: Texts) -> np.ndarray:
    plain = FOLDED[t.data[:-8]]
    found = np.logical_or.reduceat((plain != 0x20) & (plain < 0x80), t.begins[:-1]) if len(t) else np.zeros(0, bool)
    for row in np.flatnonzero(~found):
        found[row] = LETTER.search(t.text(row).decode("utf-8", "replace")) is not None
    return found


def machine(x: np.ndarray, y: np.ndarray, cost: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Weights of a linear support vector machine (squared hinge loss, ``cost`` per row), by descent on the
    coordinates of the dual problem; ``y`` is 1 or -1. The last column of ``x`` is for the bias."""
    order = np.random.default_rng(0)
    alpha = np.zeros(len(x))
    w = np.zeros(x.shape[1], np.float32)
    curve = np.einsum("ij,ij->i", x, x) + 0.5 / cost
    for _ in range(rounds):
        moved = 0.0
        for i in order.permutation(len(x)):
            slope = y[i] * float(x[i] @ w) - 1 + 0.5 * alpha[i] / cost[i]
            if alpha[i] == 0 and slope >= 0:
                continue
            after = max(alpha[i] - slope / curve[i], 0.0)
            w += np.float32((after - alpha[i]) * y[i]) * x[i]
            moved = max(moved, abs(slope))
            alpha[i] = after
        if moved < 0.01:
            break
    return w


class Machine:
    """One class against another: margins, and the probability of the first."""

    def __init__(self, x: np.ndarray, first: np.ndarray):
        y = np.where(first, 1.0, -1.0)
        # classes weigh the same, whatever their share of the rows
        cost = np.where(first, len(y) / max(1, 2 * first.sum()), len(y) / max(1, 2 * (~first).sum()))
        unseen = np.zeros(len(y))
        part = np.zeros(len(y), np.int64)
        for side in (first, ~first):
            part[side] = np.arange(side.sum()) % 2
        for k in (0, 1):
            fit, held = part != k, part == k
            if len(set(y[fit])) == 2 and held.any():
                unseen[held] = x[held] @ machine(x[fit], y[fit], cost[fit])
        self.weights = machine(x, y, cost)
        self.logistic = Logistic(unseen[:, None], first.astype(float), cost, ridge=0.1)

    def __call__(self, margins: np.ndarray) -> np.ndarray:
        return self.logistic(margins[:, None])


class Languages:
    """Fitted on ``(text, language)`` rows."""

    def __init__(self, rows: list[tuple[str, str]], families: Mapping[str, tuple[str, ...]] = FAMILIES):
        self.names = sorted({lang for _, lang in rows})
        family_of = {lang: family for family, members in families.items() for lang in members}
        self.families: dict[str, list[str]] = {}
        for lang in self.names:
            self.families.setdefault(family_of.get(lang, lang), []).append(lang)
        self.scale = np.ones(DIMS, np.float32)
        self.of_family: list[Machine] = []
        self.of_pair: dict[tuple[str, str], Machine] = {}
        if len(self.names) < 2:
            return
        raw = [t.encode("utf-8", "replace") for t, _ in rows]
        langs = np.array([lang for _, lang in rows])
        x = np.concatenate([shares(texts(pa.array(raw[i : i + ROWS_AT_ONCE], pa.binary()))) for i in range(0, len(raw), ROWS_AT_ONCE)])
        # rare n-grams are small numbers; all features get about the same spread
        self.scale = (1 / np.sqrt(x.mean(axis=0) + 1e-5)).astype(np.float32)
        x = self.scaled(x)
        if len(self.families) > 1:
            self.of_family = [Machine(x, np.isin(langs, members)) for members in self.families.values()]
        for members in self.families.values():
            for a, b in combinations(members, 2):
                two = np.isin(langs, (a, b))
                self.of_pair[a, b] = Machine(x[two], langs[two] == a)
        machines = [*self.of_family, *self.of_pair.values()]
        self.weights = np.stack([m.weights for m in machines], axis=1)

    def scaled(self, x: np.ndarray) -> np.ndarray:
        """With a last column of ones."""
        return np.concatenate([x * self.scale, np.ones((len(x), 1), np.float32)], axis=1)

    def named(self, column: pa.Array) -> tuple[list[str], np.ndarray]:
        """Language and score of texts of a bounded number."""
        t = texts(column)
        lettered = has_letter(t)
        if len(self.names) < 2:
            langs = [self.names[0] if self.names and yes else UNKNOWN for yes in lettered]
            return langs, np.where(lettered, float(len(self.names)), 0.0)
        margins = self.scaled(shares(t)) @ self.weights
        families = list(self.families.values())
        likely = np.ones((len(t), 1))
        if self.of_family:
            likely = np.stack([m(margins[:, k]) for k, m in enumerate(self.of_family)], axis=1)
            likely = likely / likely.sum(axis=1, keepdims=True)
        chosen = likely.argmax(axis=1)
        beats = {pair: m(margins[:, len(self.of_family) + k]) for k, (pair, m) in enumerate(self.of_pair.items())}
        langs, scores = np.full(len(t), UNKNOWN, object), np.zeros(len(t))
        for k, members in enumerate(families):
            mine = np.flatnonzero(lettered & (chosen == k))
            if not mine.size:
                continue
            # p[a][b]: that a is likelier than b
            p = np.full((len(members), len(members), len(mine)), 1.0)
            for (i, a), (j, b) in combinations(enumerate(members), 2):
                p[i, j] = beats[a, b][mine]
                p[j, i] = 1 - p[i, j]
            # most votes win, the surer of equals; the diagonal votes for all alike
            votes = (p > 0.5).sum(axis=1) + 0.5 * p.mean(axis=1)
            best = votes.argmax(axis=0)
            langs[mine] = np.array(members, object)[best]
            scores[mine] = likely[mine, k] * p.min(axis=1)[best, np.arange(len(mine))]
        return langs.tolist(), scores


def sample(docs: DataFrame, learn: Column, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS, most: int = MOST_LANGUAGES) -> list[tuple[str, str]]:
    """At most ``rows`` texts with their language, as many of each of the ``most`` frequent languages where there are.

    Only rows of ``docs(doc_id, text, lang, ..)`` with a language and a text of 1 to ``chars`` characters for which
    ``learn`` (over ``doc_id``) holds are used. Those whose hash of id and text is small are read, equal rows once.
    """
    lang = F.col("lang").cast("string")
    text = F.col("text").cast("string")
    fit = docs.filter(learn & lang.isNotNull() & (lang != "") & F.length(text).between(1, chars)).select("doc_id", text.alias("text"), lang.alias("lang"))
    counts = fit.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most).collect()
    if not counts:
        return []
    each = max(1, rows // len(counts))
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30))
    shares_of = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], int((1 << 30) * min(1.0, 2 * each / r["count"])))])
    few = fit.withColumn("draw", draw).filter(F.coalesce(F.col("draw") < shares_of[F.col("lang")], F.lit(False)))
    few = few.distinct()
    ordered = few.select("*", F.row_number().over(Window.partitionBy("lang").orderBy("draw", "doc_id", "text")).alias("place"))
    found = ordered.filter(F.col("place") <= each).orderBy("lang", "place").collect()
    return [(r.text, r.lang) for r in found]


def fitted(docs: DataFrame, learn: Column, families: Mapping[str, tuple[str, ...]] = FAMILIES) -> Languages:
    return Languages(sample(docs, learn), families)


def predicted(docs: DataFrame, model: Languages) -> DataFrame:
    """``(doc_id, lang_pred, score)`` of each row of ``docs(doc_id, text, ..)``.

    ``lang_pred`` is a language that the model has learnt, or "und" with score 0 where the text is null or has no
    letter, or where no language was learnt. ``score`` is the probability of the family times the smallest
    probability with which the language beats another one of it; the only language learnt has 1. Whole texts
    are read. Repeated rows keep a row each; other columns are ignored; no rows give no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, column = batch.column("doc_id"), batch.column("text")
            for low, high in pieces(column):
                for a in range(low, high, ROWS_AT_ONCE):
                    b = min(high, a + ROWS_AT_ONCE)
                    langs, scores = shared.value.named(column.slice(a, b - a))
                    yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")
