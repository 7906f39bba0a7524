"""Statistics against plain loops, the trees' constraints, held-out accuracy."""

import collections
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from boxoffice.llm import rules
from boxoffice.llm.labelled import fold
from boxoffice.llm.queries import QUERIES
from boxoffice.llm.trees import Trees


def plain(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    windows = collections.Counter(zip(words, words[1:], words[2:], strict=False))
    hit = set()
    for i in range(len(words) - 2):
        if windows[tuple(words[i : i + 3])] > 1:
            hit |= {i, i + 1, i + 2}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search("[^\x20\x09-\x0d]", line):
            dup += line in seen
            seen.add(line)
    failed = len(words) < 50 or 100 * len(hit) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit), failed


ODD = [None, "", " \n\t", "one", "a b c a b c", "a a a a", "é ü 漢字 ### | <>", "line\nline\n\nline \nline", "x\x1cy z　w", "word " * 20_000, "w" * 200_000, "\n" * 10_000, "a b\x0bc\x0cd\re"]


def test_odd_texts():
    rng = random.Random(2)
    texts = ODD + ["\n".join(" ".join(rng.choice("abcdé#") * rng.randrange(1, 9) for _ in range(rng.randrange(0, 12))) for _ in range(rng.randrange(1, 12))) for _ in range(200)]
    counts, features = rules.statistics(pa.array(texts))
    assert [(*map(int, c), bool(f)) for c, f in zip(counts, rules.base_failed(counts), strict=True)] == [plain(t) for t in texts]
    assert features.shape == (len(texts), len(rules.FEATURES)) and np.isfinite(features).all()


def test_odd_rows(spark):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(3, "one"), (None, "one")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("x")).withColumn("n_words", F.lit(1))
    model = rules.Rules([], [], 0, 0)
    got = rules.judged(df, model).collect()
    key = lambda r: (r[0] is not None, r[0] or 0)
    assert sorted(((r.doc_id, *(r[c] for c in rules.COUNTS), r.base_failed) for r in got), key=key) == sorted(((i, *plain(t)) for i, t in rows), key=key)
    assert not any(r.kept for r in got if r.base_failed)
    assert rules.judged(df.limit(0), model).count() == 0


def test_constraints_hold():
    rng = np.random.default_rng(1)
    x = rng.random((3000, 3))
    y = (rng.random(3000) < 1 / (1 + np.exp(-(3 * np.sin(6 * x[:, 0]) + 2 * x[:, 1] * x[:, 2] - 1)))).astype(int)
    free, bound = (Trees(x, y, np.ones(3000), s) for s in ([0, 0, 0], [-1, 1, 0]))
    grid = np.linspace(0, 1, 101)
    for _ in range(50):
        other = rng.random(3)
        for f, sign in ((0, -1), (1, 1)):
            rows = np.repeat(other[None, :], 101, axis=0)
            rows[:, f] = grid
            assert (sign * np.diff(bound(rows)) >= -1e-12).all()
    assert ((free(x) > 0.5) == y).mean() > 0.7
    # the flat arrays give what a walk down each tree gives
    for row in x[:50]:
        total = bound.base
        for node in bound.roots:
            while bound.feature[node] >= 0:
                node = bound.right[node] if row[bound.feature[node]] > bound.threshold[node] else bound.left[node]
            total += bound.value[node]
        assert bound(row[None, :])[0] == pytest.approx(1 / (1 + np.exp(-total)))


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    model = rules.fitted(docs, labels, "quality", fold("doc_id", 4) != 2)
    rows = rules.judged(docs, model).join(labels, "doc_id").filter(fold("doc_id", 4) == 2).filter("NOT base_failed").collect()
    right = {q: [r.kept == bool(q) for r in rows if r.quality == q] for q in (0, 1)}
    assert sum(right[1]) / len(right[1]) > 0.98 and sum(right[0]) / len(right[0]) > 0.9


def test_whole_table(spark, folder):
    got = {r.doc_id: (*(r[c] for c in rules.COUNTS), r.base_failed) for r in QUERIES["op9_quality_rules"](spark, folder).collect()}
    assert got == {r.doc_id: plain(r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
