"""The compression classifier: held-out accuracy, odd rows."""

import math
import random

import pytest
import zstandard
from pyspark.sql import functions as F

from boxoffice.llm import compression
from boxoffice.llm.labelled import fold
from boxoffice.llm.queries import QUERIES


@pytest.fixture(scope="module")
def model():
    rng = random.Random(1)
    good = [" ".join(rng.choice(["river", "stone", "walks", "under", "quiet", "trees"]) for _ in range(rng.randrange(5, 200))) for _ in range(300)]
    bad = [" | ".join(rng.choice(["Click", "Buy", "Home", "###", "Cart"]) for _ in range(rng.randrange(5, 200))) for _ in range(100)]
    return compression.Compression(bad, good, 100, 300)


def test_odd_rows(spark, model):
    rows = [(1, None, 0.5), (2, "", 0.5), (3, "quiet trees under stone " * 50, None), (3, "quiet trees under stone " * 50, None), (None, "Click | Buy | ### | " * 50, 1.0), (5, "river walks " * 30_000, 0.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score double").withColumn("row", F.lit("x"))
    got = compression.scored(df, model)
    assert set(got.columns) == {"doc_id", "text", "score", "row"}
    by = {r.doc_id: r for r in got.collect()}
    assert got.count() == 6 and by[None].score < 0.5 < by[3].score and by[5].score > 0.5 and by[5].text == rows[5][1]
    assert by[1].score == by[2].score and 0 <= by[1].score <= 1
    assert compression.scored(df.limit(0), model).count() == 0


def plain_score(model, text):
    """Both sizes of each block of 512 bytes, one block after the other."""
    raw, difference = (text or "").encode(), 0
    for i in range(0, len(raw), 512):
        sizes = []
        for d in model.dictionaries:
            c = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_dict_id=False)
            sizes.append(len(c.compress(raw[i : i + 512])))
        difference += sizes[0] - sizes[1]
    x = ((difference + model.usual * 50) / (len(raw) + 50) - model.fit.mean[0]) / model.fit.scale[0]
    return 1 / (1 + math.exp(-(model.fit.beta[0] + model.fit.beta[1] * x)))


def test_scores_against_plain_loops(spark, model):
    rng = random.Random(4)
    words = ["river", "Cart", "stone", "| ###", "Buy", "quiet", "élan", "x"]
    some = [" ".join(rng.choice(words) for _ in range(rng.randrange(0, 300))) for _ in range(60)] + [None, "", "a"]
    docs = spark.createDataFrame(list(enumerate(some)), "doc_id long, text string").selectExpr("*", "'c' AS col1", "map(1, 2) AS m", "1 AS _")
    got = {r.doc_id: r.score for r in compression.scored(docs, model).collect()}
    assert got == pytest.approx({i: plain_score(model, t) for i, t in enumerate(some)}, abs=1e-9)
    assert {r.doc_id for r in compression.good(docs, model).collect()} == {i for i, s in got.items() if s >= 0.7}


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, "d e f")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 1), (None, 1), (3, None)], "doc_id long, quality int")
    model = compression.fitted(docs, labels, "quality", F.lit(True))
    assert [r.score for r in compression.scored(docs, model).collect()] == [2 / 3] * 2
    assert compression.scored(docs, compression.fitted(docs, labels.limit(0), "quality", F.lit(True))).first().score == 0.5


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    rows = QUERIES["op4_quality"](spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").filter("held_out").collect()
    right = {q: [r.predicted == q for r in rows if r.quality == q] for q in (0, 1)}
    assert sum(right[1]) / len(right[1]) > 0.97 and sum(right[0]) / len(right[0]) > 0.7
    total = spark.read.parquet(f"{folder}/documents.parquet")
    assert QUERIES["op4_quality"](spark, folder).count() == total.count()
    assert total.filter(fold("doc_id", 4) == 2).count() == QUERIES["op4_quality"](spark, folder).filter("held_out").count()
