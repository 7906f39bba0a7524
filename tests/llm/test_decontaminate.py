"""Passages of a test set against a search at every word."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from boxoffice.llm import decontaminate as dc
from boxoffice.llm.fmindex import FMIndex

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def plain(docs, items, window=10):
    phrases = {}
    for i, text in items:
        words = WORD.findall((text or "").translate(LOWER))
        for at in range(max(1, len(words) - window + 1)) if words else ():
            phrases.setdefault(tuple(words[at : at + window]), set()).add("" if i is None else str(i))
    out = []
    for i, text in docs:
        words = WORD.findall((text or "").translate(LOWER))
        hit, names = set(), set()
        for length in {len(p) for p in phrases}:
            for at in range(len(words) - length + 1):
                if (p := tuple(words[at : at + length])) in phrases:
                    hit |= set(range(at, at + length))
                    names |= phrases[p]
        out.append((i, len(words), len(hit), sorted(names)))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def cases():
    rng = random.Random(5)
    word = lambda: rng.choice(["the", "Of", "é", "x1", "straße", "漢字", "q" * 70, "in"]) + rng.choice(["", "a", "B"])
    items = [(i, " ".join(word() for _ in range(rng.randrange(1, 30)))) for i in range(12)]
    items += [(3, items[4][1]), (None, "short item"), (90, None), (91, ""), (92, "?!"), (93, "loop " * 25), (10, items[1][1])]
    docs = [(None, "a SHORT, item here"), (1, None), (2, ""), (3, " !?"), (4, items[5][1]), (5, "Loop " * 4000), (5, "Loop " * 4000), (6, "short"), (7, "item short")]
    for i in range(20, 60):
        parts = [rng.choice([items[rng.randrange(12)][1], " ".join(word() for _ in range(20))]) for _ in range(4)]
        docs.append((i, ", ".join(parts)))
    docs.append((70, "z" * 100_000 + " " + items[0][1]))
    return docs, items


@pytest.mark.parametrize("block_bytes", [1 << 20, 100])
def test_odd_rows(spark, cases, block_bytes):
    docs, items = cases
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("items", F.lit(1)).withColumn("row", F.lit("x"))
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("n", F.lit(1))
    got = dc.find_passages(df, bench, block_bytes=block_bytes)
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in got.collect()), key=repr) == plain(docs, items)
    assert dc.find_passages(df.limit(0), bench).count() == 0
    assert dc.find_passages(df, bench.limit(0)).agg(F.sum("n_hit")).first()[0] == 0


def test_one_block_at_a_time(spark, cases, monkeypatch):
    """Of a test set of many blocks, the driver and the tasks hold one."""
    docs, items = cases
    held, most, sizes = set(), [], []
    context = spark.sparkContext
    broadcast = context.broadcast

    def counted(value):
        made = broadcast(value)
        destroy = made.destroy
        held.add(id(made))
        most.append(len(held))
        sizes.append(len(value.items))
        made.destroy = lambda: (held.discard(id(made)), destroy())
        return made

    monkeypatch.setattr(context, "broadcast", counted)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    dc.find_passages(df, spark.createDataFrame(items, "item_id long, text string"), block_bytes=700).count()
    assert len(most) >= 3 and max(most) == 1 and max(sizes) < 12


def test_cut(spark):
    phrase = "one two three four five six seven eight nine ten"
    rows = [(1, f"Before, {phrase.upper()}! After.", "a"), (2, phrase, "b"), (3, None, "c"), (4, "", None), (5, f"{phrase} é {phrase}", "d")]
    df = spark.createDataFrame(rows, "doc_id long, text string, row string")
    bench = spark.createDataFrame([(1, phrase)], "item_id long, text string")
    got = dc.without_passages(df, bench)
    assert got.columns == df.columns
    assert sorted(map(tuple, got.collect())) == [(1, "Before, ! After.", "a"), (3, None, "c"), (4, "", None), (5, " é ", "d")]


def test_index_finds_every_occurrence():
    rng = np.random.default_rng(1)
    for n in (1, 2, 50, 400):
        symbols = np.append(rng.integers(1, 4, n), 0)
        index = FMIndex(symbols, 4)
        for length in (1, 2, 5):
            asked = rng.integers(1, 4, (30, length))
            which, low, high = index.search(asked)
            of, at = index.locate(low, high)
            got = sorted(zip(which[of].tolist(), at.tolist(), strict=True))
            assert got == sorted((k, i) for k, p in enumerate(asked) for i in range(n - length + 1) if (symbols[i : i + length] == p).all())
