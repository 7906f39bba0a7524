"""The treap against its points; search against a plain ranking of all documents."""

import math
import re
import random
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest

from boxoffice.llm import lexical
from boxoffice.llm.treap import Treap

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def points(rng, rows, columns, n):
    cells = rng.choice(rows * columns, min(n, rows * columns), replace=False)
    return cells // columns, cells % columns, rng.integers(1, rng.choice([2, 5, 1000]), len(cells))


def test_treap_holds_its_points():
    rng = np.random.default_rng(1)
    for _ in range(150):
        rows, columns = rng.integers(1, 40, 2)
        r, c, v = points(rng, rows, columns, int(rng.integers(1, 200)))
        t = Treap.of(r, c, v).opened()
        # every node once, with the place of its cell
        got, at = [], [(0, 0, 0, t.depth, None)]
        while at:
            node, row, column, side, above = at.pop()
            assert above is None or t.value[node] <= above
            got.append((row + t.row[node], column + t.column[node], t.value[node]))
            for q in range(4 if side else 0):
                child = int(t.down(np.array([node]), np.array([q]))[0])
                if child >= 0:
                    half = 1 << (side - 1)
                    at.append((child, row + (q >> 1) * half, column + (q & 1) * half, side - 1, t.value[node]))
        assert sorted(map(tuple, got)) == sorted(zip(r, c, v))


@pytest.mark.parametrize("at_once", [1, 4, 64])
def test_descent_finds_the_best(monkeypatch, at_once):
    monkeypatch.setattr("boxoffice.llm.treap.AT_ONCE", at_once)
    rng = np.random.default_rng(2)
    for _ in range(150):
        rows, columns = rng.integers(1, 60, 2)
        r, c, v = points(rng, rows, columns, int(rng.integers(0, 400)))
        t = Treap.of(r, c, v).opened()
        asked = rng.choice(rows, int(rng.integers(0, rows + 1)), replace=False)
        weight = rng.integers(0, 4, len(asked))
        want = Counter()
        for i, w in zip(asked, weight, strict=True):
            for column, value in zip(c[r == i], v[r == i], strict=True):
                want[int(column)] += int(w * value)
        want = sorted((-s, column) for column, s in want.items() if s)
        best, given = lexical.Best(5), []

        def give(columns, scores):
            given.extend(columns.tolist())
            best.add(columns.tolist(), scores)

        t.search(asked, weight, best.least, give)
        assert [(s, i) for s, _, i in best.rows] == want[:5]
        assert len(set(given)) == len(given)


def test_descent_leaves_most_out():
    rng = np.random.default_rng(3)
    r, c, v = points(rng, 200, 5000, 20_000)
    r, c, v = np.append(r, [200, 200]), np.append(c, [7, 4000]), np.append(np.minimum(v, 10), [5000, 4000])
    given, best = [], lexical.Best(2)

    def give(columns, scores):
        given.extend(columns.tolist())
        best.add(columns.tolist(), scores)

    Treap.of(r, c, v).opened().search(np.array([3, 5, 200]), np.array([1, 1, 1]), best.least, give)
    assert [i for *_, i in best.rows] == [7, 4000] and len(given) < 100


def plain_search(docs, items, most):
    terms = lambda text: TERM.findall((text or "").translate(LOWER))
    counted = [(i, Counter(terms(text))) for i, text in docs]
    counted = [(i, c) for i, c in counted if c]
    n_docs, n_terms = len(counted), sum(c.total() for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(terms(text))
    out = []
    for item, mine in asked.items():
        found = []
        for i, c in counted:
            m = 10 + 90 * c.total() * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in mine if c[t])
            found += [(-s, i is None, i)] if s > 0 else []
        out += [(item, rank, i, -s) for rank, (s, _, i) in enumerate(sorted(found, key=lambda r: (r[0], r[1], r[2] or 0))[:most], 1)]
    return sorted(out, key=repr)


def random_rows(seed):
    rng = random.Random(seed)
    words = ["a", "B", "Élan", "x1", "über"] + [f"w{i}" for i in range(200)]
    text = lambda n: rng.choice([" ", "-", "\n"]).join(rng.choice(words[: rng.choice([5, 50, 205])]) for _ in range(n))
    docs = [(i, text(rng.randrange(0, 40))) for i in range(300)]
    docs += [(None, None), (None, "a B w7"), (400, ""), (401, "!?"), (3, "same w3 row"), (3, "same w3 row"), (402, "b " * 50_000 + "w9")] + [(i, "copy w5 of w6") for i in range(500, 540)]
    items = [(i, text(rng.randrange(1, 12))) for i in range(30)]
    items += [(100, None), (101, ""), (102, "nowhere"), (103, "COPY of"), (4, "w3 more"), (None, "same b"), (103, "COPY of"), (104, "w9 " * 9000)]
    return docs, items


@pytest.mark.parametrize("most,block", [(10, 1 << 20), (3, 40)])
def test_against_plain_ranking(spark, monkeypatch, most, block):
    monkeypatch.setattr(lexical, "SHARD_BYTES", 2000)
    docs, items = random_rows(most)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3).selectExpr("*", "map(1, 2) AS terms", "1 AS rank", "'x' AS docs")
    asked = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "0 AS term", "map(1, 2) AS rank")
    index = lexical.build(df)
    got = lexical.search(spark, index, asked, most, block)
    assert got.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    assert sorted(map(tuple, got.collect()), key=repr) == plain_search(docs, items, most)


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b"), (2, "b")], "doc_id long, text string"), spark.createDataFrame([("x", "a")], "item_id string, text string")
    nothing = lexical.build(docs.limit(0))
    assert lexical.search(spark, nothing, items).collect() == []
    index = lexical.build(docs)
    assert lexical.search(spark, index, items.limit(0)).collect() == []
    assert [(r.item_id, r.rank, r.doc_id) for r in lexical.search(spark, index, items).collect()] == [("x", 1, 1)]


def test_row_groups_of_the_index_are_bounded(spark, monkeypatch):
    # a task reads a row group at a time, so a hundred shards must not be one
    monkeypatch.setattr(lexical, "SHARD_BYTES", 64)
    monkeypatch.setattr(lexical, "GROUP_BYTES", 4096)
    docs = spark.createDataFrame([(i, f"word{i} and some more words for document {i}") for i in range(60)], "doc_id long, text string").coalesce(1)
    index = lexical.build(docs)
    files = spark.read.parquet(index.path).inputFiles()
    found = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in files]
    assert sum(m.num_rows for m in found) >= 30
    assert all(m.row_group(i).num_rows < 30 for m in found for i in range(m.num_row_groups))
