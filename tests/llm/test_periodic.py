"""Runs against a loop over all periods; the query against a plain version of its contract."""

import hashlib
import random
import re
import zlib

import pytest

from boxoffice.llm import periodic
from boxoffice.llm.automaton import runs
from boxoffice.llm.queries import QUERIES

WORD = re.compile("[^\x20\x09-\x0d]+")


def plain_runs(words, least=6, power=4):
    n, out = len(words), {}
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            if words[i] != words[i + p]:
                i += 1
                continue
            start = i
            while i + p < n and words[i] == words[i + p]:
                i += 1
            if i + p - start >= 2 * p:
                out.setdefault((start, i + p - start), p)  # the smallest period of the stretch comes first
    return sorted((s, length, p) for (s, length), p in out.items() if length >= max(least, power * p))


def planted(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if doc_id is None or h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def plain(doc_id, text):
    words = planted(doc_id, WORD.findall(text or ""))
    found = plain_runs(words)
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    gone = {i for s, n, p in found for i in range(s + p, s + n)}
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    lines = "".join(f"{s},{n},{p}\n" for s, n, p in found)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None, sha(lines), sha(kept))


def test_runs_of_sequences():
    rng = random.Random(1)
    for _ in range(3000):
        n, k = rng.randrange(0, 32), rng.choice([1, 2, 2, 3])
        words = [rng.randrange(k) for _ in range(n)]
        if n and rng.random() < 0.5:
            a = rng.randrange(n)
            p = 1 + rng.randrange(max(1, (n - a) // 2))
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        assert runs(words) == plain_runs(words, 2, 2)
        assert runs(words, 6, 4) == plain_runs(words)


def test_long_sequences_in_near_linear_time():
    assert runs([7] * 300_000, 6, 4) == [(0, 300_000, 1)]
    assert runs(list(range(700)) * 200, 6, 4) == [(0, 140_000, 700)]
    fibonacci = [[0], [0, 1]]
    while len(fibonacci[-1]) < 60_000:
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    assert not runs(fibonacci[-1], 6, 4)  # no fourth power in it


def random_rows(rng, n):
    vocabulary = ["a", "b", "an", "Élan", "x" * 20, "b,", "3"]
    rows = []
    for i in range(n):
        words = [rng.choice(vocabulary[: rng.randrange(1, 8)]) for _ in range(rng.randrange(0, 60))]
        if words and rng.random() < 0.7:
            at = rng.randrange(len(words))
            words[at:at] = words[at : at + rng.randrange(1, 6)] * rng.randrange(2, 8)
        rows.append((i, rng.choice([" ", "\n", " \t\v"]).join(words)))
    return rows


@pytest.fixture(scope="module")
def rows():
    odd = [(None, None), (None, "a a a a a a a"), (3, ""), (3, " \n"), (3, ""), (4, "b " * 30_000 + "c"), (5, "é" * 200_000), (6, "  " * 7), (7, "w x y z " * 2000)]
    return random_rows(random.Random(2), 400) + odd


def test_against_loops(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS runs", "map(1, 2) AS collapsed", "1 AS start")
    got = [(r.doc_id, [tuple(x) for x in r.runs], r.collapsed) for r in periodic.without_runs(docs).collect()]
    want = []
    for doc_id, text in rows:
        words = WORD.findall(text or "")
        if len(words) < 1000:
            found = plain_runs(words)
        else:
            found = [(0, 30_000, 1)] if words[0] == "b" else [(0, 8000, 4)]
        gone = {i for s, n, p in found for i in range(s + p, s + n)}
        want.append((doc_id, found, " ".join(w for i, w in enumerate(words) if i not in gone)))
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert sum(bool(found) for _, found, _ in want) > 50
    assert periodic.without_runs(docs.limit(0)).count() == 0


def test_query_against_its_contract(spark, folder, tmp_path, rows):
    spark.createDataFrame([r for r in rows if len(r[1] or "") < 5000], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for where in (folder, str(tmp_path)):
        docs = spark.read.parquet(f"{where}/documents.parquet").select("doc_id", "text").collect()
        got = QUERIES["op11_runs"](spark, where)
        assert dict(got.dtypes) == {c: "string" if "sha" in c else "bigint" for c in got.columns}
        assert sorted(map(tuple, got.collect()), key=repr) == sorted((plain(*r) for r in docs), key=repr)
    assert sum(plain(*r)[1] for r in docs) > 50


def test_smaller_runs_are_refused(spark):
    with pytest.raises(ValueError):
        periodic.without_runs(spark.createDataFrame([(1, "a")], "doc_id long, text string"), power=3)
