"""SimHash near-duplicates against a loop over all pairs."""

import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from boxoffice.llm import simhash
from boxoffice.llm.queries import QUERIES
from boxoffice.operators.conflicts import components

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def plain_print(text, size=3):
    words = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
    shingles = [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_roots(prints, most=2):
    distinct = sorted(set(prints))
    root = {p: p for p in distinct}

    def top(p):
        while root[p] != p:
            p = root[p]
        return p

    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if (a ^ b).bit_count() <= most:
                root[top(a)] = top(b)
    return {p: top(p) for p in distinct}


def plain(rows):
    prints = [plain_print(text) for _, text in rows]
    roots = plain_roots(prints)
    least = {}
    for (i, _), p in zip(rows, prints, strict=True):
        if i is not None:
            least[roots[p]] = min(i, least.get(roots[p], i))
    return sorted(((i, f"{p:016x}", least.get(roots[p])) for (i, _), p in zip(rows, prints, strict=True)), key=repr)


def test_odd_rows(spark):
    rng = random.Random(3)
    base = [rng.choice(["alpha", "Ébène", "word", "x" * 40, "straße", "b"]) + str(rng.randrange(50)) for _ in range(300)]
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One"), (5, "one"), (6, "Two words"), (6, "Two words"), (None, "one"), (None, "nothing like it here")]
    for i in range(10, 40):
        words = list(base)
        words[rng.randrange(300)] = "changed"
        rows.append((i, " ".join(words)))
    rows += [(50, "long " * 30_000), (51, "y" * 200_000), (52, "a b c d e"), (53, "long  " * 30_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("bits", F.lit("x")).withColumn("component_id", F.lit(1))
    got = sorted((tuple(r) for r in simhash.near_duplicates(docs).collect()), key=repr)
    assert got == plain(rows)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_whole_table(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    got = sorted((tuple(r) for r in QUERIES["op10_simhash"](spark, folder).collect()), key=repr)
    assert got == plain([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


@pytest.mark.parametrize("most", [0, 1, 2])
@pytest.mark.parametrize("crowd", [1, 4, 1000])
def test_links_join_the_same_groups(spark, most, crowd):
    rng = random.Random(most * 7 + crowd)
    prints = set()
    for _ in range(6):
        center = rng.getrandbits(64)
        prints |= {center} | {center ^ (1 << rng.randrange(64)) ^ (rng.random() < 0.7) * (1 << rng.randrange(64)) for _ in range(25)}
    prints |= {rng.getrandbits(64) for _ in range(20)}
    signed = lambda p: p - (1 << 64) if p >> 63 else p
    df = spark.createDataFrame([(signed(p),) for p in prints], "bits long")
    found = [(r.u, r.v) for r in simhash.links(df, most, crowd).collect()]
    assert all(((u ^ v) & (1 << 64) - 1).bit_count() <= most for u, v in found)
    got = {r.id: r.component for r in components(simhash.links(df, most, crowd)).collect()}
    roots = plain_roots(prints, most)
    groups = {}
    for p, r in roots.items():
        groups.setdefault(r, set()).add(signed(p))
    want = {p: min(g) for g in groups.values() if len(g) > 1 for p in g}
    assert got == want


def test_components_of_a_chain_and_a_star(spark):
    order = list(range(200))
    random.Random(1).shuffle(order)
    pairs = [(order[i], order[i + 1]) for i in range(199)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5000, 5000)]
    got = {r.id: r.component for r in components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(200)} | {1000 + i: 1000 for i in range(300)}


def test_growing_joins_are_not_collected_on_the_driver(spark):
    # a few files hold what becomes many rows
    docs = spark.createDataFrame([(1, "a b c d"), (2, "a b c d"), (3, "x y")], "doc_id long, text string")
    prints = spark.range(100).select(F.col("id").alias("bits"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1g")
    try:
        for df in (simhash.links(prints), simhash.near_duplicates(docs), simhash.one_of_each(docs)):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "Join" in plan and "BroadcastHashJoin" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
