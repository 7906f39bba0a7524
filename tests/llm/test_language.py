"""Features and votes against plain loops; the classifier on held-out rows and odd rows."""

import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from boxoffice.llm import language
from boxoffice.llm.queries import QUERIES
from boxoffice.llm.words import texts

SYLLABLES = {"en": ["th", "ing", "er", "ou"], "de": ["sch", "ung", "er", "ü"], "fr": ["eau", "ou", "è", "er"], "es": ["ción", "ñ", "er", "os"], "xx": ["qa", "zo", "er"]}


def written(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    return [(written(rng, lang, rng.randrange(5, 80)), lang) for lang in SYLLABLES for _ in range(60)]


@pytest.fixture(scope="module")
def model(rows):
    return language.Languages(rows)


def plain_shares(text):
    raw = bytes(b | 0x20 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x61 <= b <= 0x7A else 0x20 for b in text.encode() + b" ")
    out = []
    for n, bits in enumerate(language.BITS, 1):
        grams = Counter(raw[i : i + n] for i in range(len(raw) - n + 1) if raw[i : i + n] != b" " * n)
        row = np.zeros(1 << bits)
        for gram, times in grams.items():
            row[language.bins(np.array([int.from_bytes(gram, "big")]), n)[0]] += times / sum(grams.values())
        out.append(row)
    return np.concatenate(out)


def plain_named(model, text):
    """The same by the machines one after another."""
    x = np.append(plain_shares(text) * model.scale, 1)
    chance = lambda m: float(m(np.array([x @ m.weights]))[0])
    of_family = [chance(m) for m in model.of_family]
    k = int(np.argmax(of_family))
    members = list(model.families.values())[k]
    p = {}
    for (a, b), m in model.of_pair.items():
        p[a, b] = chance(m)
        p[b, a] = 1 - p[a, b]
    votes = {a: sum(p[a, b] > 0.5 for b in members if b != a) + sum(p[a, b] for b in members if b != a) / 100 for a in members}
    best = max(members, key=votes.get)
    return best, of_family[k] / sum(of_family) * min([p[best, b] for b in members if b != best], default=1.0)


def test_features(rows, monkeypatch):
    some = [t for t, _ in rows[::20]] + ["", "A", " \n\n ", "É", "a1b2", "x" * 5000, "Zz ünd " * 700]
    got = language.shares(texts(pa.array(some)))
    assert np.allclose(got, [plain_shares(t) for t in some], atol=1e-6)
    monkeypatch.setattr(language, "STEP", 64)
    assert np.allclose(language.shares(texts(pa.array(some))), got)


def test_votes(rows, model):
    assert model.families == {"germanic": ["de", "en"], "romance": ["es", "fr"], "xx": ["xx"]}
    some = [t for t, _ in rows[::7]] + ["th", "ção", "qazo eau"]
    langs, scores = model.named(pa.array(some))
    want = [plain_named(model, t) for t in some]
    assert langs == [lang for lang, _ in want] and np.allclose(scores, [s for _, s in want], atol=1e-3)
    assert np.mean([a == b for a, (_, b) in zip(langs, rows[::7])]) > 0.97


def test_three_languages_vote_in_a_family(rows):
    model = language.Languages(rows, {"all": tuple(SYLLABLES)})
    assert not model.of_family and len(model.of_pair) == 10
    langs, scores = model.named(pa.array([t for t, _ in rows]))
    assert np.mean([a == b for a, (_, b) in zip(langs, rows)]) > 0.97 and ((0 <= scores) & (scores <= 1)).all()


def test_odd_rows(spark, model):
    odd = [(None, None), (1, ""), (1, ""), (2, " 12 !\n"), (3, "١٢"), (4, "Ñ"), (5, "schung " * 300_000), (6, "eauou è " * 3), (7, " ")]
    docs = spark.createDataFrame(odd, "doc_id long, text string").selectExpr("*", "'en' AS lang_pred", "map(1, 2) AS score", "'de' AS lang")
    got = language.predicted(docs, model).collect()
    assert sorted((r.doc_id or 0, r.lang_pred) for r in got if r.doc_id not in (4,)) == [(0, "und"), (1, "und"), (1, "und"), (2, "und"), (3, "und"), (5, "de"), (6, "fr"), (7, "und")]
    assert all(0 <= r.score <= 1 and (r.score > 0) == (r.lang_pred != "und") for r in got)
    assert language.predicted(docs.limit(0), model).count() == 0


def test_few_languages(spark):
    docs = spark.createDataFrame([(1, "a b", "en"), (2, "c", None), (3, None, "de"), (4, "d", "")], "doc_id long, text string, lang string")
    named = lambda df: sorted(map(tuple, language.predicted(docs, language.fitted(df, F.lit(True))).collect()))
    assert named(docs) == [(1, "en", 1.0), (2, "en", 1.0), (3, "und", 0.0), (4, "en", 1.0)]
    assert named(docs.limit(0)) == [(i, "und", 0.0) for i in (1, 2, 3, 4)]


def test_sample_is_bounded_and_fair(spark):
    rows = [(i, f"text {i}", "en") for i in range(3000)] + [(i, f"texte {i}", "fr") for i in range(3000, 3020)] + [(7, "same", "de")] * 2000 + [(9, "x" * 20_000, "long")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("draw", F.lit(1))
    found = Counter(lang for _, lang in language.sample(docs, F.lit(True), rows=300))
    assert found["en"] == 100 and found["fr"] == 20 and found["de"] <= 1 and set(found) <= {"en", "fr", "de"}
    assert set(lang for _, lang in language.sample(docs, F.lit(True), rows=300, most=1)) == {"en"}


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = QUERIES["op13_language"](spark, folder).join(docs.select("doc_id", "lang", "text"), "doc_id").collect()
    held = [r for r in rows if r.held_out and r.lang_pred != "und"]
    assert len(rows) == docs.count() and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert sum(r.lang_pred == r.lang for r in held) / len(held) > 0.98
    assert dict(QUERIES["op13_language"](spark, "/root/testdata/sf0.001").dtypes) == {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"}
