"""Encoding against the rank files' library."""

import base64
import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

from boxoffice.llm import bpe
from boxoffice.llm.queries import QUERIES

NAME = "byte_bpe_multi_50k.tiktoken"


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path(NAME), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(open(P.path(NAME), "rb").read(), P.PATTERN)


def plain(library, text):
    ids = library.encode_ordinary(text or "")
    raw = b"".join(i.to_bytes(4, "little") for i in ids)
    return len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


def test_random_pieces(library, codec):
    rng = random.Random(2)
    tokens = list(codec.ranks)
    for _ in range(3000):
        raw = b"".join(rng.choice(tokens) for _ in range(rng.randrange(1, 6)))
        assert codec.piece(raw) == library._encode_single_piece(raw)
    for _ in range(1000):
        raw = bytes(rng.choice(b"aeinrst \xc3\xa9") for _ in range(rng.randrange(1, 60)))
        assert codec.piece(raw) == library._encode_single_piece(raw)
    for raw in (b"a" * 5000, b" " * 5000, b"ab" * 3000, bytes(range(256)) * 20, "é漢".encode() * 2000):
        assert codec.piece(raw) == library._encode_single_piece(raw)


def test_odd_rows(spark, library):
    rows = [(1, None), (2, ""), (3, " "), (4, "I'm  here\n\n  <|endoftext|> 漢字 🙂 ß1234 %%%"), (4, "again"), (4, "again"), (None, "no id"), (5, "x" * 20_000), (6, "Two words " * 20_000), (7, "　a\x85b​c d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("x")).withColumn("n_tokens", F.lit(1))
    got = bpe.encoded(docs, P.path(NAME), P.PATTERN)
    assert sorted(((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got.collect()), key=repr) == sorted(((i, *plain(library, t)) for i, t in rows), key=repr)
    back = bpe.decoded(got, P.path(NAME))
    assert sorted(map(repr, back.collect())) == sorted(f"Row(doc_id={i!r}, text={t or ''!r})" for i, t in rows)
    assert bpe.encoded(docs.limit(0), P.path(NAME), P.PATTERN).count() == 0


def test_whole_table(spark, folder, library):
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in QUERIES["op6_bpe"](spark, folder).collect()}
    want = {r.doc_id: plain(library, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    assert got == want
