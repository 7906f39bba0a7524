"""Round trips through the files, against the library on whole texts."""

import random
import tempfile
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from boxoffice.llm import pretokenized, tokenfile
from boxoffice.llm.queries import QUERIES

PATH = P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return lambda text: [*t.encode(text or "", add_special_tokens=False).ids, 0]


def folder():
    return tempfile.mkdtemp(prefix="run-") + "/tokens"


def test_odd_rows(spark, library):
    rows = [(9, "It's  here\n\n<|endoftext|> 漢字 🙂 ß1234"), (2, None), (1, ""), (5, "same"), (5, "same"), (5, "other one"), (None, "no id"), (7, "word " * 50_000), (8, "x" * 50_000), (3, "ਪੰਜਾਬੀ don't \U0001e6d0"), (-4, " ")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("start", F.lit("x")).withColumn("part", F.lit(1))
    path = folder()
    tokenfile.write(df.repartition(3), PATH, path)
    got = tokenfile.read(spark, path).orderBy("start", "n_tokens").collect()
    want = sorted(((i, library(t)) for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, len(r[1])))
    start = 0
    assert [r.doc_id for r in got] == [i for i, _ in want]
    for r, (_, ids) in zip(got, want, strict=True):
        raw = np.array(ids, "<u4").tobytes()
        assert (r.start, r.n_tokens, bytes(r["ids"]), r.ids_crc32) == (start, len(ids), raw, zlib.crc32(raw))
        start += len(ids)
    one = tokenfile.read_documents(spark, path, [9, 5, 77]).collect()
    assert sorted((r.doc_id, r.start, bytes(r["ids"])) for r in one) == sorted((r.doc_id, r.start, bytes(r["ids"])) for r in got if r.doc_id in (9, 5))
    index = spark.read.parquet(f"{path}/index")
    assert index.count() == len(rows) and index.agg(F.max(F.col("start") + F.col("n_tokens"))).first()[0] == start
    empty = folder()
    tokenfile.write(df.limit(0), PATH, empty)
    assert tokenfile.read(spark, empty).count() == 0 and spark.read.parquet(f"{empty}/index").count() == 0


def test_whole_table(spark, library):
    sf_dir = "/root/testdata/sf0.001"
    rows = sorted((r.doc_id, library(r.text)) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect())
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in QUERIES["op5_token_files"](spark, sf_dir).collect()}
    start = 0
    for i, ids in rows:
        assert got.pop(i) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert not got


def test_pieces_by_the_model(library):
    encode = tokenfile.Encoder(open(PATH, encoding="utf-8").read())
    rng = random.Random(3)
    alphabet = [*"aZé1 \n\t'.漢🙂\x00\x7f\xa0", "ing", "the ", "  ", "'ll"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 40))) for _ in range(3000)]
    assert encode(texts) == [np.array(library(t), "<u2").tobytes() for t in texts]
    assert encode.pieces.encode_pieces == encode.split_pieces


def test_forgotten_pieces_are_encoded_again(library, monkeypatch):
    monkeypatch.setattr(pretokenized, "MEMO_ENTRIES", 20)
    monkeypatch.setattr(pretokenized, "PIECE_CHARS", 100)
    encode = tokenfile.Encoder(open(PATH, encoding="utf-8").read())
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["alpha", "béta", "gamma", "δ", "word" * 90]) + str(rng.randrange(30)) for _ in range(rng.randrange(0, 30))) for _ in range(200)]
    for part in (texts[:100], texts[100:], texts):
        assert encode(part) == [np.array(library(t), "<u2").tobytes() for t in part]
    assert len(encode.pieces.known) <= 200


def test_query_encodes_added_tokens_as_the_library_does(spark):
    library = Tokenizer.from_file(PATH)
    texts = {1: "end <|endoftext|> next", 2: "<|endoftext|><|endoftext|>", 3: "no <|ENDOFTEXT|> but text", 4: "plain text"}
    sf_dir = tempfile.mkdtemp(prefix="run-")
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{sf_dir}/documents.parquet")
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in QUERIES["op5_token_files"](spark, sf_dir).collect()}
    start = 0
    for i, text in texts.items():
        ids = [*library.encode(text, add_special_tokens=False).ids, 0]
        assert got[i] == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        assert (50256 in ids) == (i < 3)
        start += len(ids)
