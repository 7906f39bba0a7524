"""The pipeline, stage by stage, against plain versions of what each stage decides."""

import base64
import hashlib
import re

import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from boxoffice.llm import compression, pii
from boxoffice.llm.labelled import fold
from tests.llm.test_decontaminate import WORD, LOWER, plain as plain_passages
from tests.llm.test_simhash import plain as plain_groups

FOLDER = "/root/testdata/sf0.001"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def odd(spark):
    """The smallest documents with odd rows and columns that clash with names of the operators."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    some = [r.text for r in docs.filter("n_chars > 300").orderBy("doc_id").limit(3).collect()]
    extra = [(None, some[0]), (None, "a text of its own without any id"), (10_000, None), (10_001, ""), (10_002, some[1]), (10_002, some[1]), (10_002, some[2] + " more"), (10_003, "z" * 100_000)]
    more = spark.createDataFrame([(i, t, None, "odd", None) for i, t in extra], docs.schema)
    clash = docs.unionByName(more)
    for name in ("score", "row", "bits", "root", "spans", "items", "n_entities", "found", "id_key"):
        clash = clash.withColumn(name, F.lit(name))
    nested = {"col1": F.lit("c"), "_": F.lit(1), "tags": F.create_map(F.lit("k"), F.col("doc_id")), "meta": F.struct(F.lit(1).alias("a"), F.lit("b").alias("row")), "a.b": F.lit(2.5)}
    return clash.withColumns(nested)


def test_stages_keep_the_columns(spark, odd):
    for _, stage in corpus_pipeline.STAGES[:-1]:
        for docs in (odd, odd.limit(0)):
            out = stage(spark, docs, FOLDER)
            assert out.columns == docs.columns and [k for _, k in out.dtypes] == [k for _, k in docs.dtypes]
            assert (out.count() > 0) == (docs is odd)
    assert corpus_pipeline.encoded(spark, odd.limit(0), FOLDER).count() == 0


def test_quality(spark, odd):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    model = compression.fitted(odd, labels, "quality", fold("doc_id", 4) != 2)
    want = [r for r in odd.collect() if model.scores([r.text or ""])[0] >= 0.7]
    assert rows(corpus_pipeline.quality(spark, odd, FOLDER)) == sorted(map(tuple, want), key=repr)


def test_near_duplicates(spark, odd):
    given = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    judged = {(i, t): plain_groups([(i, t)])[0][1] for i, t in given}
    of_print = {p: c for _, p, c in plain_groups(given)}
    left = [(r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, odd, FOLDER).collect()]
    assert len(left) == len(set(left)) and set(left) <= set(given)
    named = [(i, t) for i, t in left if i is not None]
    # each group with a document that has an id is there once, by its smallest
    assert sorted(of_print[judged[x]] for x in named) == sorted(i for i, _ in named)
    assert {c for c in of_print.values() if c is not None} == {i for i, _ in named}
    assert [t for i, t in left if i is None] == ["a text of its own without any id"]


def test_decontaminated(spark, odd):
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    docs = odd.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    before = {r.doc_id: r for r in docs.collect()}
    after = {r.doc_id: r for r in corpus_pipeline.decontaminated(spark, docs, FOLDER).collect()}
    found = {i: (n, hit) for i, n, hit, _ in plain_passages([(i, r.text) for i, r in before.items()], bench)}
    assert before.keys() - after.keys() == {i for i, (n, hit) in found.items() if hit and hit == n}
    assert sum(hit > 0 for _, hit in found.values()) >= 3
    for i, r in after.items():
        n, hit = found[i]
        assert len(WORD.findall((r.text or "").translate(LOWER))) == n - hit
        assert r.n_chars == (None if r.text is None else len(r.text))
        assert hit or r.text == before[i].text


def test_run(spark):
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, FOLDER).collect()}
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, FOLDER).collect(), docs.schema)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    last = docs.collect()
    assert len(got) == len(last) > 100
    for r in last:
        ids = b"".join(i.to_bytes(4, "little") for i in library.encode_ordinary(r.text))
        assert bytes(got[r.doc_id]["ids"]) == ids and got[r.doc_id].decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest()
        assert not re.search(r"\+1 \(\d{3}\) 555-", r.text)


def test_private_uses_no_python(spark, odd, capsys):
    corpus_pipeline.private(spark, odd, FOLDER).explain()
    assert not re.search("Python|Pandas|Arrow", capsys.readouterr().out)
    assert pii.PATTERNS
