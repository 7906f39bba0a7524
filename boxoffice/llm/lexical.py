"""Ranked lexical search over K2-treaps of term impacts (operator 12).

`build` cuts the documents into shards of about ``SHARD_BYTES`` of text and writes one treap per shard: rows are its
terms, the frequent ones first, columns its documents, values the impacts without the term's weight. `search` reads them with the items in
blocks: a task goes through its shards and carries each item's best documents so far, whose last score is what a range
must reach in the next. Only these best few leave a task.

    impact(tf, n) = 10**9 * tf div (1000 * tf + 8 * m),  m = 10 + 90 * n * N div L
    weight(df)    = floor(1000 * ln((2 * N + 2) / (2 * df + 1)))

N documents have a term, L is the number of all terms, n that of one document.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from boxoffice.llm.staging import drop, new_path, staged
from boxoffice.llm.treap import OpenTreap, Treap
from boxoffice.llm.words import ALPHANUMERIC, pieces, span_hashes, texts, words

SHARD_BYTES = 4 << 20
GROUP_BYTES = 16 << 20  # of a row group of the index, which is what a task reads at a time
BLOCK_TERMS = 200_000  # terms of the items that are searched for together, about
BEST = 10

SHARD = "docs array<long>, terms binary, rank binary, df binary, depth int, mask binary, row binary, column binary, less binary"


@dataclass
class Index:
    path: str
    n_docs: int  # N
    n_terms: int  # L

    def weight(self, df: int) -> int:
        return math.floor(1000 * math.log((2 * self.n_docs + 2) / (2 * df + 1)))


def only_text(docs: DataFrame, key: str, kind: str | None = None) -> DataFrame:
    return docs.select(F.col(key).cast(kind) if kind else F.col(key), F.col("text").cast("string").alias("text"))


def statistics(docs: DataFrame) -> tuple[int, int]:
    """N and L."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = terms = 0
        for batch in batches:
            column = batch.column("text")
            for a, b in pieces(column):
                n = np.diff(words(texts(column.slice(a, b - a), lower=True), ALPHANUMERIC).first)
                some, terms = some + int((n > 0).sum()), terms + int(n.sum())
        yield pa.RecordBatch.from_pydict({"some": [some], "terms": [terms]})

    row = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "some long, terms long").agg(F.sum("some"), F.sum("terms")).first()
    return int(row[0] or 0), int(row[1] or 0)


def shard(column: pa.Array, n_docs: int, n_terms: int) -> dict:
    """The arrays of one shard."""
    t = texts(column, lower=True)
    w = words(t, ALPHANUMERIC)
    n = np.diff(w.first)
    hashes = span_hashes(t.data, w.starts, w.ends)
    order = np.argsort(hashes, kind="stable")  # documents stay in order within a term
    hashes, doc = hashes[order], w.rows()[order]
    new = np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])])[: len(hashes)]
    first = np.flatnonzero(new)
    tf = np.diff(np.append(first, len(hashes)))
    hashes, doc = hashes[first], doc[first]
    names, begin, df = np.unique(hashes, return_index=True, return_counts=True)
    rank = np.empty(len(names), np.int64)
    rank[np.argsort(-df, kind="stable")] = np.arange(len(names))
    m = 10 + (90 * n * n_docs) // max(1, n_terms)
    impact = (10**9 * tf) // (1000 * tf + 8 * m[doc])
    row = np.repeat(rank, df)
    some = impact > 0
    treap = Treap.of(row[some], doc[some], impact[some])
    return {
        "terms": names.astype("<u8"),
        "rank": rank.astype("<i4"),
        "df": df.astype("<i4"),
        "mask": treap.mask.astype(np.uint8),
        "row": treap.row.astype("<u4"),
        "column": treap.column.astype("<u4"),
        "less": treap.less.astype("<u4"),
        "depth": treap.depth,
    }


def build(docs: DataFrame) -> Index:
    """Writes the index of ``docs(doc_id, text, ..)`` to the shared folder.

    Terms are runs of letters, digits and characters beyond ASCII, of which A-Z only are lower-cased; they are compared by 64-bit
    hashes. Texts without terms (null, empty) are in no result and do not count. Every row is a document, repeated
    ones too; other columns are ignored. A text of any length is in one shard.
    """
    n_docs, n_terms = statistics(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, column = batch.column("doc_id"), batch.column("text")
            for a, b in pieces(column, SHARD_BYTES):
                parts = shard(column.slice(a, b - a), n_docs, n_terms)
                arrays = {"docs": pa.array([ids.slice(a, b - a).to_pylist()], pa.list_(pa.int64())), "depth": pa.array([parts.pop("depth")], pa.int32())}
                arrays |= {name: pa.array([part.tobytes()], pa.binary()) for name, part in parts.items()}
                names = [f.split()[0] for f in SHARD.split(", ")]
                yield pa.RecordBatch.from_arrays([arrays[name] for name in names], names)

    path = new_path(docs.sparkSession, "lexical")
    shards = only_text(docs, "doc_id", "long").mapInArrow(run, SHARD)
    # a shard is large, so sizes are looked at after each, not every hundred rows
    writer = shards.write.option("compression", "zstd").option("parquet.block.size", GROUP_BYTES)
    writer.option("parquet.page.size.row.check.min", 1).option("parquet.page.size.row.check.max", 1).parquet(path)
    return Index(path, n_docs, n_terms)


def item_terms(items: DataFrame) -> DataFrame:
    """``(item_id, term)``, each pair once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, column = batch.column("item_id"), batch.column("text")
            for a, b in pieces(column):
                t = texts(column.slice(a, b - a), lower=True)
                w = words(t, ALPHANUMERIC)
                pairs = np.unique(np.stack([w.rows().astype(np.uint64), span_hashes(t.data, w.starts, w.ends)]), axis=1)
                rows = ids.slice(a, b - a).take(pa.array(pairs[0].astype(np.int64)))
                yield pa.RecordBatch.from_arrays([rows, pa.array(pairs[1].view(np.int64))], ["item_id", "term"])

    kind = items.schema["item_id"].dataType.simpleString()
    return only_text(items, "item_id").mapInArrow(run, f"item_id {kind}, term long").distinct()


@dataclass
class Block:
    """Items that are searched for together: item i has the terms ``first[i] : first[i + 1]``."""

    ids: pa.Array
    first: np.ndarray
    terms: np.ndarray
    weights: np.ndarray | None = None

    @classmethod
    def of(cls, rows: DataFrame) -> Block:
        table = rows.toArrow().sort_by([("item_id", "ascending"), ("term", "ascending")])
        ids = table["item_id"].combine_chunks()
        codes = ids.dictionary_encode(null_encoding="encode")
        _, first = np.unique(codes.indices.to_numpy(), return_index=True)
        return cls(codes.dictionary, np.append(first, len(ids)), table["term"].to_numpy().view(np.uint64))


def present(names: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of ``asked`` are in the sorted ``names``, and where."""
    at = np.minimum(np.searchsorted(names, asked), max(len(names) - 1, 0))
    there = np.flatnonzero(names[at] == asked) if len(names) else np.zeros(0, np.int64)
    return there, at[there]


def document_counts(shards: DataFrame, asked: np.ndarray) -> np.ndarray:
    """In how many documents each term of the sorted ``asked`` is."""
    shared = shards.sparkSession.sparkContext.broadcast(asked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(shared.value), np.int64)
        for batch in batches:
            for names, df in zip(batch.column("terms"), batch.column("df"), strict=True):
                there, at = present(np.frombuffer(names.as_py(), "<u8"), shared.value)
                total[there] += np.frombuffer(df.as_py(), "<i4")[at]
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["place", "df"])

    counts = np.zeros(len(asked), np.int64)
    found = shards.select("terms", "df").mapInArrow(run, "place long, df long").groupBy("place").agg(F.sum("df").alias("df")).toArrow()
    counts[found["place"].to_numpy()] = found["df"].to_numpy()
    shared.destroy()
    return counts


class Best:
    """The best few documents of one item so far."""

    def __init__(self, most: int):
        self.most = most
        self.rows: list[tuple[int, bool, int]] = []  # (-score, no id, id)

    def least(self) -> int:
        return -self.rows[-1][0] if len(self.rows) == self.most else 1

    def add(self, ids: list[int | None], scores: np.ndarray) -> None:
        self.rows += [(-int(s), i is None, i or 0) for i, s in zip(ids, scores, strict=True) if s >= self.least()]
        self.rows.sort()
        del self.rows[self.most :]


def hits(shards: DataFrame, shared: Broadcast[Block], kind: str, most: int) -> DataFrame:
    """``(item_id, doc_id, score)``: for each item the best documents of each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = shared.value
        best = [Best(most) for _ in range(len(b.first) - 1)]
        for batch in batches:
            for row in range(batch.num_rows):
                get = lambda name, dtype: np.frombuffer(batch.column(name)[row].as_py(), dtype)  # noqa: B023, E731
                ids = batch.column("docs")[row].as_py()
                fields = [get(name, kind).astype(np.int64) for name, kind in (("mask", np.uint8), ("row", "<u4"), ("column", "<u4"), ("less", "<u4"))]
                treap = OpenTreap(Treap(batch.column("depth")[row].as_py(), *fields))
                there, at = present(get("terms", "<u8"), b.terms)
                rank = get("rank", "<i4")[at].astype(np.int64)
                bounds = np.searchsorted(there, b.first)
                for item, (x, y) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
                    mine = best[item]
                    treap.search(rank[x:y], b.weights[there[x:y]], mine.least, lambda c, s, mine=mine, ids=ids: mine.add([ids[i] for i in c], s))
        for item, found in enumerate(best):
            if found.rows:
                docs = pa.array([None if none else i for _, none, i in found.rows], pa.int64())
                scores = pa.array([-s for s, *_ in found.rows], pa.int64())
                yield pa.RecordBatch.from_arrays([b.ids.take(pa.array([item] * len(docs))), docs, scores], ["item_id", "doc_id", "score"])

    return shards.mapInArrow(run, f"item_id {kind}, doc_id long, score long")


def search(spark: SparkSession, index: Index, items: DataFrame, most: int = BEST, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """``items(item_id, text, ..)`` -> ``(item_id, rank, doc_id, score)``: the ``most`` highest-scoring documents of each.

    A document scores the weighted impacts of the item's distinct terms; only scores above 0 are listed, equal ones by
    doc_id, without doc_id last. Rows of one item_id, null too, are one item with the terms of all. Items without
    terms (null, empty) and items of which no document has a term have no rows; neither has an empty index. The
    items go in blocks of about ``block_terms`` terms, of which one at a time is on the driver and with the tasks.
    """
    asked = staged(item_terms(items), "item-terms")
    kind = items.schema["item_id"].dataType.simpleString()
    shards = spark.read.schema(SHARD).parquet(index.path)
    path = new_path(spark, "hits")
    blocks = -(-asked.count() // block_terms)
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    for n in range(blocks):
        block = Block.of(asked.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == n))
        if not len(block.terms):
            continue
        distinct, which = np.unique(block.terms, return_inverse=True)
        counts = document_counts(shards, distinct)
        block.weights = np.array([index.weight(int(df)) for df in counts], np.int64)[which]
        shared = spark.sparkContext.broadcast(block)
        found = hits(shards, shared, kind, most).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)
        found.select("item_id", "rank", "doc_id", "score").write.parquet(f"{path}/block={n}")
        shared.destroy()
    drop(asked)
    result = f"item_id {kind}, rank int, doc_id long, score long"
    return spark.read.schema(f"{result}, block int").parquet(path).drop("block") if blocks else spark.createDataFrame([], result)
