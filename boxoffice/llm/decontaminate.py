"""Benchmark decontamination with an FM-index per training shard (operator 8).

A shard is a few megabytes of documents. Its words become numbers: the place in the test set's vocabulary.
A test phrase lies within a run of at least as many vocabulary words as the shortest phrase has, so only
such runs enter the index, with a separator after each. All test phrases are searched backward through the
ranks of a wavelet tree, occurrences are located by sampled suffix positions, and their spans are merged.

The test set reaches the tasks as broadcasts of about ``BLOCK_BYTES`` of text, one at a time. A test set of one block
is one job without a shuffle; for each further block the documents are written once with the spans found so far.
Words are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxoffice.llm.fmindex import FMIndex
from boxoffice.llm.staging import drop, packed, quoted, staged
from boxoffice.llm.words import ALPHANUMERIC, pieces, span_hashes, texts, words

WINDOW = 10
BLOCK_BYTES = 16 << 20
SPANS = "array<struct<first:int,last:int>>"


@dataclass
class Phrases:
    """Distinct windows of some test items."""

    vocabulary: np.ndarray  # sorted word hashes
    by_length: dict[int, np.ndarray]  # windows of that many words, as places in the vocabulary
    owners: dict[int, tuple[np.ndarray, np.ndarray]]  # for each length: bounds per window, item numbers
    items: np.ndarray  # item ids as text, sorted

    @property
    def shortest(self) -> int:
        return min(self.by_length, default=0)


def phrases(ids: list[str], column: pa.Array, window: int = WINDOW) -> Phrases:
    t = texts(column, lower=True)
    w = words(t, ALPHANUMERIC)
    hashes = span_hashes(t.data, w.starts, w.ends)
    vocabulary, numbers = np.unique(hashes, return_inverse=True)
    items, item_of = np.unique(np.array(ids, dtype=object).astype(str), return_inverse=True) if ids else (np.array([], str), np.array([], int))
    counts = np.diff(w.first)
    by_length, owners = {}, {}
    for length in np.unique(np.minimum(counts[counts > 0], window)).tolist():
        rows = np.flatnonzero(counts == length if length < window else counts >= window)
        each = counts[rows] - length + 1
        own = np.repeat(rows, each)
        starts = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each) + w.first[own]
        table, which = np.unique(numbers[starts[:, None] + np.arange(length)], axis=0, return_inverse=True)
        pairs = np.unique(np.stack([which.ravel(), item_of[own]], axis=1), axis=0)
        by_length[length] = table.astype(np.int64)
        owners[length] = (np.searchsorted(pairs[:, 0], np.arange(len(table) + 1)), pairs[:, 1])
    return Phrases(vocabulary, by_length, owners, items)


def blocks(benchmark: DataFrame, window: int, block_bytes: int) -> Iterator[Phrases]:
    """The test set in parts of about ``block_bytes`` of text, of which one at a time is on the driver; one part at least.

    Spark deals the rows out by their hash, so no part passes with the others.
    """
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = rows.distinct().agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-size // block_bytes))
    dealt = rows.distinct().withColumn("part", F.pmod(F.xxhash64("item", "text"), F.lit(parts)))
    if parts > 1:
        dealt = staged(dealt, "benchmark")
    for n in range(parts):
        held = sorted(dealt.filter(F.col("part") == n).select("item", "text").collect())
        yield phrases([r.item for r in held], pa.array([r.text for r in held], pa.large_string()), window)


@dataclass
class Found:
    n_words: np.ndarray
    spans: list[list[tuple[int, int]]]  # words, first and one after last
    cuts: list[list[tuple[int, int]]]  # the same in bytes
    items: list[list[str]]


def occurrences(numbers: np.ndarray, known: np.ndarray, first: np.ndarray, p: Phrases) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(length, window, word)`` of every phrase found in a shard's words."""
    if not known.any():
        return
    # runs of known words within a text
    edge = np.zeros(len(known) + 1, bool)
    edge[first] = True
    starts = np.flatnonzero(known & (edge[:-1] | ~np.concatenate([[False], known[:-1]])))
    ends = np.flatnonzero(known & (edge[1:] | ~np.concatenate([known[1:], [False]]))) + 1
    long = ends - starts >= p.shortest
    starts, sizes = starts[long], (ends - starts)[long]
    if not len(starts):
        return
    # 0 ends the sequence, 1 ends a run
    at = np.arange((sizes + 1).sum()) - np.repeat(np.cumsum(sizes + 1) - sizes - 1 - starts, sizes + 1)
    symbols = np.append(np.where(at == np.repeat(starts + sizes, sizes + 1), 1, numbers[np.minimum(at, len(numbers) - 1)] + 2), 0)
    used, symbols = np.unique(symbols, return_inverse=True)  # 0 and 1 keep their numbers
    place = np.full(len(p.vocabulary) + 2, -1)
    place[used] = np.arange(len(used))
    index = FMIndex(symbols, len(used))
    for length, table in p.by_length.items():
        asked = place[table + 2]
        here = np.flatnonzero((asked >= 0).all(axis=1))
        which, low, high = index.search(asked[here])
        of, position = index.locate(low, high)
        yield length, here[which][of], at[position]


def found_in(column: pa.Array, p: Phrases, earlier: list | None = None, earlier_items: list | None = None) -> Found:
    t = texts(column, lower=True)
    w = words(t, ALPHANUMERIC)
    n = len(w.starts)
    hashes = span_hashes(t.data, w.starts, w.ends)
    numbers = np.minimum(np.searchsorted(p.vocabulary, hashes), max(len(p.vocabulary) - 1, 0))
    known = p.vocabulary[numbers] == hashes if len(p.vocabulary) else np.zeros(n, bool)
    cover = np.zeros(n + 1, np.int64)
    rows = w.rows()
    pairs = []
    for length, window, word in occurrences(numbers, known, w.first, p):
        np.add.at(cover, word, 1)
        np.add.at(cover, word + length, -1)
        bounds, items = p.owners[length]
        hits = np.unique(np.stack([rows[word], window], axis=1), axis=0)
        sizes = bounds[hits[:, 1] + 1] - bounds[hits[:, 1]]
        of = np.repeat(np.arange(len(hits)), sizes)
        item = items[np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + bounds[hits[of, 1]]]
        pairs.append(np.stack([hits[of, 0], item], axis=1))
    for row, spans in enumerate(earlier or []):
        for a, b in spans or []:
            cover[w.first[row] + a] += 1
            cover[w.first[row] + b] -= 1
    hit = np.cumsum(cover[:-1]) > 0
    edge = np.zeros(n + 1, bool)
    edge[w.first] = True
    starts = np.flatnonzero(hit & (edge[:-1] | ~np.concatenate([[False], hit[:-1]])))
    ends = np.flatnonzero(hit & (edge[1:] | ~np.concatenate([hit[1:], [False]]))) + 1
    spans, cuts = [[] for _ in range(len(t))], [[] for _ in range(len(t))]
    for row, a, b in zip(rows[starts].tolist(), starts.tolist(), ends.tolist(), strict=True):
        spans[row].append((a - int(w.first[row]), b - int(w.first[row])))
        cuts[row].append((int(w.starts[a] - t.begins[row]), int(w.ends[b - 1] - t.begins[row])))
    names = [set(x or []) for x in earlier_items] if earlier_items else [set() for _ in range(len(t))]
    if pairs:
        for row, item in np.unique(np.concatenate(pairs), axis=0).tolist():
            names[row].add(str(p.items[item]))
    return Found(np.diff(w.first), spans, cuts, [sorted(x) for x in names])


def without(text: str | None, cuts: list[tuple[int, int]]) -> str | None:
    if not cuts:
        return text
    raw, kept, at = text.encode(), [], 0
    for a, b in cuts:
        kept.append(raw[at:a])
        at = b
    return b"".join([*kept, raw[at:]]).decode()


def searched(docs: DataFrame, row, benchmark: DataFrame, window: int, block_bytes: int, cut: bool) -> DataFrame:
    """``(row, text, n_words, spans, items)``; ``text`` is null, or with ``cut`` the text without the spans.

    Each part of the test set is one pass. Before the next one, what was found so far is written beside the
    texts, and the broadcast of the part is given up.
    """
    df = docs.select(row.alias("row"), F.col("text").cast("string").alias("text"), F.lit(0).cast("long").alias("n_words"), F.lit(None).cast(SPANS).alias("spans"), F.lit(None).cast("array<string>").alias("items"))
    context, before, now = docs.sparkSession.sparkContext, None, None
    for part in blocks(benchmark, window, block_bytes):
        if now is not None:
            after = staged(passed(df, now, False, True), "spans")
            now.destroy()
            if before is not None:
                drop(before)
            df = before = after
        now = context.broadcast(part)
    return passed(df, now, True, cut)


def passed(df: DataFrame, block: Broadcast[Phrases], is_last: bool, cut: bool) -> DataFrame:
    spans_type = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a, b in pieces(whole.column("text")):
                part = whole.slice(a, b - a)
                text = part.column("text")
                before = [None if x is None else [(s["first"], s["last"]) for s in x] for x in part.column("spans").to_pylist()]
                f = found_in(text, block.value, before, part.column("items").to_pylist())
                if is_last:
                    text = pa.array([without(x, c) for x, c in zip(text.to_pylist(), f.cuts, strict=True)] if cut else [None] * len(part), pa.string())
                spans = pa.array([[{"first": x, "last": y} for x, y in s] for s in f.spans], spans_type)
                yield pa.RecordBatch.from_arrays([part.column("row"), text, pa.array(f.n_words.astype(np.int64)), spans, pa.array(f.items, pa.list_(pa.string()))], ["row", "text", "n_words", "spans", "items"])

    return df.mapInArrow(run, df.schema)


def n_hit():
    return F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"])


def find_passages(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``(doc_id, n_words, n_hit, spans, items)`` of each row of ``docs(doc_id, text, ..)``.

    Words are runs of letters a-z (A-Z lower-cased), digits and characters beyond ASCII. A test phrase is
    ``window`` consecutive words of a ``benchmark(item_id, text)`` row, or all words of a shorter one;
    rows without words have none. ``spans`` are the merged word ranges (last excluded) of all occurrences,
    ``items`` the ids, sorted as text, of the items with an occurring phrase (a null id counts as ""; a
    repeated id counts once). Null and empty texts have no words. Repeated documents keep a row each, with
    or without doc_id. Other columns are ignored; no documents give no rows, no test items no hits.
    """
    df = searched(docs, F.col("doc_id"), benchmark, window, block_bytes, cut=False)
    return df.select(F.col("row").alias("doc_id"), "n_words", n_hit().alias("n_hit"), "spans", "items")


def without_passages(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with the spans of test phrases cut out of ``text``, from the first word to the end of the last.

    A document in which every word was hit is left out; all others, empty ones too, stay. Columns other
    than ``text`` are as they were.
    """
    others = [c for c in docs.columns if c != "text"]
    df = searched(docs, packed(others), benchmark, window, block_bytes, cut=True)
    kept = df.filter(~((n_hit() > 0) & (n_hit() == F.col("n_words"))))
    return kept.select(*[F.col("text") if c == "text" else F.col(f"row.{quoted(c)}").alias(c) for c in docs.columns])
