"""SimHash near-duplicates by deletion-variant signatures (operator 10).

A fingerprint has 64 bits. Cut into two segments of 32 bits, two fingerprints that differ in at most two
bits have one segment that differs in at most one. Each segment is indexed as it is and in 32 variants
with one bit deleted; fingerprints that agree in a variant are joined on it and verified.

Fingerprints are joined, not documents: exact copies share one. In a variant that more than ``CROWD``
fingerprints share (templates with a few changing words) pairs would grow with the square of their number.
There the members are grouped instead by every value that one bit can turn them into: two fingerprints
have such a value in common just if they differ in at most two bits, so one link to the smallest member
of the group is as good as all pairs.

Joins are sort-merge joins: what they join grows with the documents, but its files are so small (variants are
made of few bits) that Spark would take it for a small table and collect it on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxoffice.llm.staging import quoted, staged
from boxoffice.llm.words import NOT_SPACE, pieces, texts, words
from boxoffice.llm.xxh64 import xxh64
from boxoffice.operators.conflicts import components
from boxoffice.operators.spread import spread_join

SHINGLE = 3
MOST_BITS = 2
CROWD = 32
SEED = 42
HALF = (1 << 32) - 1
PIECE_BYTES = 1 << 18  # of text fingerprinted at a time


def fingerprints(column: pa.Array, shingle: int = SHINGLE) -> np.ndarray:
    """64-bit fingerprints of texts; 0 for a text without words."""
    t = texts(column, lower=True)
    w = words(t, NOT_SPACE)
    counts = np.diff(w.first)
    out = np.zeros(len(t), np.uint64)
    if not len(w.starts):
        return out
    # words with one space after each
    keep = np.zeros(len(t.data), bool)
    keep[:-8] = NOT_SPACE[t.data[:-8]]
    keep[w.ends] = True
    data = np.append(t.data[keep], np.zeros(8, np.uint8))
    lengths = w.ends - w.starts
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    data[ends] = 0x20
    # the words that begin a shingle, and how far it goes
    rest = np.repeat(w.first[1:], counts) - np.arange(len(starts))
    begins = np.flatnonzero((rest >= shingle) | (rest == np.repeat(counts, counts)))
    lasts = begins + np.minimum(rest[begins], shingle) - 1
    hashes = xxh64(data, starts[begins], ends[lasts], SEED)
    rows = np.flatnonzero(counts)
    per_row = np.maximum(counts[rows] - shingle + 1, 1)
    firsts = np.cumsum(per_row) - per_row
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    set_bits = np.add.reduceat(bits, firsts, axis=0, dtype=np.int64)
    out[rows] = np.packbits(2 * set_bits > per_row[:, None], axis=1, bitorder="little").view("<u8").ravel()
    return out


def row_keys() -> list:
    """Columns that tell rows apart: doc_id (0 for null) and a hash of the text and of whether there is a doc_id."""
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id_key"), F.xxhash64(F.col("doc_id").isNull(), F.col("text").cast("string")).alias("text_key")]


def with_fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``(doc_id, text_key, bits)`` of each document; ``bits`` is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column("text")
            found = [fingerprints(text.slice(a, b - a), shingle).view(np.int64) for a, b in pieces(text, PIECE_BYTES)]
            if found:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array(np.concatenate(found))], ["doc_id", "text_key", "bits"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_keys()[1], F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, text_key long, bits long")


def differing(a: str, b: str):
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def with_variants(prints: DataFrame) -> DataFrame:
    """``(bits, part, gap, rest)``: a segment as it is (gap -1), or with the bit ``gap`` deleted."""
    high = F.shiftrightunsigned("bits", 32)
    low = F.col("bits").bitwiseAND(F.lit(HALF))
    halves = prints.select("bits", F.explode(F.array(F.struct(F.lit(0).alias("part"), low.alias("half")), F.struct(F.lit(1).alias("part"), high.alias("half")))).alias("s"))
    gaps = F.explode(F.sequence(F.lit(-1), F.lit(31))).alias("gap")
    without = F.col("half").bitwiseAND(F.bitwise_not(F.expr("CASE WHEN gap < 0 THEN 0L ELSE shiftleft(1L, gap) END")))
    return halves.select("bits", "s.part", "s.half", gaps).select("bits", "part", "gap", without.alias("rest"))


def links(prints: DataFrame, most_bits: int = MOST_BITS, crowd: int = CROWD) -> DataFrame:
    """``(u, v)``: links between distinct fingerprints ``prints(bits)`` that join all within ``most_bits``.

    Every fingerprint is reached from every other within ``most_bits`` over these links, and each link is
    within ``most_bits``; ``most_bits`` is 0, 1 or 2.
    """
    if not 0 <= most_bits <= 2:
        raise ValueError("two segments with one deletion find up to 2 differing bits")
    # few files hold the fingerprints, but each makes 66 rows
    tasks = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    variants = with_variants(prints.repartition(tasks, "bits"))
    key = ["part", "gap", "rest"]
    shared = variants.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1")
    # a half that many fingerprints share is cut into pieces
    index = staged(spread_join(variants, shared, key, "bits", "inner", merge=True), "simhash-index")
    few = index.filter(F.col("n") <= crowd)
    pairs = (
        few.select(*key, F.col("bits").alias("u"))
        .join(few.select(*key, F.col("bits").alias("v")).hint("merge"), key)
        .filter("u > v")
        .filter(differing("u", "v") <= most_bits)
        .select("u", "v")
    )
    if most_bits < 2:  # a value within one bit of both says nothing closer; one bit apart is itself such a value
        near = index.filter(F.col("n") > crowd).select("bits").distinct()
        turned = near.select(F.col("bits").alias("u"), F.explode(F.sequence(F.lit(0), F.lit(63))).alias("gap"))
        turned = turned.select("u", F.col("u").bitwiseXOR(F.expr("shiftleft(1L, gap)")).alias("v"))
        crowded = turned.join(near.select(F.col("bits").alias("v")).hint("merge"), "v").filter(differing("u", "v") <= most_bits).select("u", "v")
        return pairs.unionByName(crowded).distinct()
    near = index.filter(F.col("n") > crowd).select("bits").distinct()
    turned = near.select(F.col("bits").alias("u"), F.explode(F.sequence(F.lit(-1), F.lit(63))).alias("gap"))
    turned = turned.select("u", F.expr("CASE WHEN gap < 0 THEN u ELSE u ^ shiftleft(1L, gap) END").alias("met"))
    least = turned.groupBy("met").agg(F.min("u").alias("v"), F.count("*").alias("n")).filter("n > 1").drop("n")
    crowded = turned.join(least.hint("merge"), "met").filter("u > v").select("u", "v")
    return pairs.unionByName(crowded).distinct()


def grouped(docs: DataFrame, shingle: int, most_bits: int, crowd: int) -> tuple[DataFrame, DataFrame]:
    """``(doc_id, text_key, bits)`` of each row, and the ``(bits, least_id, root)`` of each fingerprint.

    ``root`` is the smallest fingerprint that links reach, ``least_id`` the smallest doc_id of ``bits``.
    """
    rows = staged(with_fingerprints(docs, shingle), "fingerprints")
    prints = staged(rows.groupBy("bits").agg(F.min("doc_id").alias("least_id")), "prints")
    groups = components(links(prints.select("bits"), most_bits, crowd))
    own = prints.join(groups.select(F.col("id").alias("bits"), F.col("component").alias("root")).hint("merge"), "bits", "left")
    return rows, own.select("bits", "least_id", F.coalesce("root", "bits").alias("root"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, most_bits: int = MOST_BITS, crowd: int = CROWD) -> DataFrame:
    """``docs(doc_id, text, ..)`` -> ``(doc_id, fingerprint, component_id)``, one row per row.

    Words are runs of other than ASCII white space, A-Z lower-cased; shingles of fewer words than
    ``shingle`` are the whole text, and a text without words (empty, null) has fingerprint zero and is
    linked like any other. ``component_id`` is the smallest doc_id reached over links of at most
    ``most_bits`` differing bits. A doc_id is a whole number. Repeated rows keep a row each. A null doc_id keeps its row and is never a
    component_id unless its group has no other (then null). Other columns are ignored; no rows give no rows.
    """
    rows, own = grouped(docs, shingle, most_bits, crowd)
    least = own.groupBy("root").agg(F.min("least_id").alias("component_id"))
    of_bits = staged(spread_join(own, least, ["root"], "bits", "inner", merge=True).select("bits", "component_id"), "components")
    return spread_join(rows, of_bits, ["bits"], "doc_id", "inner", merge=True).select(
        "doc_id", F.lpad(F.lower(F.hex("bits")), 16, "0").alias("fingerprint"), "component_id"
    )


def one_of_each(docs: DataFrame, shingle: int = SHINGLE, most_bits: int = MOST_BITS, crowd: int = CROWD) -> DataFrame:
    """One row of ``docs`` for each group of `near_duplicates`: that of its component_id.

    Where several rows have this doc_id, one of them stays; a group without any doc_id keeps one row. All
    columns are as they were.
    """
    rows, own = grouped(docs, shingle, most_bits, crowd)
    # the first row of each fingerprint, then of each group
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")
    first = rows.groupBy("bits").agg(F.min(order).alias("first"))
    kept = first.join(own.select("bits", "root").hint("merge"), "bits").groupBy("root").agg(F.min("first").alias("first"))
    kept = kept.select(F.coalesce("first.doc_id", F.lit(0)).alias("id_key"), "first.text_key")
    # equal rows are one before the texts are moved
    columns = [F.col(quoted(c)) for c in docs.columns]
    # of rows with one id and text the least; values that have no order count as text
    rank = F.struct(*[F.to_json(F.struct(c)) if "map<" in kind or kind == "variant" else c for c, (_, kind) in zip(columns, docs.dtypes, strict=True)])
    whole = docs.groupBy(*row_keys()).agg(F.min_by(F.struct(*columns), rank).alias("row"))
    return whole.join(kept.hint("merge"), ["id_key", "text_key"], "left_semi").select("row.*")
