"""Passages that repeat themselves at once (operator 11).

A run is a stretch of words with a smallest period, many times as long as the period, that no neighbouring
word extends. `automaton.runs` finds all runs of a sequence. Most words cannot lie in one: with a length of at
least ``power`` periods (three at least), every three words in a row that a run holds occur ``power`` - 1 times
in the text, one of them at most a ``power``-th of the run away. So a text is first cut, for a megabyte at a time in
numpy, into stretches in which that holds, a few times over; a run lies within one such stretch, and so does
what could extend it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxoffice.llm.automaton import runs
from boxoffice.llm.words import MIX_1, MIX_2, MIX_3, NOT_SPACE, Texts, Words, mixed, pieces, span_hashes, texts, words

LEAST = 6  # words of a run
POWER = 4  # periods of a run
SEEN = 3  # words in a row that must come again
ROUNDS = 8  # of cutting; the stretches hold all runs after any number
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def stretches(hashes: np.ndarray, w: Words, least: int = LEAST, power: int = POWER) -> list[tuple[int, int]]:
    """Ranges of words, each within one text, that hold all runs."""
    rows = w.rows()
    n = len(hashes) - SEEN + 1
    if n <= 0:
        return []
    key = mixed(rows[:n].astype(np.uint64) * MIX_3 + hashes[:n])
    key = mixed(mixed(key * MIX_1 + hashes[1 : n + 1]) * MIX_2 + hashes[2:])
    at = np.flatnonzero(rows[:n] == rows[SEEN - 1 :])  # where the three words are of one text
    key = key[at]
    for _ in range(ROUNDS):
        if not len(at):
            return []
        # how often the three words come, and how far the nearest other place is
        order = np.argsort(key, kind="stable")
        same = np.diff(key[order]) == 0
        gap = np.where(same, np.diff(at[order]), len(hashes))
        nearest, often = np.empty(len(at), np.int64), np.empty(len(at), np.int64)
        nearest[order] = np.minimum(np.append(gap, len(hashes)), np.concatenate([[len(hashes)], gap]))
        group = np.cumsum(np.concatenate([[0], ~same]))
        often[order] = np.bincount(group)[group]
        first, last, of = neighbours(at)
        length = (last - first + SEEN)[of]
        good = (length >= least) & (often >= min(power - 1, max(least, power) - 2)) & (power * nearest <= length)
        if good.all():
            break
        at, key = at[good], key[good]
        # from now on three words are counted within their stretch
        key = mixed(key ^ (neighbours(at)[2].astype(np.uint64) * MIX_1))
    first, last, _ = neighbours(at)
    return [(a, b) for a, b in zip(at[first].tolist(), (at[last] + SEEN).tolist(), strict=True) if b - a >= least]


def neighbours(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last of each series of numbers without a gap, and the series of each; texts are two numbers apart."""
    if not len(at):
        return at, at, at
    cut = np.flatnonzero(np.diff(at) != 1)
    first, last = np.concatenate([[0], cut + 1]), np.append(cut, len(at) - 1)
    return first, last, np.repeat(np.arange(len(first)), last - first + 1)


def found_runs(t: Texts, w: Words, least: int = LEAST, power: int = POWER) -> dict[int, list[tuple[int, int, int]]]:
    """By text that has any: its runs as (start, length, period) in words, by start, then period."""
    out: dict[int, list[tuple[int, int, int]]] = {}
    hashes = span_hashes(t.data, w.starts, w.ends)
    rows = w.rows()
    for begin, end in stretches(hashes, w, least, power):
        _, ids = np.unique(hashes[begin:end], return_inverse=True)
        row = int(rows[begin])
        offset = begin - int(w.first[row])
        out.setdefault(row, []).extend((s + offset, n, p) for s, n, p in runs(ids.tolist(), least, power))
    return {row: sorted(mine, key=lambda r: (r[0], r[2])) for row, mine in out.items() if mine}


def collapsed(t: Texts, w: Words, found: dict[int, list[tuple[int, int, int]]]) -> list[bytes]:
    """The words of each text, joined by one space, without those after the first period of a run."""
    kept = np.zeros(len(t.data), bool)
    kept[:-8] = NOT_SPACE[t.data[:-8]]
    kept[w.ends] = True
    data = t.data.copy()
    data[w.ends] = 0x20
    for row, mine in found.items():
        first = int(w.first[row])
        for start, length, period in mine:
            a, b = first + start + period, first + start + length
            kept[w.starts[a] : w.ends[b - 1] + 1] = False
    sizes = np.concatenate([[0], np.cumsum(kept)])[t.begins]
    joined = data[kept].tobytes()
    return [joined[a : max(a, b - 1)] for a, b in zip(sizes[:-1].tolist(), sizes[1:].tolist(), strict=True)]


def without_runs(docs: DataFrame, least: int = LEAST, power: int = POWER) -> DataFrame:
    """``docs(doc_id, text, ..)`` -> ``(doc_id, runs, collapsed)``, one row per row.

    Words are runs of other than ASCII white space. ``runs`` lists every stretch of words with smallest period
    p that is at least ``least`` and ``power`` * p words long and that no neighbouring word extends with that period,
    by start, then period. ``collapsed`` are the words joined by one space, each run without what follows its
    first period. ``least`` and ``power`` are at least 6 and 4. Texts without words (null, empty) have no runs and
    an empty ``collapsed``; repeated rows, and rows without doc_id, keep a row each; other columns are ignored;
    no rows give no rows. A text of any length is one piece; memory is linear in it. Words are compared by
    64-bit hashes.
    """
    if least < LEAST or power < POWER:
        raise ValueError(f"runs of fewer than {LEAST} words or {POWER} periods are not looked for")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, column = batch.column("doc_id"), batch.column("text")
            for a, b in pieces(column):
                t = texts(column.slice(a, b - a))
                w = words(t, NOT_SPACE)
                found = found_runs(t, w, least, power)
                listed = [[dict(zip(("start", "length", "period"), r, strict=True)) for r in found.get(row, ())] for row in range(len(t))]
                text = pa.array(collapsed(t, w, found), pa.binary()).cast(pa.string(), safe=False)
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array(listed, pa.list_(RUN)), text], ["doc_id", "runs", "collapsed"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, runs array<struct<start: long, length: long, period: long>>, collapsed string")
