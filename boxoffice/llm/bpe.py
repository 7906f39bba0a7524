"""Byte-level BPE encoding and decoding over an Aho-Corasick automaton (operator 6).

Bytes are mapped to Latin-1 characters, so that the automaton finds all tokens in a piece at once. The
encoder goes through the piece with the longest token at each place, steps back to shorter tokens where two
neighbours would not stay apart, and marks dead ends so that no place is tried twice: linear time. Two
tokens are compatible if merging their joined bytes by rank gives these two again; the answers are
memoised. A sequence whose neighbours are all compatible is the one that the merges give.

Tokens that the merges never make stay out of the automaton; as in the rank files' library, a piece that is
such a token as a whole is still that one token.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxoffice.llm import splitting
from boxoffice.llm.pretokenized import Pieces

MEMO_ENTRIES = 1 << 18  # token pairs remembered by a process; then it starts anew


def merged(raw: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The merges themselves, lowest rank first, leftmost of equals; for short strings."""
    parts = [raw[i : i + 1] for i in range(len(raw))]
    while len(parts) > 1:
        best, at = min(((ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))))
        if best == 1 << 60:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[p] for p in parts]


class Codec:
    """``rank_file``: the bytes of a file with one token in base 64 and its rank on each line."""

    def __init__(self, rank_file: bytes, pattern: str):
        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in rank_file.splitlines() if line.strip())}
        self.tokens = {rank: raw for raw, rank in self.ranks.items()}
        self.pattern = regex.compile(pattern)
        made = [(raw, rank) for raw, rank in self.ranks.items() if merged(raw, self.ranks) == [rank]]
        self.automaton = ahocorasick.Automaton()
        for raw, rank in made:
            self.automaton.add_word(raw.decode("latin-1"), rank)
        self.automaton.make_automaton()
        self.size = {rank: len(raw) for raw, rank in made}
        # the next shorter token that begins a token
        known = {raw: rank for raw, rank in made}
        self.shorter = {}
        for raw, rank in made:
            self.shorter[rank] = next((known[raw[:n]] for n in range(len(raw) - 1, 0, -1) if raw[:n] in known), None)
        self.fits: dict[tuple[int, int], bool] = {}
        self.pieces = Pieces(lambda some: [np.array(self.piece(raw), "<u4").tobytes() for raw in some], 4, lambda some: [self.whole(s) for s in some])

    def compatible(self, left: int, right: int) -> bool:
        found = self.fits.get((left, right))
        if found is None:
            if len(self.fits) >= MEMO_ENTRIES:
                self.fits.clear()
            found = self.fits[left, right] = merged(self.tokens[left] + self.tokens[right], self.ranks) == [left, right]
        return found

    def piece(self, raw: bytes) -> list[int]:
        """Ids of one match of the pattern."""
        whole = self.ranks.get(raw)
        if whole is not None:
            return [whole]
        longest: list[int | None] = [None] * len(raw)
        size = self.size
        for end, rank in self.automaton.iter(raw.decode("latin-1")):
            start = end + 1 - size[rank]
            held = longest[start]
            if held is None or size[held] < size[rank]:
                longest[start] = rank
        dead = bytearray(len(raw) + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while at < len(raw):
            # a token that begins here, ends at a live place and fits its neighbour
            while token is not None and (dead[at + size[token]] or (out and not self.compatible(out[-1], token))):
                token = self.shorter[token]
            if token is not None:
                out.append(token)
                at += size[token]
                token = longest[at] if at < len(raw) else None
            else:
                dead[at] = 1
                token = out.pop()
                at -= size[token]
                token = self.shorter[token]
        return out

    def whole(self, text: str) -> bytes:
        """Ids of one text as little-endian unsigned 32-bit numbers."""
        return np.array([i for p in self.pattern.findall(text) for i in self.piece(p.encode())], "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        if self.pattern.pattern != splitting.PATTERN:
            return [self.whole(t) for t in texts]
        return self.pieces.encode(texts)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def codec_of(held: list, rank_file: bytes, pattern: str) -> Codec:
    """The codec of a task's Python process, built once."""
    if not held:
        held.append(Codec(rank_file, pattern))
    return held[0]


CODECS: dict[str, list] = {}


def encoded(docs: DataFrame, rank_path: str, pattern: str, ids: bool = True) -> DataFrame:
    """``(doc_id, ids, n_tokens, ids_sha256, decoded_sha256)`` of each row of ``docs(doc_id, text, ..)``.

    ``rank_path`` is read by the driver and sent to the tasks (a vocabulary file of a few megabytes). Ids
    are little-endian unsigned 32-bit numbers, each match of ``pattern`` encoded by itself, no special
    tokens; ``decoded_sha256`` is that of the bytes the ids decode to. Without ``ids`` that column is null.
    Null and empty texts have no ids. Repeated rows keep a row each, with or without doc_id; other columns
    are ignored; no rows give no rows.
    """
    with open(rank_path, "rb") as file:
        rank_file = file.read()
    shared = docs.sparkSession.sparkContext.broadcast(rank_file)
    key = hashlib.sha256(rank_file + pattern.encode()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(CODECS.setdefault(key, []), shared.value, pattern)
        for batch in batches:
            kept, counts, hashes, decoded = [], [], [], []
            for raw in codec.encode([t or "" for t in batch.column("text").to_pylist()]):
                kept.append(raw if ids else None)
                counts.append(len(raw) // 4)
                hashes.append(hashlib.sha256(raw).hexdigest())
                decoded.append(hashlib.sha256(codec.decode(raw)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(kept, pa.binary()), pa.array(counts, pa.int64()), pa.array(hashes, pa.string()), pa.array(decoded, pa.string())],
                ["doc_id", "ids", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        run, f"doc_id {kind}, ids binary, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )


def decoded(rows: DataFrame, rank_path: str) -> DataFrame:
    """``(doc_id, text)`` of rows with ``ids`` as `encoded` gives them; a null ``ids`` gives a null text."""
    with open(rank_path, "rb") as file:
        rank_file = file.read()
    shared = rows.sparkSession.sparkContext.broadcast(rank_file)
    key = hashlib.sha256(rank_file).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(CODECS.setdefault(key, []), shared.value, "")
        for batch in batches:
            text = [None if x is None else codec.decode(x).decode(errors="replace") for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(text, pa.string())], ["doc_id", "text"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")
