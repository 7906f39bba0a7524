"""Encoding of whole texts by pieces: each distinct piece goes to a library once."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np

from boxoffice.llm.splitting import is_settled, split
from boxoffice.llm.words import span_hashes

MEMO_ENTRIES = 1 << 19  # pieces that a process remembers,
MEMO_IDS = 1 << 22  # and ids of them; then it keeps those of the last texts only
PIECE_CHARS = 1 << 20  # characters split at a time; a longer text is split by itself


class Pieces:
    """``encode_pieces`` gives the serialised ids of some pieces of the byte-level pattern, ``id_bytes`` bytes
    an id, and ``encode_texts`` those of whole texts. Both are the same ids, as merges never cross pieces;
    texts in which ``whole`` is found are encoded as a whole.

    Remembered pieces are sorted hashes, with the place and number of their ids in a pool.
    """

    def __init__(self, encode_pieces: Callable[[list[bytes]], list[bytes]], id_bytes: int, encode_texts: Callable[[list[str]], list[bytes]], whole: re.Pattern | None = None):
        self.encode_pieces = encode_pieces
        self.encode_texts = encode_texts
        self.whole = whole
        self.kind = f"<u{id_bytes}"
        self.known = np.zeros(0, np.uint64)
        self.at = np.zeros(0, np.int64)
        self.counts = np.zeros(0, np.int64)
        self.pool = np.zeros(0, self.kind)

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = [b""] * len(texts)
        held, size = [], 0
        for k, text in enumerate(texts):
            if not is_settled(text) or (self.whole and self.whole.search(text)):
                out[k] = self.encode_texts([text])[0]
                continue
            if held and size + len(text) > PIECE_CHARS:
                self.some(texts, held, out)
                held, size = [], 0
            held.append(k)
            size += len(text)
        self.some(texts, held, out)
        return out

    def learn(self, hashes: np.ndarray, span: Callable[[int], bytes]) -> np.ndarray:
        """Where sorted distinct pieces are among the known ones, after those that were not are."""
        place = np.searchsorted(self.known, hashes)
        fresh = np.ones(len(hashes), bool)
        inside = place < len(self.known)
        fresh[inside] = self.known[place[inside]] != hashes[inside]
        new = np.flatnonzero(fresh)
        if not len(new):
            return place
        found = self.encode_pieces([span(k) for k in new.tolist()])
        ids = np.frombuffer(b"".join(found), self.kind)
        counts = np.array([len(x) for x in found], np.int64) // ids.itemsize
        at = len(self.pool) + np.cumsum(counts) - counts
        self.pool = np.concatenate([self.pool, ids])
        self.known, self.at, self.counts = (
            np.insert(old, place[new], more) for old, more in ((self.known, hashes[new]), (self.at, at), (self.counts, counts))
        )
        return np.searchsorted(self.known, hashes)

    def some(self, texts: list[str], rows: list[int], out: list[bytes]) -> None:
        if not rows:
            return
        data, starts, first = split([texts[k] for k in rows])
        hashes, one, which = np.unique(span_hashes(data, starts[:-1], starts[1:]), return_index=True, return_inverse=True)
        raw = data.tobytes()
        begins, ends = starts[one], starts[one + 1]
        place = self.learn(hashes, lambda k: raw[begins[k] : ends[k]])
        # the ids of the distinct pieces, dealt out to all pieces
        sizes = self.counts[place][which]
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        dealt = self.pool[np.arange(bounds[-1]) + np.repeat(self.at[place][which] - bounds[:-1], sizes)].tobytes()
        cuts = (bounds[first] * self.pool.itemsize).tolist()
        for row, a, b in zip(rows, cuts[:-1], cuts[1:], strict=True):
            out[row] = dealt[a:b]
        if len(self.known) > MEMO_ENTRIES or len(self.pool) > MEMO_IDS:
            self.keep(place)

    def keep(self, place: np.ndarray) -> None:
        counts = self.counts[place]
        at = np.cumsum(counts) - counts
        self.pool = self.pool[np.arange(counts.sum()) + np.repeat(self.at[place] - at, counts)]
        self.known, self.at, self.counts = self.known[place], at, counts
