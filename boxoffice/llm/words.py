"""Words of many texts at once, as spans over one byte array.

The word patterns of the operators exclude ASCII characters only, so a word is a run of bytes: every byte
of a character beyond ASCII is at least 0x80 and belongs to a word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Bytes that numpy works on at a time. A longer text is a piece of its own.
PIECE_BYTES = 1 << 20

MIX_1 = np.uint64(0x9E3779B97F4A7C15)
MIX_2 = np.uint64(0xBF58476D1CE4E5B9)
MIX_3 = np.uint64(0x94D049BB133111EB)

SPACES = b" \t\n\v\f\r"
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[list(SPACES)] = False

# [^\x00-\x2F\x3A-\x60\x7B-\x7F] after A-Z are lower-cased
ALPHANUMERIC = np.zeros(256, bool)
ALPHANUMERIC[0x30:0x3A] = ALPHANUMERIC[0x61:0x7B] = ALPHANUMERIC[0x80:] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


@dataclass
class Texts:
    """Texts laid end to end. ``data`` has a line feed after each text and eight bytes after the last."""

    data: np.ndarray
    begins: np.ndarray  # where each text begins; one more entry for the end

    def __len__(self) -> int:
        return len(self.begins) - 1

    def text(self, row: int) -> bytes:
        return self.data[self.begins[row] : self.begins[row + 1] - 1].tobytes()


@dataclass
class Words:
    """``first[i] : first[i + 1]`` are the words of text i."""

    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def pieces(column: pa.Array | pa.ChunkedArray, most: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes of text each; a range has one row at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    row, done = 0, 0
    while row < len(ends):
        stop = max(row + 1, int(np.searchsorted(ends, done + most, "right")))
        yield row, stop
        row, done = stop, int(ends[stop - 1])


def texts(column: pa.Array, lower: bool = False) -> Texts:
    """Nulls are empty texts."""
    if len(column) == 0:
        return Texts(np.zeros(8, np.uint8), np.zeros(1, np.int64))
    column = column.cast(pa.large_binary()).fill_null(b"")
    joined = b"\n".join(column.to_pylist()) + b"\n"
    data = np.frombuffer(joined + b"\0" * 8, np.uint8)
    begins = np.zeros(len(column) + 1, np.int64)
    np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False) + 1, out=begins[1:])
    return Texts(LOWER[data] if lower else data, begins)


def words(t: Texts, kept: np.ndarray) -> Words:
    """``kept`` says for each byte value whether it belongs to a word; a line feed must not."""
    mask = np.zeros(len(t.data) + 1, np.int8)
    mask[1:-8] = kept[t.data[:-8]]
    edges = np.flatnonzero(np.diff(mask))
    starts, ends = edges[::2], edges[1::2]
    return Words(starts, ends, np.searchsorted(starts, t.begins))


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values."""
    h = (h ^ (h >> np.uint64(30))) * MIX_2
    h = (h ^ (h >> np.uint64(27))) * MIX_3
    return h ^ (h >> np.uint64(31))


def lanes(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on, as one little-endian number."""
    return np.ndarray((len(data) - 7,), "<u8", data.tobytes() if not data.flags.c_contiguous else data, strides=(1,))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, eight bytes at a step for all spans together."""
    eight = lanes(data)
    left = ends - starts
    h = mixed(left.astype(np.uint64) * MIX_1)
    active, at = np.arange(len(starts)), starts.copy()
    while active.size:
        lane = eight[at]
        short = np.minimum(left[active], 8).astype(np.uint64)
        lane = lane & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - np.uint64(8) * short))
        h[active] = mixed((h[active] ^ lane) * MIX_1 + MIX_3)
        more = left[active] > 8
        left[active] -= 8
        active, at = active[more], at[more] + 8
    return h
