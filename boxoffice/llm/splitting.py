"""The split that byte-level BPE makes before its merges, for many texts at once.

The pattern is ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``. Its matches
cover a text without gaps, so it is enough to say where one begins: at each change between letters,
numbers, white space and other characters, with three exceptions. The last of several white space
characters before something else begins anew, a plain space takes what follows into its match, and a
contraction ends after its letters. Characters whose class may differ between Unicode versions are not
split here; their texts are for the caller's library.
"""

from __future__ import annotations

import functools

import numpy as np
import regex

PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

OTHER, LETTER, NUMBER, SPACE, UNSURE = range(5)

# Ranges of characters whose classes have long been settled: scripts from Latin to Cyrillic, punctuation,
# kana and the common ideographs, syllables of Hangul
SETTLED = [(0x0, 0x52F), (0x1E00, 0x1FFF), (0x2000, 0x206F), (0x20A0, 0x20AC), (0x2100, 0x218B), (0x2190, 0x23FF), (0x2500, 0x27BF), (0x3000, 0x30FF), (0x4E00, 0x9FA5), (0xAC00, 0xD7A3), (0xFF01, 0xFF5E), (0x1F300, 0x1F64F)]

SHORT, LONG = b"stmd", (b"re", b"ve", b"ll")


@functools.cache
def classes() -> np.ndarray:
    out = np.full(0x110000, UNSURE, np.uint8)
    for low, high in SETTLED:
        out[low : high + 1] = OTHER
        chars = "".join(map(chr, range(low, high + 1)))
        for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\p{White_Space}")):
            for m in regex.finditer(f"{pattern}+", chars):
                out[low + m.start() : low + m.end()] = kind
    return out


def is_settled(text: str) -> bool:
    if text.isascii():
        return True
    return not (classes()[np.frombuffer(text.encode("utf-32-le"), np.uint32)] == UNSURE).any()


def split(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(data, starts, first)`` for settled texts: UTF-8 bytes of all, where matches begin in them (and the
    end), and which match each text begins with (and the number of matches)."""
    joined = "".join(texts)
    data = np.frombuffer(joined.encode() + b"\0" * 8, np.uint8)
    if not joined:
        return data, np.zeros(1, np.int64), np.zeros(len(texts) + 1, np.int64)
    chars = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    kind = classes()[chars]
    n = len(chars)
    begins = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=begins[1:])
    new_text = np.zeros(n + 1, bool)
    new_text[begins] = True
    start = np.ones(n + 1, bool)
    start[1:n] = (kind[1:] != kind[:-1]) | new_text[1:n]
    # the last white space before something else of the same text
    space = kind == SPACE
    last = np.flatnonzero(space[:-1] & ~space[1:] & ~new_text[1:n])
    start[last] = True
    start[last[chars[last] == 0x20] + 1] = False
    # contractions, where "'" begins a match
    quote = np.flatnonzero((chars == 0x27) & start[:n])
    ends = begins[np.searchsorted(begins, quote, "right")]
    padded = np.concatenate([chars, np.zeros(2, np.uint32)])
    short = quote[(quote + 1 < ends) & np.isin(padded[quote + 1], list(SHORT))]
    two = np.isin(padded[quote + 1].astype(np.uint64) * 256 + padded[quote + 2], [a * 256 + b for a, b in LONG])
    long = quote[(quote + 2 < ends) & two]
    for found, size in ((short, 2), (long, 3)):
        start[found + 1] = False
        start[found + size] = True
    width = 1 + (chars >= 0x80).astype(np.int64) + (chars >= 0x800) + (chars >= 0x10000)
    at = np.concatenate([[0], np.cumsum(width)])
    where = np.flatnonzero(start)
    return data, at[where], np.searchsorted(where, begins)
