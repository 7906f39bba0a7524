"""XXH64 of many byte spans at once; spans of 32 bytes or more go to the library one by one."""

from __future__ import annotations

import numpy as np
import xxhash

from boxoffice.llm.words import lanes

# Fixed values of XXH64
P1 = np.uint64(0x9E3779B185EBCA87)
P2 = np.uint64(0xC2B2AE3D27D4EB4F)
P3 = np.uint64(0x165667B19E3779F9)
P4 = np.uint64(0x85EBCA77C2B2AE63)
P5 = np.uint64(0x27D4EB2F165667C5)


def rotated(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


def xxh64(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """``data`` goes on for eight bytes after the last span."""
    left = ends - starts
    out = np.empty(len(starts), np.uint64)
    long = np.flatnonzero(left >= 32)
    if long.size:
        whole = data.tobytes()
        out[long] = [xxhash.xxh64_intdigest(whole[a:b], seed) for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True)]
    short = np.flatnonzero(left < 32)
    at, left = starts[short], left[short]
    eight = lanes(data)
    h = np.uint64(seed) + P5 + left.astype(np.uint64)
    for _ in range(3):
        on = np.flatnonzero(left >= 8)
        if not on.size:
            break
        h[on] = rotated(h[on] ^ (rotated(eight[at[on]] * P2, 31) * P1), 27) * P1 + P4
        at[on] += 8
        left[on] -= 8
    on = np.flatnonzero(left >= 4)
    h[on] = rotated(h[on] ^ ((eight[at[on]] & np.uint64(0xFFFFFFFF)) * P1), 23) * P2 + P3
    at[on] += 4
    left[on] -= 4
    for _ in range(3):
        on = np.flatnonzero(left > 0)
        h[on] = rotated(h[on] ^ (data[at[on]].astype(np.uint64) * P5), 11) * P1
        at[on] += 1
        left[on] -= 1
    h = (h ^ (h >> np.uint64(33))) * P2
    h = (h ^ (h >> np.uint64(29))) * P3
    out[short] = h ^ (h >> np.uint64(32))
    return out
