"""FM-index of a sequence of small numbers: backward search and location of many patterns at once."""

from __future__ import annotations

import numpy as np

SAMPLE = 8  # every so manyth position keeps its place


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Start positions of all suffixes in sorted order, by doubling the sorted prefix."""
    _, rank = np.unique(symbols, return_inverse=True)
    n, step = len(symbols), 1
    while True:
        after = np.zeros(n, np.int64)
        after[: n - step] = rank[step:] + 1
        key = rank.astype(np.int64) * (n + 1) + after
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(sorted_key[1:] != sorted_key[:-1])])
        step *= 2
        if step >= n or rank[order[-1]] == n - 1:
            return order


class FMIndex:
    """``symbols`` end with 0, which occurs nowhere else; patterns hold no 0."""

    def __init__(self, symbols: np.ndarray, n_symbols: int):
        order = suffix_order(symbols)
        self.n = len(symbols)
        self.last = symbols[order - 1]  # the symbol before each suffix
        self.before = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=n_symbols))])
        # wavelet tree, level by level from the highest bit: zeros go left, ones right
        self.zeros, row = [], self.last
        self.levels = list(range(max(1, int(n_symbols - 1).bit_length()) - 1, -1, -1))
        for level in self.levels:
            ones = (row >> level) & 1 == 1
            self.zeros.append(np.concatenate([[0], np.cumsum(~ones)]).astype(np.int32))
            row = np.concatenate([row[~ones], row[ones]])
        self.origin = self.down(np.arange(n_symbols), np.zeros(n_symbols, np.int64))
        marked = order % SAMPLE == 0
        self.marked = marked
        self.mark_rank = np.cumsum(marked) - 1
        self.places = order[marked]

    def down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level, zeros in zip(self.levels, self.zeros, strict=True):
            left = zeros[at]
            at = np.where((symbol >> level) & 1 == 1, zeros[-1] + at - left, left)
        return at

    def step(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The row that ``symbol`` in front of row ``at`` leads to."""
        return self.before[symbol] + self.down(symbol, at) - self.origin[symbol]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(pattern, low, high)``: row ranges of the patterns (rows of one length) that occur."""
        which = np.arange(len(patterns))
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        for column in range(patterns.shape[1] - 1, -1, -1):
            symbol = patterns[which, column]
            low, high = self.step(symbol, low), self.step(symbol, high)
            found = low < high
            which, low, high = which[found], low[found], high[found]
        return which, low, high

    def locate(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(range, position)`` of every occurrence."""
        sizes = high - low
        of = np.repeat(np.arange(len(low)), sizes)
        rows = np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + low[of]
        steps = np.zeros(len(rows), np.int64)
        walking = np.flatnonzero(~self.marked[rows])
        while walking.size:
            at = rows[walking]
            rows[walking] = self.step(self.last[at], at)
            steps[walking] += 1
            walking = walking[~self.marked[rows[walking]]]
        return of, self.places[self.mark_rank[rows]] + steps
