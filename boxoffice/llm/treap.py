"""K2-treap over a grid of terms and documents, and the joint descent of query rows through it.

The grid is a square of 2**depth; a cell of level l is a square of 2**(depth - l). The root holds the greatest
value of the grid and its point, each of its four quarters the greatest of what is left there, and so on; a
quarter with no point left is absent. Nodes lie level by level in Morton order, so a node's children follow
from its four-bit mask and a running count of the bits before. Values are kept as differences from the
parent's, points as offsets in the cell.

A query is a set of rows with weights. A *range* is a range of documents, 2**(depth - l) long, with one path
per row: the node whose cell holds row and range, or none. What a path's own row gave up on the way down is
carried as points. A range's bound is the weighted sum of the greatest value of each path. Ranges are opened in halves, those with
the best bounds first, many at a time, and dropped once the bound is below the score that counts; in a range of one document
the bound is the score.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

AT_ONCE = 64  # ranges of a query that are opened together


def interleaved(row: np.ndarray, column: np.ndarray) -> np.ndarray:
    """Morton code: the bits of ``row`` above those of ``column``, pair by pair."""

    def spread(v: np.ndarray) -> np.ndarray:
        v = v.astype(np.uint64)
        for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
            v = (v | v << np.uint64(shift)) & np.uint64(mask)
        return v

    return (spread(row) << np.uint64(1) | spread(column)).astype(np.int64)


@dataclass
class Treap:
    """Arrays over all nodes, level by level. ``row``, ``column``: the point, as offsets in the cell."""

    depth: int
    mask: np.ndarray
    row: np.ndarray
    column: np.ndarray
    less: np.ndarray  # by how much the value is below the parent's; at the root the value

    @classmethod
    def of(cls, row: np.ndarray, column: np.ndarray, value: np.ndarray) -> Treap:
        """Of the points (row, column), each given once, with positive values."""
        if not len(row):
            return cls(0, *(np.zeros(0, np.int64) for _ in range(4)))
        depth = max(int(row.max()), int(column.max())).bit_length()
        order = np.argsort(code := interleaved(row, column), kind="stable")
        code, row, column, value = code[order], row[order], column[order], value[order].astype(np.int64)
        parent = np.zeros(len(code), np.int64)  # of each point left: the node of the level above that it lies in
        levels, masks, above = [], [], None
        for level in range(depth + 1):
            side = depth - level
            cell = code >> (2 * side)
            first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
            node = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(cell))))
            most = np.maximum.reduceat(value, first)
            # the first of the greatest points of each cell is its node's
            top = np.flatnonzero(value == most[node])
            top = top[np.concatenate([[True], node[top][1:] != node[top][:-1]])]
            low = (1 << side) - 1
            less = most if above is None else above[parent[first]] - most
            if level:
                mask = np.zeros(len(above), np.int64)
                np.bitwise_or.at(mask, parent[first], 1 << (cell[first] & 3))
                masks.append(mask)
            levels.append((row[top] & low, column[top] & low, less))
            left = np.ones(len(code), bool)
            left[top] = False
            code, row, column, value, parent, above = code[left], row[left], column[left], value[left], node[left], most
            if not len(code):
                break
        masks.append(np.zeros(len(above), np.int64))
        rows, columns, less = (np.concatenate(parts) for parts in zip(*levels, strict=True))
        return cls(depth, np.concatenate(masks), rows, columns, less)

    def opened(self) -> OpenTreap:
        return OpenTreap(self)


BITS_BEFORE = np.array([[bin(m & ((1 << q) - 1)).count("1") for q in range(4)] for m in range(16)], np.int64)


class OpenTreap:
    """A treap to search in: running counts for the children, whole values."""

    def __init__(self, t: Treap):
        self.depth, self.mask, self.row, self.column = t.depth, t.mask, t.row, t.column
        counts = np.array([bin(m).count("1") for m in range(16)], np.int64)[t.mask]
        self.child = 1 + np.concatenate([[0], np.cumsum(counts)])[:-1]
        self.value = t.less.astype(np.int64)
        # level by level: below its parent's
        low, high = 0, 1
        while high < len(self.value):
            parents = np.repeat(np.arange(low, high), counts[low:high])
            self.value[high : high + len(parents)] = self.value[parents] - self.value[high : high + len(parents)]
            low, high = high, high + len(parents)

    def down(self, node: np.ndarray, quarter: np.ndarray) -> np.ndarray:
        """The child in a quarter (2 * lower half of the rows + right half of the columns), or -1."""
        mask = self.mask[node]
        there = mask >> quarter & 1 == 1
        return np.where(there, self.child[node] + BITS_BEFORE[mask, quarter], -1)

    def search(self, row: np.ndarray, weight: np.ndarray, least: Callable[[], int], give: Callable[[np.ndarray, np.ndarray], None]) -> None:
        """Calls ``give(columns, scores)`` until all columns are given whose score, the sum of weight * value over
        the query's distinct ``row``s, is at least ``least()``; that may rise on the way. Scores of 0 are not given."""
        if not len(self.mask) or not len(row):
            return
        depth = self.depth
        # entries: of which range, for which row of the query, its node (-1: a point), the point's column, the value
        term = np.arange(len(row))
        e_range, e_node = np.zeros(len(row), np.int64), np.zeros(len(row), np.int64)
        frontier = Frontier(np.zeros(1, np.int64), np.zeros(1, np.int64), e_range, term, e_node, np.full(len(row), -1), np.full(len(row), self.value[0]))
        frontier.weigh(weight)
        while len(frontier.bound):
            frontier = frontier.only(np.flatnonzero((frontier.bound >= max(least(), 1))))
            if not len(frontier.bound):
                return
            best = np.arange(len(frontier.bound))
            if len(best) > AT_ONCE:
                best = np.argpartition(-frontier.bound, AT_ONCE)[:AT_ONCE]
            chosen = np.zeros(len(frontier.bound), bool)
            chosen[best] = True
            rest, now = frontier.only(np.flatnonzero(~chosen)), frontier.only(np.flatnonzero(chosen))
            done = now.level == depth
            if done.any():
                # a range of one document
                give(now.begin[done], now.bound[done])
                now = now.only(np.flatnonzero(~done))
            frontier = rest.plus(self.halves(now, row, weight)) if len(now.bound) else rest

    def halves(self, f: Frontier, row: np.ndarray, weight: np.ndarray) -> Frontier:
        side = self.depth - f.level[f.of]  # of the cell of each entry, in bits
        is_node = f.node >= 0
        n, mine = f.node[is_node], f.of[is_node]
        term, side_n = f.term[is_node], side[is_node]
        # the point of the node itself, if it is in the query's row
        low = (1 << side_n) - 1
        own = self.row[n] == (row[term] & low)
        point_of, point_term = mine[own], term[own]
        point_column = f.begin[point_of] + self.column[n[own]]
        point_value = self.value[n[own]]
        of = np.concatenate([f.of[~is_node], point_of])
        column = np.concatenate([f.column[~is_node], point_column])
        right = column - f.begin[of] >> (self.depth - f.level[of] - 1)
        parts = [(2 * of + right, np.concatenate([f.term[~is_node], point_term]), np.full(len(of), -1), column, np.concatenate([f.value[~is_node], point_value]))]
        lower = row[term] >> (side_n - 1) & 1
        for half in (0, 1):
            child = self.down(n, 2 * lower + half)
            there = child >= 0
            child = child[there]
            parts.append((2 * mine[there] + half, term[there], child, np.full(len(child), -1), self.value[child]))
        e = [np.concatenate(p) for p in zip(*parts, strict=True)]
        order = np.argsort(e[0] * len(row) + e[1], kind="stable")
        ids, first = np.unique(e[0], return_inverse=True)
        level = f.level[ids >> 1] + 1
        begin = f.begin[ids >> 1] + ((ids & 1) << (self.depth - level))
        out = Frontier(level, begin, first[order], e[1][order], e[2][order], e[3][order], e[4][order])
        out.weigh(weight)
        return out


class Frontier:
    """Ranges (level, begin) with their entries, which are sorted by range and row of the query."""

    def __init__(self, level, begin, of, term, node, column, value, bound=None):
        self.level, self.begin, self.of, self.term, self.node, self.column, self.value = level, begin, of, term, node, column, value
        self.bound = bound

    def weigh(self, weight: np.ndarray) -> None:
        """Bounds: of each row the greatest value, weighted and summed."""
        self.bound = np.zeros(len(self.level), np.int64)
        if len(self.of):
            first = np.flatnonzero(np.concatenate([[True], (self.of[1:] != self.of[:-1]) | (self.term[1:] != self.term[:-1])]))
            most = np.maximum.reduceat(self.value, first) * weight[self.term[first]]
            np.add.at(self.bound, self.of[first], most)

    def only(self, ranges: np.ndarray) -> Frontier:
        if len(ranges) == len(self.level):
            return self
        place = np.full(len(self.level), -1)
        place[ranges] = np.arange(len(ranges))
        kept = np.flatnonzero(place[self.of] >= 0)
        return Frontier(self.level[ranges], self.begin[ranges], place[self.of[kept]], self.term[kept], self.node[kept], self.column[kept], self.value[kept], self.bound[ranges])

    def plus(self, other: Frontier) -> Frontier:
        if not len(self.level):
            return other
        join = lambda a, b: np.concatenate([a, b])
        of = join(self.of, other.of + len(self.level))
        return Frontier(*(join(getattr(self, c), getattr(other, c)) for c in ("level", "begin")), of, *(join(getattr(self, c), getattr(other, c)) for c in ("term", "node", "column", "value", "bound")))
