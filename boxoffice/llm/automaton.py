"""Squares of a sequence, by a suffix automaton whose link tree is a link-cut tree.

The state of each prefix is accessed in turn: the path from it to the root holds all suffixes of the prefix,
and the access makes it one preferred path, coloured with the place where the prefix ends. The path is made
of segments of older ones. A segment of colour c that reaches down to a suffix of length l says that this suffix
ended last at c. If the distance to the present end is at most l, the two occurrences touch or overlap, so a
square with that distance as period ends here; its period is the smallest, as the occurrence is the last one.
"""

from __future__ import annotations


def suffix_automaton(word: list[int]) -> tuple[list[int], list[int], list[int]]:
    """``(link, length, state of each prefix)``. States count from 1, the root, whose link is 0."""
    link, length, after = [0, 0], [0, 0], [{}, {}]
    prefix = []
    last = 1
    for symbol in word:
        now = len(link)
        link.append(1)
        length.append(length[last] + 1)
        after.append({})
        prefix.append(now)
        p = last
        while p and symbol not in after[p]:
            after[p][symbol] = now
            p = link[p]
        if p:
            q = after[p][symbol]
            if length[q] == length[p] + 1:
                link[now] = q
            else:
                copy = len(link)
                link.append(link[q])
                length.append(length[p] + 1)
                after.append(after[q].copy())
                link[q] = link[now] = copy
                while p and after[p].get(symbol) == q:
                    after[p][symbol] = copy
                    p = link[p]
        last = now
    return link, length, prefix


class Paths:
    """The preferred paths of a tree, each a splay tree by depth; 0 is no node.

    ``colour`` at the root of a splay tree holds for its whole path; 0 is no colour.
    """

    def __init__(self, parent: list[int]):
        self.up = parent.copy()  # at the root of a splay tree: the node above the path
        self.low = [0] * len(parent)  # the child towards the root of the tree
        self.high = [0] * len(parent)
        self.colour = [0] * len(parent)

    def rotate(self, x: int) -> None:
        up, low, high = self.up, self.low, self.high
        y = up[x]
        z = up[y]
        if low[y] == x:
            middle = low[y] = high[x]
            high[x] = y
        else:
            middle = high[y] = low[x]
            low[x] = y
        if middle:
            up[middle] = y
        if low[z] == y:
            low[z] = x
        elif high[z] == y:
            high[z] = x
        up[x], up[y] = z, x

    def splay(self, x: int) -> None:
        """Makes ``x`` the root of its splay tree."""
        up, low, high = self.up, self.low, self.high
        y = up[x]
        if low[y] != x and high[y] != x:
            return
        while True:
            z = up[y]
            if low[z] != y and high[z] != y:
                self.colour[x] = self.colour[y]
                self.rotate(x)
                return
            above = up[z]
            done = low[above] != z and high[above] != z
            if done:
                self.colour[x] = self.colour[z]
            self.rotate(y if (low[z] == y) == (low[y] == x) else x)
            self.rotate(x)
            if done:
                return
            y = above

    def access(self, x: int, colour: int) -> list[tuple[int, int]]:
        """Makes the path from ``x`` to the root one of ``colour``; the segments it was made of, as (colour, last node)."""
        segments = []
        below = 0
        while x:
            self.splay(x)
            segments.append((self.colour[x], x))
            rest = self.high[x]
            if rest:
                self.colour[rest] = self.colour[x]
            self.high[x] = below
            below, x = x, self.up[x]
        self.colour[below] = colour
        return segments


def runs(word: list[int], least: int = 2, power: int = 2) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of all runs of length >= max(``least``, ``power`` * period).

    A run is a stretch with smallest period p, at least 2 * p long, that cannot be extended with that period.
    ``power`` is at least 2.
    """
    link, length, prefix = suffix_automaton(word)
    paths = Paths(link)
    n = len(word)
    ends: dict[int, int] = {}  # where the last run of a period ends
    found = []
    for i, state in enumerate(prefix):
        for colour, node in paths.access(state, i + 1):
            if not colour:
                continue
            period = i + 1 - colour
            # a square that ends within a run of its period belongs to that run
            if period > length[node] or ends.get(period, -1) >= i:
                continue
            start, end = i + 1 - 2 * period, i + 1
            while start and word[start - 1] == word[start - 1 + period]:
                start -= 1
            while end < n and word[end] == word[end - period]:
                end += 1
            ends[period] = end - 1
            if end - start >= max(least, power * period):
                found.append((start, end - start, period))
    found.sort(key=lambda run: (run[0], run[2]))
    return found
