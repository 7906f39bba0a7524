"""Gradient-boosted trees with monotonic constraints, scored from flat node arrays."""

from __future__ import annotations

import numpy as np

TREES = 60
DEPTH = 3
RATE = 0.2
BINS = 64
RIDGE = 1.0
LEAST_WEIGHT = 3.0  # of the second derivatives in a leaf


class Trees:
    """Logistic loss. ``signs`` gives each feature +1 (the score may only rise with it), -1 or 0."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weights: np.ndarray, signs: list[int]):
        self.feature: list[int] = []  # -1: a leaf
        self.threshold: list[float] = []  # go right if the value is greater
        self.left: list[int] = []
        self.right: list[int] = []
        self.value: list[float] = []
        self.roots: list[int] = []
        self.signs = signs
        share = np.average(y, weights=weights)
        self.base = float(np.log(share / (1 - share)))
        cuts = [np.unique(np.quantile(column, np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for column in x.T]
        binned = np.stack([np.searchsorted(c, column, "left") for c, column in zip(cuts, x.T, strict=True)], axis=1)
        self.cuts = cuts
        score = np.full(len(y), self.base)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-score))
            self.roots.append(self.grow(binned, weights * (y - p), weights * p * (1 - p), np.arange(len(y)), DEPTH, -np.inf, np.inf, score))
        flat = {"feature": np.int64, "threshold": float, "left": np.int64, "right": np.int64, "value": float}
        for name, kind in flat.items():
            setattr(self, name, np.array(getattr(self, name), kind))

    def node(self, feature: int = -1, threshold: float = 0.0, value: float = 0.0) -> int:
        for column, v in ((self.feature, feature), (self.threshold, threshold), (self.left, 0), (self.right, 0), (self.value, value)):
            column.append(v)
        return len(self.feature) - 1

    def grow(self, binned, slope, curve, rows, depth, low, high, score) -> int:
        """A subtree for ``rows`` whose leaves lie in [low, high]; adds its values to ``score``."""
        g, h = slope[rows].sum(), curve[rows].sum()
        best = None
        if depth:
            for f, cuts in enumerate(self.cuts):
                n = len(cuts) + 1
                gl = np.cumsum(np.bincount(binned[rows, f], slope[rows], n))[:-1]
                hl = np.cumsum(np.bincount(binned[rows, f], curve[rows], n))[:-1]
                gr, hr = g - gl, h - hl
                vl, vr = np.clip(gl / (hl + RIDGE), low, high), np.clip(gr / (hr + RIDGE), low, high)
                gain = 2 * (gl * vl + gr * vr) - (hl + RIDGE) * vl**2 - (hr + RIDGE) * vr**2
                gain[(hl < LEAST_WEIGHT) | (hr < LEAST_WEIGHT) | (self.signs[f] * (vr - vl) < 0)] = -np.inf
                if n > 1 and (k := int(np.argmax(gain))) >= 0 and (best is None or gain[k] > best[0]):
                    best = gain[k], f, k, vl[k], vr[k]
        own = float(np.clip(g / (h + RIDGE), low, high))
        if best is None or best[0] <= 2 * g * own - (h + RIDGE) * own**2 + 1e-9:
            score[rows] += RATE * own
            return self.node(value=RATE * own)
        _, f, k, vl, vr = best
        here = self.node(feature=f, threshold=float(self.cuts[f][k]))
        goes_right = binned[rows, f] > k
        # under a constraint no leaf on one side may pass the middle between the sides
        middle = (vl + vr) / 2
        bounds = [(low, high), (low, high)]
        if self.signs[f] > 0:
            bounds = [(low, middle), (middle, high)]
        elif self.signs[f] < 0:
            bounds = [(middle, high), (low, middle)]
        self.left[here] = self.grow(binned, slope, curve, rows[~goes_right], depth - 1, *bounds[0], score)
        self.right[here] = self.grow(binned, slope, curve, rows[goes_right], depth - 1, *bounds[1], score)
        return here

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """P(label 1) of feature rows: all rows go down all trees together, a level at a time."""
        at = np.repeat(np.array(self.roots)[None, :], len(x), axis=0)
        row = np.arange(len(x))[:, None]
        for _ in range(DEPTH):
            f = self.feature[at]
            down = np.where(x[row, np.maximum(f, 0)] > self.threshold[at], self.right[at], self.left[at])
            at = np.where(f < 0, at, down)
        return 1 / (1 + np.exp(-(self.base + self.value[at].sum(axis=1))))
