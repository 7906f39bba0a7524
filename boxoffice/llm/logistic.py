"""Logistic calibration of a few numbers per document."""

from __future__ import annotations

import numpy as np


class Logistic:
    """P(label 1) of feature rows; ``weights`` of the fit say how often each row stands for."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weights: np.ndarray, ridge: float = 1.0, rounds: int = 50):
        self.mean = np.average(x, axis=0, weights=weights)
        self.scale = np.sqrt(np.average((x - self.mean) ** 2, axis=0, weights=weights)) + 1e-12
        z = self.design(x)
        penalty = ridge * np.eye(z.shape[1])
        penalty[0, 0] = 1e-6
        self.beta = np.zeros(z.shape[1])
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(z @ self.beta, -30, 30)))
            slope = z.T @ (weights * (p - y)) + penalty @ self.beta
            curve = (z * (weights * p * (1 - p))[:, None]).T @ z + penalty
            move = np.linalg.solve(curve, slope)
            self.beta -= np.clip(move, -2, 2)
            if np.abs(move).max() < 1e-9:
                break

    def design(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([np.ones((len(x), 1)), (x - self.mean) / self.scale], axis=1)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.design(x) @ self.beta, -30, 30)))


def class_weights(y: np.ndarray, n0: int, n1: int) -> np.ndarray:
    """Weights under which the classes of a balanced sample are as frequent as their counts say."""
    share = n1 / (n0 + n1)
    return np.where(y == 1, share * len(y) / max(1, (y == 1).sum()), (1 - share) * len(y) / max(1, (y == 0).sum()))
