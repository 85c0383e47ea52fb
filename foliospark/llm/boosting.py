"""Gradient-boosted trees for binary labels, in numpy."""

from __future__ import annotations

import numpy as np


class Boosting:
    """Trees of a fixed depth over binned features, fitted to the gradient of the logistic loss."""

    def __init__(self, trees: int = 50, depth: int = 3, rate: float = 0.2, bins: int = 32):
        self.trees, self.depth, self.rate, self.bins = trees, depth, rate, bins
        self.edges: list[np.ndarray] = []
        self.model: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.base = 0.0

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], 1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosting:
        x, y = np.asarray(x, np.float64), np.asarray(y, np.float64)
        n, width = x.shape
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1], method="lower")) for j in range(width)]
        b = self._bin(x)
        p = min(max(y.mean(), 1e-3), 1 - 1e-3)
        self.base = float(np.log(p / (1 - p)))
        f = np.full(n, self.base)
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-f))
            g, h = y - p, p * (1 - p)
            node = np.zeros(n, np.int64)
            feature, cut = np.zeros(2**self.depth - 1, np.int64), np.full(2**self.depth - 1, self.bins + 1)
            for level in range(self.depth):
                k, first = 2**level, 2**level - 1
                gain_best = np.full(k, 1e-6)
                for j in range(width):
                    key = node * (self.bins + 1) + b[:, j]
                    gs = np.bincount(key, g, k * (self.bins + 1)).reshape(k, -1).cumsum(1)
                    hs = np.bincount(key, h, k * (self.bins + 1)).reshape(k, -1).cumsum(1)
                    gt, ht = gs[:, -1:], hs[:, -1:]
                    gain = gs**2 / (hs + 1) + (gt - gs) ** 2 / (ht - hs + 1) - gt**2 / (ht + 1)
                    at = gain[:, :-1].argmax(1)
                    value = gain[np.arange(k), at]
                    better = value > gain_best
                    gain_best[better] = value[better]
                    feature[first : first + k][better], cut[first : first + k][better] = j, at[better]
                node = node * 2 + (b[np.arange(n), feature[first + node]] > cut[first + node])
            leaf = np.bincount(node, g, 2**self.depth) / (np.bincount(node, h, 2**self.depth) + 1)
            self.model.append((feature, cut, leaf * self.rate))
            f += leaf[node] * self.rate
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row."""
        x = np.asarray(x, np.float64)
        if not len(x):
            return np.zeros(0)
        b, rows = self._bin(x), np.arange(len(x))
        f = np.full(len(x), self.base)
        for feature, cut, leaf in self.model:
            node = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                first = 2**level - 1
                node = node * 2 + (b[rows, feature[first + node]] > cut[first + node])
            f += leaf[node]
        return 1 / (1 + np.exp(-f))
