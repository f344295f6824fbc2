"""Gradient-boosted regression trees on binned features, for two classes."""

from __future__ import annotations

import numpy as np


class Boosted:
    """Trees of one depth whose leaves sum up to the log-odds of class 1."""

    def __init__(self, trees: int = 60, depth: int = 5, rate: float = 0.25, bins: int = 32, least: float = 1.0):
        self.trees, self.depth, self.rate, self.bins, self.least = trees, depth, rate, bins, least

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        """Newton steps on the logistic loss; each split is the best of all features' bins."""
        steps = np.linspace(0, 1, self.bins + 1)[1:-1]
        self.edges = [np.unique(np.quantile(column, steps)) for column in x.T]
        binned = self.binned(x)
        rows, features = binned.shape
        mean = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.start = float(np.log(mean / (1 - mean)))
        total = np.full(rows, self.start)
        nodes = 2 ** (self.depth + 1) - 1
        self.feature = np.zeros((self.trees, nodes), np.int64)
        self.cut = np.full((self.trees, nodes), self.bins, np.int64)
        self.value = np.zeros((self.trees, nodes))
        cells = self.bins * features
        offset = np.arange(features) * self.bins
        for t in range(self.trees):
            p = 1 / (1 + np.exp(-total))
            gradient, weight = y - p, p * (1 - p)
            node = np.zeros(rows, np.int64)
            for level in range(self.depth + 1):
                first, count = 2**level - 1, 2**level
                own = node - first
                g, h = (np.bincount(own, v, count) for v in (gradient, weight))
                self.value[t, first : first + count] = g / (h + self.least)
                if level == self.depth:
                    break
                place = (own[:, None] * cells + offset + binned).ravel()
                sums = [np.cumsum(np.bincount(place, np.repeat(v, features), count * cells).reshape(count, features, self.bins), axis=2) for v in (gradient, weight)]
                (gl, hl), (ga, ha) = sums, (g[:, None, None], h[:, None, None])
                gain = gl**2 / (hl + self.least) + (ga - gl) ** 2 / (ha - hl + self.least) - ga**2 / (ha + self.least)
                gain[(hl < self.least) | (ha - hl < self.least)] = 0
                best = gain.reshape(count, -1).argmax(axis=1)
                some = gain.reshape(count, -1)[np.arange(count), best] > 1e-6
                self.feature[t, first : first + count] = best // self.bins
                self.cut[t, first : first + count] = np.where(some, best % self.bins, self.bins)
                node = 2 * node + 1 + (binned[np.arange(rows), self.feature[t, node]] > self.cut[t, node])
            total += self.rate * self.value[t, node]
        return self

    def binned(self, x: np.ndarray) -> np.ndarray:
        """The bin of each feature."""
        return np.stack([np.searchsorted(e, c, side="left") for e, c in zip(self.edges, x.T, strict=True)], axis=1).astype(np.int64)

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of class 1."""
        binned, rows = self.binned(x), np.arange(len(x))
        total = np.full(len(x), self.start)
        for t in range(self.trees):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (binned[rows, self.feature[t, node]] > self.cut[t, node])
            total += self.rate * self.value[t, node]
        return total
