"""Gradient-boosted trees for two classes, on histograms of binned features."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Trees of fixed depth, each fitted to the gradient of the logistic loss by Newton steps."""

    def __init__(self, trees: int = 80, depth: int = 5, rate: float = 0.2, bins: int = 32, ridge: float = 1.0, least: float = 4.0):
        self.trees, self.depth, self.rate, self.bins, self.ridge, self.least = trees, depth, rate, bins, ridge, least

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> BoostedTrees:
        n, f = x.shape
        weight = np.ones(n) if weight is None else weight
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(f)]
        binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(self.edges)], 1)
        rate = np.average(y, weights=weight)
        self.start = float(np.log(rate / (1 - rate)))
        score = np.full(n, self.start)
        self.model: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-score))
            g, h = weight * (y - p), weight * p * (1 - p)
            tree, leaf = self._grow(binned, g, h)
            self.model.append(tree)
            score += tree[2][leaf]
        return self

    def _grow(self, binned: np.ndarray, g: np.ndarray, h: np.ndarray):
        n, f = binned.shape
        inner = (1 << self.depth) - 1
        feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(n, np.int64)
        for level in range(self.depth):
            first, width = (1 << level) - 1, 1 << level
            best = np.full(width, 1e-6)
            chosen, at = np.full(width, -1), np.zeros(width, np.int64)
            key = (node - first) * self.bins
            for j in range(f):
                if not len(self.edges[j]):
                    continue
                k = key + binned[:, j]
                sg = np.bincount(k, g, width * self.bins).reshape(width, -1).cumsum(1)
                sh = np.bincount(k, h, width * self.bins).reshape(width, -1).cumsum(1)
                tg, th = sg[:, -1:], sh[:, -1:]
                gain = sg**2 / (sh + self.ridge) + (tg - sg) ** 2 / (th - sh + self.ridge) - tg**2 / (th + self.ridge)
                gain[(sh < self.least) | (th - sh < self.least)] = 0
                b = gain.argmax(1)
                top = gain[np.arange(width), b]
                better = top > best
                best[better], chosen[better], at[better] = top[better], j, b[better]
            go = np.zeros(n, np.int64)
            for w in np.flatnonzero(chosen >= 0):
                j, b = chosen[w], at[w]
                feature[first + w], cut[first + w] = j, self.edges[j][b]
                own = node == first + w
                go[own] = binned[own, j] > b
            node = 2 * node + 1 + go
        leaf = node - inner
        size = 1 << self.depth
        value = self.rate * np.bincount(leaf, g, size) / (np.bincount(leaf, h, size) + self.ridge)
        return (feature, cut, value), leaf

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 of each row."""
        n = len(x)
        score, rows, inner = np.full(n, self.start), np.arange(n), (1 << self.depth) - 1
        for feature, cut, value in self.model:
            node = np.zeros(n, np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            score += value[node - inner]
        return 1 / (1 + np.exp(-score))
