"""Gradient-boosted trees for two classes, in numpy: histograms, complete trees of one depth, logistic loss."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    def __init__(self, trees: int = 60, depth: int = 4, rate: float = 0.25, bins: int = 32, l2: float = 1.0):
        self.n_trees, self.depth, self.rate, self.n_bins, self.l2 = trees, depth, rate, bins, l2
        self.bias = 0.0
        self.feature = np.zeros((0, (1 << depth) - 1), np.int64)
        self.edge = np.zeros((0, (1 << depth) - 1))
        self.value = np.zeros((0, 1 << depth))

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        n, m = x.shape
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.n_bins + 1)[1:-1])) for j in range(m)]
        binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1)
        rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.bias = float(np.log(rate / (1 - rate)))
        margin = np.full(n, self.bias)
        features, thresholds, values = [], [], []
        for _ in range(self.n_trees):
            p = 1 / (1 + np.exp(-margin))
            g, h = p - y, p * (1 - p)
            node = np.zeros(n, np.int64)
            f = np.zeros((1 << self.depth) - 1, np.int64)
            t = np.full((1 << self.depth) - 1, np.inf)
            for level in range(self.depth):
                width, first = 1 << level, (1 << level) - 1
                best = np.full(width, 1e-6)
                split = np.full(n, np.inf)
                chosen = np.zeros(n, np.int64)
                total_g, total_h = np.bincount(node, g, width), np.bincount(node, h, width)
                base = total_g**2 / (total_h + self.l2)
                pick = np.full(width, -1)
                cut = np.zeros(width, np.int64)
                for j in range(m):
                    if not len(edges[j]):
                        continue
                    key = node * self.n_bins + binned[:, j]
                    left_g = np.cumsum(np.bincount(key, g, width * self.n_bins).reshape(width, -1), 1)[:, : len(edges[j])]
                    left_h = np.cumsum(np.bincount(key, h, width * self.n_bins).reshape(width, -1), 1)[:, : len(edges[j])]
                    right_g, right_h = total_g[:, None] - left_g, total_h[:, None] - left_h
                    gain = left_g**2 / (left_h + self.l2) + right_g**2 / (right_h + self.l2) - base[:, None]
                    gain[(left_h < 1e-2) | (right_h < 1e-2)] = 0
                    at = gain.argmax(1)
                    better = gain[np.arange(width), at] > best
                    best[better], pick[better], cut[better] = gain[np.arange(width), at][better], j, at[better]
                for k in np.flatnonzero(pick >= 0):
                    f[first + k], t[first + k] = pick[k], edges[pick[k]][cut[k]]
                chosen, split = f[first + node], t[first + node]
                node = node * 2 + (x[np.arange(n), chosen] > split)
            leaf = -np.bincount(node, g, 1 << self.depth) / (np.bincount(node, h, 1 << self.depth) + self.l2) * self.rate
            margin += leaf[node]
            features.append(f)
            thresholds.append(t)
            values.append(leaf)
        self.feature, self.edge, self.value = np.array(features), np.array(thresholds), np.array(values)
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log odds of class 1 of each row."""
        out, rows = np.full(len(x), self.bias), np.arange(len(x))
        for f, t, v in zip(self.feature, self.edge, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                at = (1 << level) - 1 + node
                node = node * 2 + (x[rows, f[at]] > t[at])
            out += v[node]
        return out
