"""Gradient-boosted regression trees for binary labels, on small feature matrices, in numpy."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Logistic loss, second-order leaf values, exact depth, thresholds among quantiles of each feature."""

    def __init__(self, n_trees: int = 40, depth: int = 4, rate: float = 0.25, l2: float = 1.0, bins: int = 24):
        self.n_trees, self.depth, self.rate, self.l2, self.bins = n_trees, depth, rate, l2, bins
        self.features = np.zeros((0, (1 << depth) - 1), np.int64)
        self.cuts = np.zeros((0, (1 << depth) - 1))
        self.leaves = np.zeros((0, 1 << depth))

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], 1)
        wide = self.bins + 1
        score = np.zeros(len(y))
        trees = []
        for _ in range(self.n_trees):
            p = 1 / (1 + np.exp(-score))
            g, h = p - y, p * (1 - p) + 1e-9
            feature, cut = np.zeros((1 << self.depth) - 1, np.int64), np.full((1 << self.depth) - 1, np.inf)
            node = np.zeros(len(y), np.int64)
            for level in range(self.depth):
                base, count = (1 << level) - 1, 1 << level
                best = np.full(count, 1e-6)
                for j in range(x.shape[1]):
                    if not len(edges[j]):
                        continue
                    place = (node - base) * wide + binned[:, j]
                    sums = [np.bincount(place, w, count * wide).reshape(count, wide) for w in (g, h)]
                    left_g, left_h = (np.cumsum(s, 1)[:, :-1] for s in sums)
                    all_g, all_h = (s.sum(1, keepdims=True) for s in sums)
                    gain = left_g**2 / (left_h + self.l2) + (all_g - left_g) ** 2 / (all_h - left_h + self.l2) - all_g**2 / (all_h + self.l2)
                    gain = gain[:, : len(edges[j])]
                    k = gain.argmax(1)
                    better = gain[np.arange(count), k] > best + 1e-9
                    best[better] = gain[np.arange(count), k][better]
                    feature[base : base + count][better] = j
                    cut[base : base + count][better] = edges[j][k[better]]
                node = 2 * node + 1 + (x[np.arange(len(x)), feature[node]] > cut[node])
            leaf = node - ((1 << self.depth) - 1)
            value = -np.bincount(leaf, g, 1 << self.depth) / (np.bincount(leaf, h, 1 << self.depth) + self.l2) * self.rate
            score += value[leaf]
            trees.append((feature, cut, value))
        self.features, self.cuts, self.leaves = (np.stack(t) for t in zip(*trees, strict=True))
        return self

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.zeros(len(x)), np.arange(len(x))
        for feature, cut, value in zip(self.features, self.cuts, self.leaves, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            out += value[node - len(feature)]
        return out
