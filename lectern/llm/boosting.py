"""Histogram gradient-boosted trees in numpy: grown on a bounded table, flattened into arrays for vectorised traversal."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Forest:
    """Full binary trees of one depth, level by level: node i of a tree has children 2i + 1 and 2i + 2."""

    feature: np.ndarray  # (trees, 2^depth - 1)
    threshold: np.ndarray  # (trees, 2^depth - 1); a row goes right if its value is above
    leaf: np.ndarray  # (trees, 2^depth)
    start: float

    def margins(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of the rows of ``x``, all rows of a tree's level at once."""
        rows, out = np.arange(len(x)), np.full(len(x), self.start)
        inner = self.feature.shape[1]
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            while len(x) and node[0] < inner:
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            out += leaf[node - inner]
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margins(x)))


def grow(x: np.ndarray, y: np.ndarray, *, trees: int = 60, depth: int = 4, bins: int = 64, rate: float = 0.2, ridge: float = 1.0, least: float = 1.0) -> Forest:
    """Boost log-loss with Newton leaves. Columns of ``x`` are binned at quantiles; a level's splits are found from one
    histogram of gradients over (node, feature, bin). With no rows, or labels of one kind only, the forest is a constant."""
    n, m = x.shape
    inner = (1 << depth) - 1
    share = (y.sum() + 0.5) / (n + 1)
    start = float(np.log(share / (1 - share)))
    if not n or y.min() == y.max():
        return Forest(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)), start)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(m)]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], 1)  # bin b: value <= cut b
    margin, features, thresholds, leaves = np.full(n, start), [], [], []
    flat = binned + np.arange(m) * bins
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, width = (1 << level) - 1, 1 << level
            at = ((node - first)[:, None] * (m * bins) + flat).ravel()
            size = width * m * bins
            hg = np.bincount(at, np.repeat(g, m), size).reshape(width, m, bins).cumsum(2)
            hh = np.bincount(at, np.repeat(h, m), size).reshape(width, m, bins).cumsum(2)
            tg, th = hg[:, :1, -1:], hh[:, :1, -1:]
            gain = hg**2 / (hh + ridge) + (tg - hg) ** 2 / (th - hh + ridge) - tg**2 / (th + ridge)
            gain[(hh < least) | (th - hh < least)] = 0
            for j, c in enumerate(cuts):
                gain[:, j, len(c) :] = 0
            best = gain.reshape(width, -1).argmax(1)
            for k in range(width):
                j, b = divmod(int(best[k]), bins)
                if gain[k, j, b] > 1e-9:
                    feature[first + k], threshold[first + k] = j, cuts[j][b]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > threshold[node])
        place = node - inner
        value = -rate * np.bincount(place, g, inner + 1) / (np.bincount(place, h, inner + 1) + ridge)
        margin += value[place]
        features.append(feature)
        thresholds.append(threshold)
        leaves.append(value)
    return Forest(np.stack(features), np.stack(thresholds), np.stack(leaves), start)
