"""Gradient-boosted trees for a few classes, in numpy: soft-max loss, second-order gains, histograms of quantile bins."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    def __init__(self, classes: int, rounds: int = 24, depth: int = 4, rate: float = 0.3, bins: int = 24, least: float = 2.0):
        self.classes, self.rounds, self.depth, self.rate, self.bins, self.least = classes, rounds, depth, rate, bins, least
        self.edges: list[np.ndarray] = []
        #: Per tree: feature and bin to compare with of every inner node (a complete tree), and values of the leaves.
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(self.edges)], 1).astype(np.int16)

    def _grow(self, b: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n, features = b.shape
        inner = (1 << self.depth) - 1
        feature, cut, node = np.zeros(inner, np.int64), np.full(inner, self.bins, np.int64), np.zeros(n, np.int64)
        for level in range(self.depth):
            first, width = (1 << level) - 1, 1 << level
            best = np.full(width, 1e-6)
            for f in range(features):
                key = (node - first) * (self.bins + 1) + b[:, f]
                sums = [np.bincount(key, w, width * (self.bins + 1)).reshape(width, -1).cumsum(1) for w in (g, h)]
                gl, hl = (s[:, :-1] for s in sums)
                gt, ht = (s[:, -1:] for s in sums)
                gain = gl**2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt**2 / (ht + 1)
                gain[(hl < self.least) | (ht - hl < self.least)] = 0
                k = gain.argmax(1)
                top = gain[np.arange(width), k]
                won = top > best
                best[won] = top[won]
                feature[first : first + width][won], cut[first : first + width][won] = f, k[won]
            node = 2 * node + 1 + (b[np.arange(n), feature[node]] > cut[node])
        leaf = node - inner
        value = -np.bincount(leaf, g, 1 << self.depth) / (np.bincount(leaf, h, 1 << self.depth) + 1)
        return feature, cut, self.rate * value

    def _values(self, b: np.ndarray, tree: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
        feature, cut, value = tree
        node, rows = np.zeros(len(b), np.int64), np.arange(len(b))
        for _ in range(self.depth):
            node = 2 * node + 1 + (b[rows, feature[node]] > cut[node])
        return value[node - ((1 << self.depth) - 1)]

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        q = np.linspace(0, 1, self.bins + 1)[1:-1]
        self.edges = [np.unique(np.quantile(x[:, f], q)) for f in range(x.shape[1])]
        b, z, one = self._binned(x), np.zeros((len(x), self.classes)), np.eye(self.classes)[y]
        for _ in range(self.rounds):
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            for c in range(self.classes):
                tree = self._grow(b, p[:, c] - one[:, c], p[:, c] * (1 - p[:, c]))
                self.trees.append(tree)
                z[:, c] += self._values(b, tree)
        return self

    def log_probabilities(self, x: np.ndarray) -> np.ndarray:
        b, z = self._binned(x), np.zeros((len(x), self.classes))
        for k, tree in enumerate(self.trees):
            z[:, k % self.classes] += self._values(b, tree)
        z -= z.max(1, keepdims=True)
        return z - np.log(np.exp(z).sum(1, keepdims=True))
