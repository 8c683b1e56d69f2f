"""Gradient-boosted trees for a few classes, on binned features, in numpy."""

from __future__ import annotations

import numpy as np


class Boosted:
    """Softmax boosting; every tree is complete to ``depth`` and stored as arrays."""

    def __init__(self, classes: int, rounds: int = 40, depth: int = 4, rate: float = 0.25, bins: int = 32, ridge: float = 1.0, least: float = 2.0):
        self.classes, self.rounds, self.depth, self.rate, self.bins, self.ridge, self.least = classes, rounds, depth, rate, bins, ridge, least

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        n, f = x.shape
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(f)]
        b = self._binned(x)
        onehot = np.eye(self.classes)[y]
        share = np.clip(onehot.mean(0), 1e-6, 1)
        self.base = np.log(share)
        raw = np.tile(self.base, (n, 1))
        inner = 2**self.depth - 1
        self.feature, self.cut, self.leaf = [], [], []
        for _ in range(self.rounds):
            e = np.exp(raw - raw.max(1, keepdims=True))
            p = e / e.sum(1, keepdims=True)
            for c in range(self.classes):
                g, h = p[:, c] - onehot[:, c], np.maximum(p[:, c] * (1 - p[:, c]), 1e-6)
                feature, cut, node = np.zeros(inner, np.int64), np.full(inner, self.bins, np.int64), np.zeros(n, np.int64)
                for level in range(self.depth):
                    self._split(b, g, h, node, 2**level, feature, cut)
                    here = 2**level - 1 + node
                    node = node * 2 + (b[np.arange(n), feature[here]] > cut[here])
                leaves = 2**self.depth
                value = -np.bincount(node, g, leaves) / (np.bincount(node, h, leaves) + self.ridge) * self.rate
                raw[:, c] += value[node]
                self.feature.append(feature)
                self.cut.append(cut)
                self.leaf.append(value)
        return self

    def _split(self, b, g, h, node, width, feature, cut) -> None:
        """The best feature and bin for each of ``width`` nodes of a level."""
        n, f = b.shape
        key = ((node[:, None] * f + np.arange(f)) * self.bins + b).ravel()
        size = width * f * self.bins
        sums = [np.bincount(key, np.repeat(v, f), size).reshape(width, f, self.bins).cumsum(2) for v in (g, h)]
        gl, hl = sums
        gt, ht = gl[:, :, -1:], hl[:, :, -1:]
        gain = gl**2 / (hl + self.ridge) + (gt - gl) ** 2 / (ht - hl + self.ridge) - gt**2 / (ht + self.ridge)
        gain[(hl < self.least * 0.05) | (ht - hl < self.least * 0.05)] = 0
        flat = gain.reshape(width, -1)
        best = flat.argmax(1)
        good = flat[np.arange(width), best] > 1e-9
        at = width - 1 + np.flatnonzero(good)
        feature[at], cut[at] = best[good] // self.bins, best[good] % self.bins

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(self.edges)], 1)

    def log_probability(self, x: np.ndarray) -> np.ndarray:
        """Log probability of each class for each row."""
        b, rows = self._binned(x), np.arange(len(x))
        raw = np.tile(self.base, (len(x), 1))
        for t, (feature, cut, leaf) in enumerate(zip(self.feature, self.cut, self.leaf)):
            node = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                here = 2**level - 1 + node
                node = node * 2 + (b[rows, feature[here]] > cut[here])
            raw[:, t % self.classes] += leaf[node]
        raw -= raw.max(1, keepdims=True)
        return raw - np.log(np.exp(raw).sum(1, keepdims=True))
