"""Gradient-boosted regression trees on binned features, small enough for the driver."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Tree:
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    depth: int

    def predict(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        rows = np.arange(len(x))
        for _ in range(self.depth):
            node = 2 * node + 1 + (x[rows, self.feature[node]] > self.threshold[node])
        return self.value[node]


@dataclass
class BoostedTrees:
    """Squared loss, complete trees of fixed depth, split points at quantiles of the training rows.

    Missing feature values must be filled before; training is deterministic.
    """

    rounds: int = 150
    depth: int = 4
    rate: float = 0.15
    bins: int = 48
    least_rows: int = 8
    start: float = 0.0
    trees: list[Tree] = field(default_factory=list)

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        n, width = x.shape
        self.trees = []
        self.start = float(y.mean()) if n else 0.0
        if not n:
            return self
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(width)]
        binned = np.stack([np.searchsorted(cuts[j], x[:, j], side="left") for j in range(width)], 1)
        flat = binned + np.arange(width) * self.bins
        rest = y - self.start
        for _ in range(self.rounds):
            tree = self._grow(flat, binned, cuts, rest)
            self.trees.append(tree)
            rest = rest - tree.predict(x)
        return self

    def _grow(self, flat: np.ndarray, binned: np.ndarray, cuts: list[np.ndarray], rest: np.ndarray) -> Tree:
        n, width = flat.shape
        size = 2 ** (self.depth + 1) - 1
        feature, threshold, value = np.zeros(size, np.int64), np.full(size, np.inf), np.zeros(size)
        node = np.zeros(n, np.int64)
        for level in range(self.depth):
            first, many = 2**level - 1, 2**level
            key = ((node - first)[:, None] * width * self.bins + flat).ravel()
            total = np.bincount(key, np.repeat(rest, width), many * width * self.bins).reshape(many, width, self.bins)
            count = np.bincount(key, minlength=many * width * self.bins).reshape(many, width, self.bins)
            left_s, left_n = total.cumsum(2), count.cumsum(2)
            all_s, all_n = left_s[:, :, -1:], left_n[:, :, -1:]
            right_s, right_n = all_s - left_s, all_n - left_n
            ok = (left_n >= self.least_rows) & (right_n >= self.least_rows)
            gain = np.where(ok, left_s**2 / np.maximum(left_n, 1) + right_s**2 / np.maximum(right_n, 1) - all_s**2 / np.maximum(all_n, 1), -1.0)
            best = gain.reshape(many, -1).argmax(1)
            good = gain.reshape(many, -1)[np.arange(many), best] > 1e-12
            f, b = best // self.bins, best % self.bins
            for k in np.flatnonzero(good):
                feature[first + k] = f[k]
                threshold[first + k] = cuts[f[k]][min(b[k], len(cuts[f[k]]) - 1)]
            at = node - first
            right = good[at] & (binned[np.arange(n), f[at]] > b[at])
            node = 2 * node + 1 + right
        leaf = 2**self.depth - 1
        total = np.bincount(node - leaf, rest, 2**self.depth)
        count = np.bincount(node - leaf, minlength=2**self.depth)
        value[leaf:] = self.rate * total / np.maximum(count + 1.0, 1.0)
        return Tree(feature, threshold, value, self.depth)

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        for tree in self.trees:
            out += tree.predict(x)
        return out


@dataclass
class Calibration:
    """Monotone map from raw predictions to grades: pooled adjacent violators on binned means."""

    at: np.ndarray
    to: np.ndarray

    @classmethod
    def fit(cls, raw: np.ndarray, y: np.ndarray, groups: int = 64) -> Calibration:
        if not len(raw):
            return cls(np.zeros(1), np.zeros(1))
        order = np.argsort(raw, kind="stable")
        parts = [p for p in np.array_split(order, min(groups, len(order))) if len(p)]
        at = np.array([raw[p].mean() for p in parts])
        merged: list[list[float]] = []
        for p in parts:
            merged.append([float(y[p].mean()), float(len(p)), 1])
            while len(merged) > 1 and merged[-2][0] > merged[-1][0]:
                m, n, k = merged.pop()
                merged[-1] = [(merged[-1][0] * merged[-1][1] + m * n) / (merged[-1][1] + n), merged[-1][1] + n, merged[-1][2] + k]
        return cls(at, np.repeat([m for m, _, _ in merged], [int(k) for _, _, k in merged]))

    def apply(self, raw: np.ndarray) -> np.ndarray:
        return np.interp(raw, self.at, self.to)
