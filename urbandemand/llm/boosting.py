"""Gradient-boosted regression trees for the logistic loss, in numpy."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Tree:
    """A full binary tree in arrays: node i has the children 2i+1 and 2i+2."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    def predict(self, x: np.ndarray, depth: int) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        for _ in range(depth):
            f = self.feature[at]
            right = (f >= 0) & (x[np.arange(len(x)), np.maximum(f, 0)] > self.cut[at])
            at = np.where(f < 0, at, 2 * at + 1 + right)
        return self.value[at]


@dataclass
class BoostedTrees:
    depth: int = 3
    rounds: int = 60
    rate: float = 0.2
    ridge: float = 2.0
    start: float = 0.0
    trees: list[Tree] = field(default_factory=list)

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        p0 = min(max(y.mean(), 1e-3), 1 - 1e-3)
        self.start = float(np.log(p0 / (1 - p0)))
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, 17)[:-1])) for j in range(x.shape[1])]
        z = np.full(len(x), self.start)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-z))
            g, h = y - p, p * (1 - p)
            tree = self._grow(x, g, h, cuts)
            self.trees.append(tree)
            z += self.rate * tree.predict(x, self.depth)
        return self

    def _grow(self, x: np.ndarray, g: np.ndarray, h: np.ndarray, cuts: list[np.ndarray]) -> Tree:
        size = 2 ** (self.depth + 1) - 1
        feature, cut, value = np.full(size, -1), np.zeros(size), np.zeros(size)
        held = {0: np.arange(len(x))}
        for node in range(size):
            rows = held.pop(node, None)
            if rows is None:
                continue
            gs, hs = g[rows].sum(), h[rows].sum()
            value[node] = gs / (hs + self.ridge)
            if node >= 2**self.depth - 1 or len(rows) < 8:
                continue
            best = 1e-6
            for j, options in enumerate(cuts):
                col = x[rows, j]
                for c in options:
                    right = col > c
                    gr, hr = g[rows][right].sum(), h[rows][right].sum()
                    gain = gr**2 / (hr + self.ridge) + (gs - gr) ** 2 / (hs - hr + self.ridge) - gs**2 / (hs + self.ridge)
                    if gain > best and 0 < right.sum() < len(rows):
                        best, feature[node], cut[node] = gain, j, c
            if feature[node] >= 0:
                right = x[rows, feature[node]] > cut[node]
                held[2 * node + 1], held[2 * node + 2] = rows[~right], rows[right]
        return Tree(feature, cut, value)

    def probability(self, x: np.ndarray) -> np.ndarray:
        z = self.start + self.rate * sum(t.predict(x, self.depth) for t in self.trees)
        return 1 / (1 + np.exp(-z))
