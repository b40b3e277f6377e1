"""Gradient-boosted trees on binned dense features, and isotonic calibration. Plain numpy; fits on one bounded sample."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Logistic-loss boosting with trees of fixed depth over quantile bins."""

    def __init__(self, trees: int = 120, depth: int = 3, rate: float = 0.1, bins: int = 64, least: float = 2.0, ridge: float = 1.0):
        self.trees, self.depth, self.rate, self.bins, self.least, self.ridge = trees, depth, rate, bins, least, ridge

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], axis=1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        n, d = x.shape
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(d)] if n else [np.zeros(0)] * d
        rate = (y.sum() + 0.5) / (n + 1)
        self.base, self.found = float(np.log(rate / (1 - rate))), []
        if n == 0 or y.min() == y.max():
            return self
        b, f = self._binned(x), np.full(n, self.base)
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-f))
            tree = self._grow(b, p - y, p * (1 - p))
            self.found.append(tree)
            f += self._apply(tree, b)
        return self

    def _grow(self, b: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(feature, bin, value) by heap position; feature -1 is a leaf."""
        size = 2 ** (self.depth + 1) - 1
        feature, cut, value = np.full(size, -1), np.zeros(size, int), np.zeros(size)
        rows = {0: np.arange(len(g))}
        for node in range(size):
            if node not in rows:
                continue
            own = rows.pop(node)
            value[node] = -self.rate * g[own].sum() / (h[own].sum() + self.ridge)
            if 2 * node + 2 >= size:
                continue
            best, total_g, total_h = (1e-6, -1, 0), g[own].sum(), h[own].sum()
            for j in range(b.shape[1]):
                k = len(self.edges[j]) + 1
                gl = np.cumsum(np.bincount(b[own, j], g[own], k))[:-1]
                hl = np.cumsum(np.bincount(b[own, j], h[own], k))[:-1]
                gain = gl**2 / (hl + self.ridge) + (total_g - gl) ** 2 / (total_h - hl + self.ridge) - total_g**2 / (total_h + self.ridge)
                gain[(hl < self.least / 4) | (total_h - hl < self.least / 4)] = 0
                if len(gain) and gain.max() > best[0]:
                    best = (gain.max(), j, int(gain.argmax()))
            if best[1] >= 0:
                feature[node], cut[node] = best[1], best[2]
                left = b[own, best[1]] <= best[2]
                rows[2 * node + 1], rows[2 * node + 2] = own[left], own[~left]
        return feature, cut, value

    def _apply(self, tree: tuple[np.ndarray, np.ndarray, np.ndarray], b: np.ndarray) -> np.ndarray:
        feature, cut, value = tree
        node = np.zeros(len(b), int)
        for _ in range(self.depth):
            f = feature[node]
            right = b[np.arange(len(b)), np.maximum(f, 0)] > cut[node]
            node = np.where(f < 0, node, 2 * node + 1 + right)
        return value[node]

    def margin(self, x: np.ndarray) -> np.ndarray:
        b, f = self._binned(x), np.full(len(x), self.base)
        for tree in self.found:
            f += self._apply(tree, b)
        return f


class Isotonic:
    """Pool-adjacent-violators fit of P(label | margin); linear between the blocks' centres."""

    def fit(self, margin: np.ndarray, y: np.ndarray) -> Isotonic:
        if len(y) == 0:
            self.at, self.value = np.zeros(1), np.zeros(1)
            return self
        order = np.argsort(margin, kind="stable")
        blocks: list[list[float]] = []
        for m, v in zip(margin[order], y[order], strict=True):
            blocks.append([float(v), 1.0, float(m)])
            while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
                s, n, at = blocks.pop()
                blocks[-1] = [blocks[-1][0] + s, blocks[-1][1] + n, blocks[-1][2] + at]
        self.at = np.array([b[2] / b[1] for b in blocks])
        self.value = np.array([b[0] / b[1] for b in blocks])
        return self

    def __call__(self, margin: np.ndarray) -> np.ndarray:
        return np.interp(margin, self.at, self.value)
