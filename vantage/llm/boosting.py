"""Gradient-boosted trees on binned features and isotonic calibration, for bounded samples."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Logistic boosting of depth-bounded trees over quantile bins; deterministic."""

    def __init__(self, rounds: int = 80, depth: int = 3, rate: float = 0.2, bins: int = 48, least: int = 3, l2: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.least, self.l2 = rounds, depth, rate, bins, least, l2
        self.edges: list[np.ndarray] = []
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.bias = 0.0

    def _codes(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], axis=1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])] if len(x) else [np.empty(0)] * x.shape[1]
        codes, p = self._codes(x), np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3)
        self.bias = float(np.log(p / (1 - p)))
        f = np.full(len(y), self.bias)
        for _ in range(self.rounds if len(y) else 0):
            q = 1 / (1 + np.exp(-f))
            tree, leaf = self._grow(codes, y - q, q * (1 - q))
            self.trees.append(tree)
            f += tree[2][leaf]
        return self

    def _grow(self, codes: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[tuple, np.ndarray]:
        size = 2 ** (self.depth + 1) - 1
        feature, cut, value = np.full(size, -1), np.zeros(size, int), np.zeros(size)
        at = np.zeros(len(g), int)
        for node in range(size):
            mine = np.flatnonzero(at == node)
            if not len(mine):
                continue
            gs, hs = g[mine].sum(), h[mine].sum()
            value[node] = self.rate * gs / (hs + self.l2)
            if 2 * node + 2 >= size:
                continue
            best = (1e-6, -1, 0)
            for j, e in enumerate(self.edges):
                if not len(e):
                    continue
                c = codes[mine, j]
                gl, hl, nl = (np.cumsum(np.bincount(c, w, len(e) + 1))[:-1] for w in (g[mine], h[mine], np.ones(len(mine))))
                gain = gl**2 / (hl + self.l2) + (gs - gl) ** 2 / (hs - hl + self.l2) - gs**2 / (hs + self.l2)
                gain[(nl < self.least) | (len(mine) - nl < self.least)] = 0
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (gain[k], j, k)
            if best[1] >= 0:
                feature[node], cut[node] = best[1], best[2]
                at[mine] = 2 * node + 1 + (codes[mine, best[1]] > best[2])
        return (feature, cut, value), at

    def raw(self, x: np.ndarray) -> np.ndarray:
        codes, out = self._codes(x), np.full(len(x), self.bias)
        for feature, cut, value in self.trees:
            at = np.zeros(len(x), int)
            for _ in range(self.depth):
                f = feature[at]
                go = f >= 0
                at[go] = 2 * at[go] + 1 + (codes[np.flatnonzero(go), f[go]] > cut[at[go]])
            out += value[at]
        return out


def isotonic(score: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators fit as interpolation knots (x, y), y from 0 to 1."""
    if not len(score):
        return np.array([0.0, 1.0]), np.array([0.5, 0.5])
    xs, inverse, count = np.unique(score, return_inverse=True, return_counts=True)
    mean = np.bincount(inverse, label) / count
    blocks: list[list[float]] = []
    for i, (m, n) in enumerate(zip(mean, count, strict=True)):
        blocks.append([m, n, i, i])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            b, a = blocks.pop(), blocks.pop()
            blocks.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2], b[3]])
    x = [xs[int(i)] for b in blocks for i in ((b[2], b[3]) if b[3] > b[2] else (b[2],))]
    y = [b[0] for b in blocks for _ in range(2 if b[3] > b[2] else 1)]
    return np.array(x), np.array(y)
