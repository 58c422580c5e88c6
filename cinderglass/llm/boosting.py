"""Small gradient-boosted trees and isotonic regression on numpy arrays."""

from __future__ import annotations

import numpy as np

BINS = 48


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Boosted:
    """Binary classifier: depth-limited trees on binned features, logistic loss."""

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.15, least: float = 5.0, ridge: float = 1.0):
        self.rounds, self.depth, self.rate, self.least, self.ridge = rounds, depth, rate, least, ridge

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS)[1:-1])) if len(x) else np.zeros(0) for j in range(x.shape[1])]
        binned = self._bin(x)
        rate = (y.sum() + 0.5) / (len(y) + 1)
        self.base = float(np.log(rate / (1 - rate)))
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        total = np.full(len(y), self.base)
        for _ in range(self.rounds if 0 < y.sum() < len(y) else 0):
            p = _sigmoid(total)
            tree, leaf = self._grow(binned, y - p, p * (1 - p))
            self.trees.append(tuple(np.array(c) for c in zip(*tree, strict=True)))
            total += self.trees[-1][2][leaf]
        return self

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(self.edges)], axis=1) if len(self.edges) else x.astype(int)

    def _grow(self, binned: np.ndarray, grad: np.ndarray, hess: np.ndarray) -> tuple[list[tuple[int, int, float]], np.ndarray]:
        """Nodes in heap order: (feature or -1, bin of the split, value)."""
        size = (1 << (self.depth + 1)) - 1
        tree = [(-1, 0, 0.0)] * size
        node = np.zeros(len(grad), int)
        for k in range(size):
            own = np.flatnonzero(node == k)
            if not len(own):
                continue
            g, h = grad[own], hess[own]
            tree[k] = (-1, 0, float(self.rate * g.sum() / (h.sum() + self.ridge)))
            if 2 * k + 2 >= size:
                continue
            best = (1e-6, -1, 0)
            for j in range(binned.shape[1]):
                b = binned[own, j]
                gl, hl = np.cumsum(np.bincount(b, g, BINS)), np.cumsum(np.bincount(b, h, BINS))
                n = np.cumsum(np.bincount(b, minlength=BINS))
                gain = gl**2 / (hl + self.ridge) + (gl[-1] - gl) ** 2 / (hl[-1] - hl + self.ridge) - gl[-1] ** 2 / (hl[-1] + self.ridge)
                gain[(n < self.least) | (n[-1] - n < self.least)] = -1
                at = int(gain.argmax())
                if gain[at] > best[0]:
                    best = (float(gain[at]), j, at)
            if best[1] >= 0:
                tree[k] = (best[1], best[2], tree[k][2])
                node[own] = 2 * k + 1 + (binned[own, best[1]] > best[2])
        return tree, node

    def score(self, x: np.ndarray) -> np.ndarray:
        binned, total = self._bin(x), np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), int)
            for _ in range(self.depth):
                f = feature[node]
                node = np.where(f >= 0, 2 * node + 1 + (binned[rows, np.maximum(f, 0)] > cut[node]), node)
            total += value[node]
        return total


class Isotonic:
    """Non-decreasing fit by pooling adjacent violators, linear between block means."""

    def fit(self, score: np.ndarray, y: np.ndarray) -> Isotonic:
        blocks: list[list[float]] = []
        for s, v in zip(*(a[np.argsort(score, kind="stable")] for a in (score, y)), strict=True):
            blocks.append([float(s), float(v), 1.0])
            while len(blocks) > 1 and (blocks[-2][1] >= blocks[-1][1] or blocks[-2][0] == blocks[-1][0]):
                (s1, v1, n1), (s2, v2, n2) = blocks[-2], blocks[-1]
                blocks[-2:] = [[(s1 * n1 + s2 * n2) / (n1 + n2), (v1 * n1 + v2 * n2) / (n1 + n2), n1 + n2]]
        self.x = np.array([b[0] for b in blocks] or [0.0])
        self.y = np.array([b[1] for b in blocks] or [0.0])
        return self

    def value(self, score: np.ndarray) -> np.ndarray:
        return np.interp(score, self.x, self.y)
