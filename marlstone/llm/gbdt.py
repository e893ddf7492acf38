"""Gradient-boosted trees over binned dense features, and isotonic calibration, in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    """Complete trees of one depth: node i has the children 2i+1 and 2i+2; a row goes right where its bin is above cut."""

    edges: list[np.ndarray]
    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray
    start: float
    depth: int

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(self.edges)], 1).astype(np.int16)

    def raw(self, x: np.ndarray) -> np.ndarray:
        bins, out, rows = self.binned(x), np.full(len(x), self.start), np.arange(len(x))
        for f, c, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (bins[rows, f[node]] > c[node])
            out += leaf[node - (2**self.depth - 1)]
        return out


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, trees: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 48, least: float = 10.0, ridge: float = 1.0) -> Trees:
    """Newton boosting of the logistic loss; splits by exact search over bin sums."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    p = np.clip(np.average(y, weights=weight), 1e-4, 1 - 1e-4)
    model = Trees(edges, np.zeros((trees, 2**depth - 1), np.int64), np.full((trees, 2**depth - 1), 32767, np.int16), np.zeros((trees, 2**depth)), float(np.log(p / (1 - p))), depth)
    b, raw = model.binned(x), np.full(len(x), model.start)
    wide = bins + 1
    for t in range(trees):
        q = 1 / (1 + np.exp(-raw))
        g, h = weight * (q - y), weight * q * (1 - q) + 1e-9
        node = np.zeros(len(x), np.int64)
        for d in range(depth):
            base, many = 2**d - 1, 2**d
            best, which, where = np.full(many, 1e-6), np.zeros(many, np.int64), np.full(many, 32767)
            key = (node - base) * wide
            n = np.bincount(node - base, weight, many)[:, None]
            gs, hs = np.bincount(node - base, g, many)[:, None], np.bincount(node - base, h, many)[:, None]
            for j in range(x.shape[1]):
                sums = [np.bincount(key + b[:, j], v, many * wide).reshape(many, wide).cumsum(1)[:, :-1] for v in (g, h, weight)]
                gain = sums[0] ** 2 / (sums[1] + ridge) + (gs - sums[0]) ** 2 / (hs - sums[1] + ridge) - gs**2 / (hs + ridge)
                gain[(sums[2] < least) | (n - sums[2] < least)] = -1
                k = gain.argmax(1)
                top = gain[np.arange(many), k]
                better = top > best
                best[better], which[better], where[better] = top[better], j, k[better]
            model.feature[t, base : base + many], model.cut[t, base : base + many] = which, where
            node = 2 * node + 1 + (b[np.arange(len(x)), which[node - base]] > where[node - base])
        leaf = node - (2**depth - 1)
        model.leaf[t] = -rate * np.bincount(leaf, g, 2**depth) / (np.bincount(leaf, h, 2**depth) + ridge)
        raw += model.leaf[t][leaf]
    return model


def isotonic(score: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing step function nearest to y (pool adjacent violators), with half a row of either label in each block's mean."""
    # Rows of one score are one row, whatever their order.
    scores, at = np.unique(score, return_inverse=True)
    blocks: list[list[float]] = []
    for s, v, w in zip(scores, np.bincount(at, y * weight, len(scores)), np.bincount(at, weight, len(scores)), strict=True):
        blocks.append([v, w, s, s])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            a, b, _, hi = blocks.pop()
            blocks[-1] = [blocks[-1][0] + a, blocks[-1][1] + b, blocks[-1][2], hi]
    half = float(np.mean(weight)) / 2 if len(weight) else 0.5
    xs, ys = [], []
    for a, w, lo, hi in blocks:
        xs += [lo, hi]
        ys += [(a + half) / (w + 2 * half)] * 2
    return np.array(xs), np.maximum.accumulate(np.array(ys))
