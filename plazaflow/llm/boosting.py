"""Gradient-boosted trees on binned features, and isotonic calibration, in numpy."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Tree:
    """A complete binary tree: entry k's children are 2k + 1 and 2k + 2; rows go right where the feature is above the cut."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        at, rows = np.zeros(len(x), np.int64), np.arange(len(x))
        while (inner := self.feature[at] >= 0).any():
            right = x[rows, np.maximum(self.feature[at], 0)] > self.cut[at]
            at = np.where(inner, 2 * at + 1 + right, at)
        return self.value[at]


@dataclass
class Boosted:
    trees: list[Tree] = field(default_factory=list)
    start: float = 0.0

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.start + sum((t.predict(x) for t in self.trees), np.zeros(len(x)))


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 48, l2: float = 2.0, least: int = 8) -> Boosted:
    """Second-order boosting of the logistic loss; cuts are sought among quantiles of each feature."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], 1)
    share = min(max(y.mean(), 1e-4), 1 - 1e-4)
    model = Boosted([], float(np.log(share / (1 - share))))
    score = np.full(len(y), model.start)
    size = 2 ** (depth + 1) - 1
    for _ in range(trees):
        p = sigmoid(score)
        g, h = y - p, p * (1 - p)
        tree = Tree(np.full(size, -1), np.zeros(size), np.zeros(size))
        at = np.zeros(len(y), np.int64)
        for node in range(size):
            rows = np.flatnonzero(at == node)
            if not len(rows):
                continue
            total_g, total_h = g[rows].sum(), h[rows].sum()
            tree.value[node] = rate * total_g / (total_h + l2)
            if 2 * node + 2 >= size or len(rows) < 2 * least:
                continue
            best = (1e-6, -1, 0)
            for j, e in enumerate(edges):
                if not len(e):
                    continue
                b = binned[rows, j]
                left_g, left_h, left_n = (np.cumsum(np.bincount(b, w, len(e) + 1))[:-1] for w in (g[rows], h[rows], None))
                gain = left_g**2 / (left_h + l2) + (total_g - left_g) ** 2 / (total_h - left_h + l2) - total_g**2 / (total_h + l2)
                gain[(left_n < least) | (len(rows) - left_n < least)] = 0
                if gain[k := int(gain.argmax())] > best[0]:
                    best = (gain[k], j, k)
            if best[1] >= 0:
                _, j, k = best
                tree.feature[node], tree.cut[node] = j, edges[j][k]
                at[rows] = 2 * node + 1 + (binned[rows, j] > k)
        model.trees.append(tree)
        score += tree.predict(x)
    return model


def fit_isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the least-squares non-decreasing map from scores to labels, by pooling adjacent violators."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []  # mean, weight, sum of scores
    for s, v in zip(score[order], y[order]):
        blocks.append([float(v), 1.0, float(s)])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            m, w, t = blocks.pop()
            a = blocks[-1]
            a[0], a[1], a[2] = (a[0] * a[1] + m * w) / (a[1] + w), a[1] + w, a[2] + t
    return np.array([t / w for _, w, t in blocks]), np.array([m for m, _, _ in blocks])


def calibrated(score: np.ndarray, knots: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Probabilities by the knots, between them in a line, beyond them level."""
    return np.interp(score, *knots)
