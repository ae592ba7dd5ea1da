"""Gradient-boosted trees for a binary label, on dense features, and isotonic calibration; numpy only.

Trees are complete and of fixed depth, so a model is three small arrays and scoring is a few array look-ups a tree.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def bin_edges(x: np.ndarray, bins: int) -> list[np.ndarray]:
    """Distinct inner quantiles of each feature; a value goes right of an edge if greater."""
    q = np.linspace(0, 1, bins + 1)[1:-1]
    return [np.unique(np.quantile(x[:, j], q)) for j in range(x.shape[1])]


@dataclass
class Boosted:
    """feature and cut: (trees, 2^depth - 1), leaf: (trees, 2^depth); base: log odds to start from."""

    depth: int
    base: float
    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for f, c, leaf in zip(self.feature, self.cut, self.leaf):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, f[node]] > c[node])
            out += leaf[node - (2**self.depth - 1)]
        return out


def fit(
    x: np.ndarray, y: np.ndarray, trees: int = 120, depth: int = 4, rate: float = 0.1, bins: int = 48, ridge: float = 1.0, least: float = 5.0
) -> Boosted:
    """Newton boosting of the logistic loss; splits need `least` rows' worth of curvature (times 0.1) on either side."""
    n, width = x.shape
    share = min(max(float(y.mean()) if n else 0.5, 1e-3), 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    inner, leaves = 2**depth - 1, 2**depth
    feature, cut, leaf = np.zeros((trees, inner), dtype=np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves))
    if not n or y.min() == y.max():
        return Boosted(depth, base, feature[:0], cut[:0], leaf[:0])
    edges = bin_edges(x, bins)
    coded = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)  # bin b: edges[b-1] < v <= edges[b]
    score = np.full(n, base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, np.maximum(p * (1 - p), 1e-9)
        node = np.zeros(n, dtype=np.int64)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            gain = np.full(count, 1e-9)
            at = np.zeros(count, dtype=np.int64)
            to = np.full(count, np.inf)
            for j in range(width):
                if not len(edges[j]):
                    continue
                key = (node - first) * bins + coded[:, j]
                sg = np.bincount(key, g, count * bins).reshape(count, bins).cumsum(1)
                sh = np.bincount(key, h, count * bins).reshape(count, bins).cumsum(1)
                tg, th = sg[:, -1:], sh[:, -1:]
                own = sg**2 / (sh + ridge) + (tg - sg) ** 2 / (th - sh + ridge) - tg**2 / (th + ridge)
                own[(sh < 0.1 * least) | (th - sh < 0.1 * least)] = 0
                own = own[:, : len(edges[j])]
                best = own.argmax(1)
                value = own[np.arange(count), best]
                better = value > gain
                gain[better], at[better], to[better] = value[better], j, edges[j][best[better]]
            feature[t, first : first + count], cut[t, first : first + count] = at, to
            node = 2 * node + 1 + (x[np.arange(n), feature[t, node]] > cut[t, node])
        end = node - inner
        leaf[t] = rate * np.bincount(end, g, leaves) / (np.bincount(end, h, leaves) + ridge)
        score += leaf[t][end]
    return Boosted(depth, base, feature, cut, leaf)


@dataclass
class Isotonic:
    """A non-decreasing piecewise linear map from log odds to probability."""

    at: np.ndarray
    value: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.interp(x, self.at, self.value)


def calibrate(score: np.ndarray, y: np.ndarray) -> Isotonic:
    """Pool adjacent violators; a pool's mean is drawn a little to the whole mean, so that none is exactly 0 or 1."""
    if not len(score):
        return Isotonic(np.array([0.0]), np.array([0.5]))
    order = np.argsort(score, kind="stable")
    pools: list[list[float]] = []  # sum of labels, rows, first score, last score
    for s, label in zip(score[order], y[order]):
        if pools and pools[-1][3] == s:  # tied scores cannot be told apart
            pools[-1][0] += label
            pools[-1][1] += 1
        else:
            pools.append([float(label), 1.0, float(s), float(s)])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            top = pools.pop()
            pools[-1] = [pools[-1][0] + top[0], pools[-1][1] + top[1], pools[-1][2], top[3]]
    mean = float(y.mean())
    at = [v for p in pools for v in ((p[2], p[3]) if p[3] > p[2] else (p[2],))]
    value = [(p[0] + mean) / (p[1] + 1) for p in pools for _ in ((0, 1) if p[3] > p[2] else (0,))]
    return Isotonic(np.array(at), np.maximum.accumulate(np.array(value)))
