"""Small models fitted on the driver from bounded samples."""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def column_spread(x: np.ndarray, rows: int = 512) -> np.ndarray:
    """The standard deviation of each column, without a copy of the array."""
    mean, total = x.mean(0, dtype=float), np.zeros(x.shape[1])
    for at in range(0, len(x), rows):
        total += ((x[at : at + rows] - mean) ** 2).sum(0)
    return np.sqrt(total / len(x))


def fit_logistic(x: np.ndarray, y: np.ndarray, l2: float = 1.0, steps: int = 300) -> np.ndarray:
    """Weights, the last one the bias, of a ridge logistic regression by accelerated gradient steps.

    Columns are scaled to unit variance inside; without rows, or with one class only, the bias alone is set.
    """
    n = len(y)
    if not n or y.min() == y.max():
        rate = (y.sum() + 0.5) / (n + 1.0)
        return np.append(np.zeros(x.shape[1]), np.log(rate / (1 - rate)))
    mean, spread = x.mean(0, dtype=float), column_spread(x)
    spread = np.where(spread < 1e-9, 1.0, spread)
    z = np.ones((n, x.shape[1] + 1), x.dtype if x.dtype == np.float32 else float)
    np.subtract(x, mean, out=z[:, :-1])  # in place: a sample's features are the largest thing on the driver
    z[:, :-1] /= spread
    ridge = np.append(np.full(x.shape[1], l2), 0.0)
    probe = np.ones(z.shape[1])
    for _ in range(20):
        probe = (z.T @ (z @ probe.astype(z.dtype))).astype(float)
        size = np.linalg.norm(probe)
        probe /= size
    step = 1 / (0.25 * size + l2)
    w = v = np.zeros(z.shape[1])
    for k in range(steps):
        off = (sigmoid(z @ v.astype(z.dtype)) - y).astype(z.dtype)
        new = v - step * (z.T @ off + ridge * v)
        w, v = new, new + k / (k + 3) * (new - w)
    slopes = w[:-1] / spread
    return np.append(slopes, w[-1] - slopes @ mean)


def predict(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    return sigmoid(x @ w[:-1] + w[-1])


class BoostedTrees:
    """Gradient boosting for logistic loss with depth-limited trees over a few cut points per feature."""

    def __init__(self, rounds: int = 40, depth: int = 3, rate: float = 0.3, cuts: int = 16, least: int = 10):
        self.rounds, self.depth, self.rate, self.cuts, self.least = rounds, depth, rate, cuts, least
        self.trees: list = []
        self.base = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(rate / (1 - rate)))
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.cuts + 1)[1:-1])) for c in x.T]
        score = np.full(len(y), self.base)
        for _ in range(self.rounds):
            p = sigmoid(score)
            tree = self._grow(x, y - p, p * (1 - p), edges, np.arange(len(y)), self.depth)
            self.trees.append(tree)
            score += self._walk(tree, x)
        return self

    def _grow(self, x, g, h, edges, rows, depth):
        gain, pick = 1e-6, None
        total_g, total_h = g[rows].sum(), h[rows].sum()
        if depth:
            for k, cuts in enumerate(edges):
                for cut in cuts:
                    left = x[rows, k] <= cut
                    n = left.sum()
                    if n < self.least or len(rows) - n < self.least:
                        continue
                    a, b = g[rows][left].sum(), h[rows][left].sum()
                    more = a * a / (b + 1) + (total_g - a) ** 2 / (total_h - b + 1) - total_g**2 / (total_h + 1)
                    if more > gain:
                        gain, pick = more, (k, float(cut), left)
        if pick is None:
            return float(self.rate * total_g / (total_h + 1))
        k, cut, left = pick
        return (k, cut, self._grow(x, g, h, edges, rows[left], depth - 1), self._grow(x, g, h, edges, rows[~left], depth - 1))

    def _walk(self, tree, x: np.ndarray) -> np.ndarray:
        if not isinstance(tree, tuple):
            return np.full(len(x), tree)
        k, cut, low, high = tree
        return np.where(x[:, k] <= cut, self._walk(low, x), self._walk(high, x))

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.base + sum((self._walk(t, x) for t in self.trees), np.zeros(len(x)))
