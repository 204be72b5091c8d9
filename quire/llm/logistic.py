"""Small logistic models in numpy, for fits on bounded samples."""

from __future__ import annotations

import numpy as np


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit_dense(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, weight: np.ndarray | None = None, steps: int = 30) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the last coefficient is the intercept, which isn't shrunk."""
    x = np.hstack([x, np.ones((len(x), 1))])
    weight = np.ones(len(x)) if weight is None else weight
    shrink = np.full(x.shape[1], ridge)
    shrink[-1] = 1e-6
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = sigmoid(x @ w)
        slope = x.T @ (weight * (p - y)) + shrink * w
        curve = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.diag(shrink)
        move = np.linalg.solve(curve, slope)
        w -= move * min(1.0, 5.0 / max(1e-12, np.abs(move).max()))
        if np.abs(move).max() < 1e-7:
            break
    return w


class Sparse:
    """Rows of feature numbers (all values 1, or those given)."""

    def __init__(self, rows: list, n: int, values: list | None = None):
        self.sizes = np.array([len(r) for r in rows], np.int64)
        self.n = n
        self.at = np.concatenate([np.asarray(r, np.int64) for r in rows]) if rows and self.sizes.sum() else np.zeros(0, np.int64)
        self.row = np.repeat(np.arange(len(rows)), self.sizes)
        self.values = np.concatenate([np.asarray(v, float) for v in values]) if values and self.sizes.sum() else np.ones(len(self.at))

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.values * w[self.at], minlength=len(self.sizes))

    def t_dot(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.at, self.values * r[self.row], minlength=self.n)


def fit_sparse(x: Sparse, y: np.ndarray, pairs: Sparse, lasso: float, ridge: float, pair_weight: float, steps: int = 300, times: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Elastic-net logistic regression by accelerated proximal steps, with a penalty on paired score changes.

    Minimises the mean log loss + lasso * |w| + ridge / 2 * w^2 + pair_weight / 2 * mean over pairs of (d . w)^2,
    where each row d of `pairs` is the difference of two rows that must score alike; it counts `times` (1 if not given).
    """
    times = np.ones(len(pairs.sizes)) if times is None else times
    n, share = max(1, len(y)), times / max(1.0, float(times.sum()))
    w, b = np.zeros(x.n), float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))) if len(y) else 0.0
    probe = np.random.default_rng(0).normal(size=x.n)
    for _ in range(12):  # largest curvature by power iteration
        probe = x.t_dot(x.dot(probe)) / (4 * n) + pair_weight * pairs.t_dot(share * pairs.dot(probe))
        top = float(np.linalg.norm(probe))
        probe /= max(top, 1e-12)
    rate = 1 / (1.1 * top + ridge + 0.25 + 1e-9)
    v, c, t = w.copy(), b, 1.0
    for _ in range(steps):
        r = (sigmoid(x.dot(v) + c) - y) / n
        slope = x.t_dot(r) + ridge * v + pair_weight * pairs.t_dot(share * pairs.dot(v))
        new = v - rate * slope
        new = np.sign(new) * np.maximum(np.abs(new) - rate * lasso, 0)
        new_b = c - rate * r.sum()
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = new + (t - 1) / t_new * (new - w), new_b + (t - 1) / t_new * (new_b - b)
        done = np.abs(new - w).max(initial=0) < 1e-7
        w, b, t = new, new_b, t_new
        if done:
            break
    return w, b


def take(x: Sparse, rows: np.ndarray) -> Sparse:
    """Some rows of a Sparse (a mask)."""
    out = Sparse([], x.n)
    keep = rows[x.row]
    out.sizes, out.at, out.values = x.sizes[rows], x.at[keep], x.values[keep]
    out.row = (np.cumsum(rows) - 1)[x.row[keep]]
    return out
