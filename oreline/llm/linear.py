"""Logistic regression with numpy, for bounded samples."""

from __future__ import annotations

import numpy as np


class Rows:
    """Sparse binary rows (sorted column lists) with optional dense columns behind them."""

    def __init__(self, lists: list[np.ndarray], n_columns: int, dense: np.ndarray | None = None):
        self.n, self.d = len(lists), n_columns
        self.columns = np.concatenate(lists).astype(np.int32) if lists else np.empty(0, np.int32)
        self.row = np.repeat(np.arange(self.n, dtype=np.int32), [len(x) for x in lists])
        self.dense = np.empty((self.n, 0)) if dense is None else dense

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=w[self.columns], minlength=self.n) + self.dense @ w[self.d : self.d + self.dense.shape[1]] + w[-1]

    def back(self, r: np.ndarray) -> np.ndarray:
        return np.concatenate([np.bincount(self.columns, weights=r[self.row], minlength=self.d), self.dense.T @ r, [r.sum()]])

    def width(self) -> int:
        return self.d + self.dense.shape[1] + 1


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def fit_logistic(rows: Rows, y: np.ndarray, l2: float = 1.0, steps: int = 60, use: np.ndarray | None = None) -> np.ndarray:
    """Weights (the last is the intercept) by L-BFGS; ``use`` weighs the rows.

    With one class only, the weights are 0 and the intercept is the smoothed prior.
    """
    use = np.ones(rows.n) if use is None else use.astype(float)
    w = np.zeros(rows.width())
    positive, total = float((use * y).sum()), float(use.sum())
    w[-1] = np.log((positive + 0.5) / (total - positive + 0.5))
    if positive == 0 or positive == total:
        return w
    penalty = np.full(len(w), l2)
    penalty[-1] = 0

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        z = rows.dot(w)
        value = float((use * (np.logaddexp(0, z) - y * z)).sum() + 0.5 * (penalty * w * w).sum())
        return value, rows.back(use * (sigmoid(z) - y)) + penalty * w

    f, g = loss(w)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        d, a = g.copy(), []
        for s, t in reversed(past):
            a.append((s @ d) / (s @ t))
            d -= a[-1] * t
        d *= (past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1]) if past else 1 / max(1.0, float(np.abs(g).sum()))
        for (s, t), alpha in zip(past, reversed(a), strict=True):
            d += s * (alpha - (t @ d) / (s @ t))
        step, slope = 1.0, float(g @ d)
        while True:
            f2, g2 = loss(w - step * d)
            if f2 <= f - 1e-4 * step * slope or step < 1e-8:
                break
            step /= 2
        if step < 1e-8 or f - f2 < 1e-7 * abs(f):
            break
        s, t = -step * d, g2 - g
        if s @ t > 1e-12:
            past = [*past[-9:], (s, t)]
        w, f, g = w - step * d, f2, g2
    return w
