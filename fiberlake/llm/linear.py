"""Small model fits on bounded samples, in numpy on the driver."""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def best_cut(scores: np.ndarray, y: np.ndarray) -> float:
    """A quantile of the scores with the best balanced accuracy, half-way between the scores beside it; the middle one of equally good ones."""
    order = np.argsort(scores, kind="stable")
    s, ranked = scores[order], y[order]
    good = np.concatenate(([0], np.cumsum(ranked == 0))) / max(1, (y == 0).sum()) - np.concatenate(([0], np.cumsum(ranked == 1))) / max(1, (y == 1).sum())
    apart = np.flatnonzero(np.concatenate(([False], s[1:] > s[:-1], [False])))
    if not len(apart):
        return float(s[0])
    best = apart[good[apart] >= good[apart].max() - 1e-12]
    # where a cut below and one above are as good, the wider gap is the safer one
    i = best[np.argmax(s[best] - s[best - 1])]
    return float((s[i - 1] + s[i]) / 2)


def bradley_terry(x: np.ndarray, y: np.ndarray, pairs: int, steps: int = 300, l2: float = 1e-3, seed: int = 1) -> np.ndarray:
    """Weights w such that sigmoid(w . (x_winner - x_loser)) fits preference pairs of label 1 over label 0; Adam on the logistic loss."""
    rng = np.random.default_rng(seed)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    w = np.zeros(x.shape[1])
    if not len(good) or not len(bad):
        return w
    d = x[rng.choice(good, pairs)] - x[rng.choice(bad, pairs)]
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        g = -(d * sigmoid(-(d @ w))[:, None]).mean(0) + l2 * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


class FactorizationMachine:
    """w0 + sum of w + pairwise interactions <v_i, v_j> of the present terms; logistic loss, Adam."""

    def __init__(self, terms: int, factors: int, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.w0, self.w, self.v = 0.0, np.zeros(terms), rng.normal(0, 0.05, (terms, factors))

    def margin(self, docs: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
        """docs, ids: one entry for each distinct term of each of n documents."""
        linear = np.bincount(docs, self.w[ids], n)
        pair = np.zeros(n)
        for f in range(self.v.shape[1]):
            col = self.v[ids, f]
            pair += np.bincount(docs, col, n) ** 2 - np.bincount(docs, col * col, n)
        return self.w0 + linear + pair / 2

    def fit(self, docs: np.ndarray, ids: np.ndarray, y: np.ndarray, steps: int = 400, l2: float = 5e-5, rate: float = 0.05) -> None:
        """Both classes weigh alike, whatever their counts. Terms are held as a dense matrix of 4 bytes a document and term, so that a step is two products."""
        weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
        n, terms, factors = len(y), len(self.w), self.v.shape[1]
        x = np.zeros((n, terms), np.float32)
        x[docs, ids] = 1
        theta = np.concatenate(([self.w0], self.w, self.v.ravel()))
        m, s = np.zeros_like(theta), np.zeros_like(theta)
        for t in range(1, steps + 1):
            self.w0, self.w, self.v = theta[0], theta[1 : terms + 1], theta[terms + 1 :].reshape(terms, factors)
            sums = x @ np.column_stack((self.w, (self.v**2).sum(1), self.v)).astype(np.float32)
            total = sums[:, 2:]
            r = (sigmoid(self.w0 + sums[:, 0] + ((total**2).sum(1) - sums[:, 1]) / 2) - y) * weight
            back = x.T @ np.column_stack((r, r[:, None] * total)).astype(np.float32)
            gv = back[:, 1:] - self.v * back[:, :1]
            g = np.concatenate(([r.sum()], back[:, 0], gv.ravel())) + l2 * np.concatenate(([0.0], theta[1:]))
            m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
            theta = theta - rate * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)
        self.w0, self.w, self.v = float(theta[0]), theta[1 : terms + 1].copy(), theta[terms + 1 :].reshape(terms, factors).copy()
