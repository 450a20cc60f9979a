"""Gradient-boosted trees and isotonic calibration on bounded samples, in numpy."""

from __future__ import annotations

import numpy as np


def _bins(column: np.ndarray, n: int) -> np.ndarray:
    """Cut points: quantiles of the distinct values' ranks; a value goes right if it is above the cut."""
    values = np.unique(column)
    if len(values) <= 1:
        return np.empty(0)
    cuts = np.unique(np.quantile(column, np.linspace(0, 1, n + 1)[1:-1], method="lower"))
    rare = values[np.linspace(0, len(values) - 2, min(n, len(values) - 1)).astype(int)]
    return np.unique(np.r_[cuts[cuts < values[-1]], rare])


class Boosted:
    """Log-loss boosting with second-order leaf values; trees are complete and of equal depth."""

    def __init__(self, trees: int = 120, depth: int = 3, rate: float = 0.1, bins: int = 48, least: int = 20, ridge: float = 1.0):
        self.trees, self.depth, self.rate, self.bins, self.least, self.ridge = trees, depth, rate, bins, least, ridge

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        cuts = [_bins(c, self.bins) for c in x.T]
        codes = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T, strict=True)], axis=1)
        p = np.clip(y.mean(), 1e-6, 1 - 1e-6)
        self.start = float(np.log(p / (1 - p)))
        raw = np.full(len(y), self.start)
        inner = (1 << self.depth) - 1
        self.feature, self.cut, self.leaf = (np.zeros((self.trees, m), t) for m, t in ((inner, int), (inner, float), (inner + 1, float)))
        for t in range(self.trees):
            prob = 1 / (1 + np.exp(-raw))
            g, h = prob - y, prob * (1 - prob)
            node = np.zeros(len(y), int)
            for at in range(inner):
                own = np.flatnonzero(node == at)
                f, c = self._split(codes[own], cuts, g[own], h[own])
                self.feature[t, at], self.cut[t, at] = f, cuts[f][c] if c >= 0 else np.inf
                node[own] = 2 * at + 1 + (codes[own, f] > c if c >= 0 else 0)
            leaf = node - inner
            num, den = np.bincount(leaf, g, inner + 1), np.bincount(leaf, h, inner + 1)
            self.leaf[t] = -self.rate * num / (den + self.ridge)
            raw += self.leaf[t][leaf]
        return self

    def _split(self, codes, cuts, g, h):
        best, at = 1e-9, (0, -1)
        if len(g) < 2 * self.least:
            return at
        gain = lambda a, b: a * a / (b + self.ridge)
        whole = gain(g.sum(), h.sum())
        for f, cut in enumerate(cuts):
            if not len(cut):
                continue
            n, gs, hs = (np.bincount(codes[:, f], w, len(cut) + 1).cumsum() for w in (None, g, h))
            ok = (n[:-1] >= self.least) & (n[-1] - n[:-1] >= self.least)
            score = np.where(ok, gain(gs[:-1], hs[:-1]) + gain(gs[-1] - gs[:-1], hs[-1] - hs[:-1]) - whole, 0)
            if score.max() > best:
                best, at = score.max(), (f, int(score.argmax()))
        return at

    def raw(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.start), np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), int)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            out += leaf[node - len(feature)]
        return out


def _pooled(pools: list[list[float]]) -> list[list[float]]:
    """Neighbours (rate, weight, first and last score) whose rates fall, or that share a score, become one."""
    out: list[list[float]] = []
    for p in pools:
        out.append(list(p))
        while len(out) > 1 and (out[-2][0] >= out[-1][0] or out[-2][3] == out[-1][2]):
            b, a = out.pop(), out.pop()
            w = a[1] + b[1]
            out.append([(a[0] * a[1] + b[0] * b[1]) / w, w, a[2], b[3]])
    return out


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots (score, rate), to be interpolated. Each pool is shrunk a little to the mean;
    pools that this puts out of order are pooled again, so that a small pool can't lift those above it."""
    order = np.argsort(score, kind="stable")
    pools = _pooled([[float(v), 1.0, s, s] for s, v in zip(score[order], y[order], strict=True)])
    mean = float(y.mean())
    pools = _pooled([[(rate * w + mean) / (w + 1), w, lo, hi] for rate, w, lo, hi in pools])
    return np.array([x for p in pools for x in p[2:]]), np.repeat([p[0] for p in pools], 2)
