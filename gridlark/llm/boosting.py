"""Gradient-boosted trees with logistic loss over binned dense features, and isotonic calibration; numpy only."""

from __future__ import annotations

import numpy as np


class Boosted:
    """Trees of fixed depth over quantile bins; deterministic."""

    def __init__(self, trees: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 32, least: float = 5.0, ridge: float = 1.0):
        self.trees, self.depth, self.rate, self.bins, self.least, self.ridge = trees, depth, rate, bins, least, ridge
        self.edges: list[np.ndarray] = []
        self.nodes: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.base = 0.0
        self.steps_x, self.steps_y = np.zeros(0), np.zeros(0)

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, f], "right") for f, e in enumerate(self.edges)], 1) if len(self.edges) else np.zeros((len(x), 0), int)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        quantiles = np.linspace(0, 1, self.bins + 1)[1:-1]
        # Quantiles of the values above zero: sparse features keep their resolution; zero has a bin of its own.
        self.edges = [np.unique(np.concatenate([[1e-12], np.quantile(p, quantiles)])) if len(p := c[c > 0]) else np.array([1e-12]) for c in x.T]
        b = self._bin(x)
        mean = min(max(y.mean() if len(y) else 0.1, 1e-3), 1 - 1e-3)
        self.base = float(np.log(mean / (1 - mean)))
        if len(np.unique(y)) < 2:
            return self
        f, width = np.full(len(y), self.base), max(len(e) for e in self.edges) + 1
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-f))
            g, h = y - p, np.maximum(p * (1 - p), 1e-6)
            feature, split, value = np.full(2**self.depth - 1, -1), np.zeros(2**self.depth - 1, int), np.zeros(2 ** (self.depth + 1) - 1)
            node = np.zeros(len(y), int)
            for i in range(2 ** (self.depth + 1) - 1):
                own = np.flatnonzero(node == i)
                if not len(own):
                    continue
                gs, hs = g[own].sum(), h[own].sum()
                value[i] = gs / (hs + self.ridge)
                if i >= len(feature):
                    continue
                best = (1e-9, -1, 0)
                for k in range(b.shape[1]):
                    gk, hk = np.cumsum(np.bincount(b[own, k], g[own], width))[:-1], np.cumsum(np.bincount(b[own, k], h[own], width))[:-1]
                    nk = np.cumsum(np.bincount(b[own, k], minlength=width))[:-1]
                    ok = (nk >= self.least) & (len(own) - nk >= self.least)
                    gain = np.where(ok, gk**2 / (hk + self.ridge) + (gs - gk) ** 2 / (hs - hk + self.ridge) - gs**2 / (hs + self.ridge), 0)
                    at = int(gain.argmax())
                    if gain[at] > best[0]:
                        best = (gain[at], k, at)
                if best[1] >= 0:
                    feature[i], split[i] = best[1], best[2]
                    node[own] = 2 * i + 1 + (b[own, best[1]] > best[2])
            self.nodes.append((feature, split, value * self.rate))
            f += value[node] * self.rate
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        b, f = self._bin(x), np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, split, value in self.nodes:
            node = np.zeros(len(x), int)
            for _ in range(self.depth):
                k = feature[np.minimum(node, len(feature) - 1)]
                go = (k >= 0) & (node < len(feature))
                right = b[rows, np.maximum(k, 0)] > split[np.minimum(node, len(split) - 1)]
                node = np.where(go, 2 * node + 1 + right, node)
            f += value[node]
        return f

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        """Isotonic regression of y on the raw score by pooling adjacent violators, rows of one score taken together; a
        pseudo-count keeps it off 0 and 1."""
        values, which = np.unique(self.raw(x), return_inverse=True)
        total, many = np.bincount(which, y, len(values)), np.bincount(which, minlength=len(values))
        pools: list[list[float]] = []  # sum, weight, first score, last score
        for s, t, n in zip(values.tolist(), total.tolist(), many.tolist(), strict=True):
            pools.append([t, float(n), s, s])
            while len(pools) > 1 and pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1]:
                t2, w2, _, e2 = pools.pop()
                pools[-1][0] += t2
                pools[-1][1] += w2
                pools[-1][3] = e2
        if pools:
            mean = y.mean()
            level = [(t + mean) / (w + 1) for t, w, _, _ in pools]
            self.steps_x = np.array([x for p in pools for x in (p[2], p[3])])
            self.steps_y = np.maximum.accumulate(np.array([v for v in level for _ in (0, 1)]))
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        r = self.raw(x)
        return np.clip(np.interp(r, self.steps_x, self.steps_y), 0, 1) if len(self.steps_x) else 1 / (1 + np.exp(-r))
