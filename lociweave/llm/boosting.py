"""Gradient-boosted trees for two classes over small numeric feature tables (numpy only)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Boosted:
    """Trees as arrays: per tree the features, bounds (go right if above) and leaf values of a complete tree of `depth`."""

    base: float
    depth: int
    features: np.ndarray
    bounds: np.ndarray
    leaves: np.ndarray

    def margin(self, x: np.ndarray) -> np.ndarray:
        rows = np.arange(len(x))
        total = np.full(len(x), self.base)
        for f, b, v in zip(self.features, self.bounds, self.leaves):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, f[node]] > b[node])
            total += v[node - (2**self.depth - 1)]
        return total

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def boost(x: np.ndarray, y: np.ndarray, *, trees: int = 40, depth: int = 4, rate: float = 0.25, bins: int = 24, shrink: float = 1.0) -> Boosted:
    """Fit logistic loss by second-order boosting over binned features. Deterministic."""
    y = y.astype(float)
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) if len(np.unique(c)) > bins else (u := np.unique(c))[:-1] + np.diff(u) / 2 for c in x.T]
    binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)], axis=1)
    width = max(len(e) for e in edges) + 1
    n, m = x.shape
    prior = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(prior / (1 - prior)))
    margin = np.full(n, base)
    inner = 2**depth - 1
    all_f, all_b, all_v = [], [], []
    flat = binned + np.arange(m) * width
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        node = np.zeros(n, np.int64)
        feats, bounds = np.zeros(inner, np.int64), np.full(inner, np.inf)
        cuts = np.full(inner, width)
        for level in range(depth):
            first, size = 2**level - 1, 2**level
            at = (node - first)[:, None] * (m * width) + flat
            sums = [np.bincount(at.ravel(), np.repeat(w, m), minlength=size * m * width).reshape(size, m, width).cumsum(axis=2) for w in (g, h)]
            gl, hl = sums
            gt, ht = gl[..., -1:], hl[..., -1:]
            gain = gl**2 / (hl + shrink) + (gt - gl) ** 2 / (ht - hl + shrink) - gt**2 / (ht + shrink)
            gain[(hl < 0.5) | (ht - hl < 0.5)] = 0
            best = gain.reshape(size, -1).argmax(axis=1)
            for i, b in enumerate(best):
                f, cut = divmod(int(b), width)
                if gain[i, f, cut] > 1e-6 and cut < len(edges[f]):
                    feats[first + i], bounds[first + i], cuts[first + i] = f, edges[f][cut], cut
            node = 2 * node + 1 + (binned[np.arange(n), feats[node]] > cuts[node])
        leaf = node - inner
        gs, hs = (np.bincount(leaf, w, minlength=inner + 1) for w in (g, h))
        values = rate * gs / (hs + shrink)
        margin += values[leaf]
        all_f.append(feats)
        all_b.append(bounds)
        all_v.append(values)
    return Boosted(base, depth, np.array(all_f), np.array(all_b), np.array(all_v))
