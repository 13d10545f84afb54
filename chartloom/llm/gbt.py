"""Gradient-boosted trees on histograms, for binary labels; small and deterministic."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Trees:
    """Each tree is complete: node k has children 2k+1 and 2k+2; leaves stand after the inner nodes."""

    base: float
    depth: int
    edges: list[np.ndarray] = field(default_factory=list)
    split_feature: list[np.ndarray] = field(default_factory=list)
    split_bin: list[np.ndarray] = field(default_factory=list)
    leaf: list[np.ndarray] = field(default_factory=list)

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], side="left") for k, e in enumerate(self.edges)], 1) if len(x) else np.zeros((0, len(self.edges)), int)

    def margin(self, x: np.ndarray) -> np.ndarray:
        b, out = self.binned(x), np.full(len(x), self.base)
        for f, t, leaf in zip(self.split_feature, self.split_bin, self.leaf):
            node = np.zeros(len(x), int)
            for _ in range(self.depth):
                node = 2 * node + 1 + (b[np.arange(len(x)), f[node]] > t[node])
            out += leaf[node - (2**self.depth - 1)]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, smooth: float = 1.0) -> Trees:
    """Newton steps of the logistic loss; splits by gain over at most bins quantile bins of each feature.

    Without rows, or with one class only, the result is the smoothed base rate.
    """
    rate_1 = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.5
    model = Trees(float(np.log(rate_1 / (1 - rate_1))), depth)
    model.edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) if len(y) else np.zeros(0) for c in x.T]
    if len(np.unique(y)) < 2:
        return model
    b, margin = model.binned(x), np.full(len(y), model.base)
    inner = 2**depth - 1
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        feature, cut, node = np.zeros(inner, int), np.full(inner, bins + 1), np.zeros(len(y), int)
        for k in range(inner):
            here = np.flatnonzero(node == k)
            if len(here) < 2:
                node[here] = 2 * k + 1
                continue
            best = (1e-9, 0, bins + 1)
            total_g, total_h = g[here].sum(), h[here].sum()
            for f in range(x.shape[1]):
                gs = np.cumsum(np.bincount(b[here, f], g[here], bins))
                hs = np.cumsum(np.bincount(b[here, f], h[here], bins))
                gain = gs**2 / (hs + smooth) + (total_g - gs) ** 2 / (total_h - hs + smooth) - total_g**2 / (total_h + smooth)
                at = int(np.argmax(gain))
                if gain[at] > best[0]:
                    best = (float(gain[at]), f, at)
            feature[k], cut[k] = best[1], best[2]
            node[here] = 2 * k + 1 + (b[here, best[1]] > best[2])
        leaf = rate * np.bincount(node - inner, g, inner + 1) / (np.bincount(node - inner, h, inner + 1) + smooth)
        model.split_feature.append(feature)
        model.split_bin.append(cut)
        model.leaf.append(leaf)
        margin += leaf[node - inner]
    return model
