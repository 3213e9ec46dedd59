"""Gradient-boosted trees for two classes: histogram splits, monotonic constraints, flat node arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 64


@dataclass(frozen=True)
class Forest:
    """Complete binary trees, one row each; the children of node i are 2i + 1 and 2i + 2, a leaf has feature -1."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    base: float
    depth: int

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of class 1 for each row of `x`, all rows and trees at once."""
        n, trees = len(x), len(self.feature)
        at = np.zeros((n, trees), np.int64)
        tree, row = np.arange(trees)[None, :], np.arange(n)[:, None]
        for _ in range(self.depth):
            f = self.feature[tree, at]
            right = x[row, np.maximum(f, 0)] > self.threshold[tree, at]
            at = np.where(f < 0, at, 2 * at + 1 + right)
        return self.base + self.value[tree, at].sum(axis=1)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def fit(
    x: np.ndarray,
    y: np.ndarray,
    monotone: np.ndarray,
    *,
    trees: int = 80,
    depth: int = 4,
    rate: float = 0.15,
    least_hessian: float = 4.0,
    l2: float = 2.0,
) -> Forest:
    """Fit on rows `x` and labels `y`; `monotone` has +1, -1 or 0 for each feature.

    A split against its feature's direction is never taken, and both sides of a constrained split are held on
    their side of the midpoint further down, so the sum of all trees is monotonic as well. Without rows or with
    one class the forest is the smoothed prior alone.
    """
    prior = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(prior / (1 - prior)))
    nodes = 2 ** (depth + 1) - 1
    feature, threshold, value = np.full((trees, nodes), -1), np.zeros((trees, nodes)), np.zeros((trees, nodes))
    if len(np.unique(y)) < 2:
        return Forest(feature[:1], threshold[:1], value[:1], base, depth)
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T, strict=True)], axis=1)
    margin = np.full(len(y), base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = p - y, p * (1 - p)
        open_ = {0: (np.arange(len(y)), -np.inf, np.inf)}
        while open_:
            node, (rows, low, high) = open_.popitem()
            g, h = grad[rows].sum(), hess[rows].sum()
            value[t, node] = rate * np.clip(-g / (h + l2), low, high)
            if node >= 2**depth - 1:
                continue
            best = (1e-6, -1, 0, 0.0, 0.0)
            for j, cut in enumerate(cuts):
                if not len(cut):
                    continue
                b = binned[rows, j]
                gl = np.cumsum(np.bincount(b, grad[rows], len(cut) + 1))[:-1]
                hl = np.cumsum(np.bincount(b, hess[rows], len(cut) + 1))[:-1]
                gr, hr = g - gl, h - hl
                left, right = np.clip(-gl / (hl + l2), low, high), np.clip(-gr / (hr + l2), low, high)
                gain = gl**2 / (hl + l2) + gr**2 / (hr + l2) - g**2 / (h + l2)
                gain[(hl < least_hessian) | (hr < least_hessian) | (monotone[j] * (right - left) < 0)] = -np.inf
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (gain[k], j, k, left[k], right[k])
            _, j, k, left, right = best
            if j < 0:
                continue
            feature[t, node], threshold[t, node] = j, cuts[j][k]
            below = binned[rows, j] <= k
            mid = (left + right) / 2
            bounds = {1: ((low, mid), (mid, high)), -1: ((mid, high), (low, mid)), 0: ((low, high), (low, high))}
            own, other = bounds[int(monotone[j])]
            open_[2 * node + 1] = (rows[below], *own)
            open_[2 * node + 2] = (rows[~below], *other)
        grown = Forest(feature[t : t + 1], threshold[t : t + 1], value[t : t + 1], 0.0, depth)
        margin += grown.margin(x)
    return Forest(feature, threshold, value, base, depth)
