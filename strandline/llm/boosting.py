"""Histogram gradient-boosted trees in numpy, for a binary label.

Features are cut into at most 255 bins by quantiles; each tree grows leaf by leaf
from histograms of gradients (logistic loss, second order).  A fitted model is a few
flat arrays over all trees, and prediction moves all rows down one level at a time.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Forest:
    """Nodes of all trees in flat arrays; a leaf points to itself on both sides."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        node = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            down = x[rows, self.feature[node]] <= self.threshold[node]
            node = np.where(down, self.left[node], self.right[node])
        return self.base + self.value[node].sum(axis=1)

    def predict(self, x: np.ndarray, chunk: int = 4096) -> np.ndarray:
        """Chance of label 1 for each row of ``x``."""
        parts = [self.margin(x[i : i + chunk]) for i in range(0, len(x), chunk)]
        return 1 / (1 + np.exp(-np.clip(np.concatenate(parts or [np.zeros(0)]), -50, 50)))


def _cuts(column: np.ndarray, bins: int) -> np.ndarray:
    """Bin bounds between different values."""
    values = np.unique(column)
    if len(values) > bins:
        values = np.unique(np.quantile(column, np.linspace(0, 1, bins + 1), method="lower"))
    return (values[:-1] + values[1:]) / 2


def fit(
    x: np.ndarray,
    y: np.ndarray,
    rounds: int = 80,
    rate: float = 0.15,
    leaves: int = 12,
    min_rows: int = 20,
    ridge: float = 1.0,
    bins: int = 254,
) -> Forest:
    """Boosted trees for labels ``y`` (0 or 1).  Deterministic."""
    n, width = x.shape
    cuts = [_cuts(x[:, j], bins) for j in range(width)]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1).astype(np.int64)
    flat = binned + np.arange(width) * (bins + 1)
    rate0 = np.clip((y.sum() + 0.5) / (n + 1), 1e-4, 1 - 1e-4)
    base = float(np.log(rate0 / (1 - rate0)))
    margin = np.full(n, base)
    nodes: list[list[float]] = []  # feature, threshold, left, right, value
    roots, deepest = [], 0

    def best(rows: np.ndarray, g: np.ndarray, h: np.ndarray):
        cell, size = flat[rows].ravel(), width * (bins + 1)
        hist = [np.bincount(cell, np.repeat(w[rows], width), size) for w in (g, h)] + [np.bincount(cell, minlength=size)]
        gs, hs, ns = (np.cumsum(a.reshape(width, -1), axis=1) for a in hist)
        gt, ht, nt = gs[:, -1:], hs[:, -1:], ns[:, -1:]
        gain = gs**2 / (hs + ridge) + (gt - gs) ** 2 / (ht - hs + ridge) - gt**2 / (ht + ridge)
        gain[(ns < min_rows) | (nt - ns < min_rows)] = 0
        j, b = divmod(int(gain.argmax()), bins + 1)
        return float(gain[j, b]), j, b

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        root = len(nodes)
        roots.append(root)
        nodes.append([0, 0.0, root, root, 0.0])
        open_ = [(*best(np.arange(n), g, h), np.arange(n), root, 0)]
        closed = []
        while open_ and len(open_) + len(closed) < leaves:
            i = max(range(len(open_)), key=lambda k: open_[k][0])
            gain, j, b, rows, at, depth = open_.pop(i)
            if gain <= 1e-6:
                closed.append((rows, at))
                continue
            low = binned[rows, j] <= b
            sides = []
            for part in (rows[low], rows[~low]):
                child = len(nodes)
                nodes.append([0, 0.0, child, child, 0.0])
                sides.append(child)
                open_.append((*best(part, g, h), part, child, depth + 1))
            deepest = max(deepest, depth + 1)
            nodes[at][:4] = [j, float(cuts[j][b]), *sides]
        for rows, at in [(o[3], o[4]) for o in open_] + closed:
            step = -rate * g[rows].sum() / (h[rows].sum() + ridge)
            nodes[at][4] = float(step)
            margin[rows] += step
    table = np.array(nodes).reshape(-1, 5)
    feature, left, right = (table[:, i].astype(np.int32) for i in (0, 2, 3))
    return Forest(np.array(roots, np.int32), feature, table[:, 1], left, right, table[:, 4], deepest, base)
