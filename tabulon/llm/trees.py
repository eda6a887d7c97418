"""Small decision trees on bounded samples, and their vectorised scoring from flat node arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Forest:
    """Trees flattened into node arrays; row i of each array is tree i. A leaf is its own child."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int
    base: float = 0.0

    def score(self, x: np.ndarray) -> np.ndarray:
        """Sum of the leaf values over the trees for each row of ``x``."""
        node = np.zeros((len(x), len(self.feature)), np.int32)
        tree, row = np.arange(len(self.feature)), np.arange(len(x))[:, None]
        for _ in range(self.depth):
            low = x[row, self.feature[tree, node]] <= self.threshold[tree, node]
            node = np.where(low, self.left[tree, node], self.right[tree, node])
        return self.base + self.value[tree, node].sum(1)


def _best_split(x, edges, grad, hess, sign, bounds, ridge, least):
    """The gain, feature and threshold of the best split that keeps the features' directions."""
    total_g, total_h = grad.sum(), hess.sum()
    best = (1e-9, -1, 0.0)
    for j, cuts in enumerate(edges):
        if not len(cuts):
            continue
        bin_of = np.searchsorted(cuts, x[:, j], "left")
        g = np.bincount(bin_of, grad, len(cuts) + 1).cumsum()[:-1]
        h = np.bincount(bin_of, hess, len(cuts) + 1).cumsum()[:-1]
        n = np.bincount(bin_of, minlength=len(cuts) + 1).cumsum()[:-1]
        low = np.clip(-g / (h + ridge), *bounds)
        high = np.clip(-(total_g - g) / (total_h - h + ridge), *bounds)
        gain = g**2 / (h + ridge) + (total_g - g) ** 2 / (total_h - h + ridge) - total_g**2 / (total_h + ridge)
        fine = (n >= least) & (len(x) - n >= least) & (sign[j] * (high - low) >= 0)
        if fine.any():
            k = int(np.where(fine, gain, -1).argmax())
            if gain[k] > best[0]:
                best = (float(gain[k]), j, float(cuts[k]))
    return best


def grow(x, grad, hess, edges, sign, *, depth, ridge, least, rate):
    """One tree as node lists (feature, threshold, left, right, value) by Newton steps.

    ``sign`` is 1, -1 or 0 by feature: whether the value may only rise or only fall with it. A split on a signed feature
    bounds both sides by the middle of their values, so that the direction holds in the whole tree.
    """
    nodes: list[list] = []

    def add(rows, level, bounds):
        at = len(nodes)
        g, h = grad[rows], hess[rows]
        value = float(np.clip(-g.sum() / (h.sum() + ridge), *bounds))
        nodes.append([0, 0.0, at, at, rate * value])
        if level == depth:
            return at
        _, j, cut = _best_split(x[rows], edges, g, h, sign, bounds, ridge, least)
        if j < 0:
            return at
        low = x[rows, j] <= cut
        a, b = bounds, bounds
        if sign[j]:
            values = [float(np.clip(-g[m].sum() / (h[m].sum() + ridge), *bounds)) for m in (low, ~low)]
            middle = sum(values) / 2
            a, b = ((bounds[0], middle), (middle, bounds[1])) if sign[j] > 0 else ((middle, bounds[1]), (bounds[0], middle))
        nodes[at][:2] = j, cut
        nodes[at][2] = add(rows[low], level + 1, a)
        nodes[at][3] = add(rows[~low], level + 1, b)
        return at

    add(np.arange(len(x)), 0, (-np.inf, np.inf))
    return nodes


def boost(x: np.ndarray, y: np.ndarray, sign, *, trees: int, depth: int, rate: float, ridge: float = 1.0, least: int = 5, bins: int = 64, single: bool = False) -> Forest:
    """Gradient boosting of ``y`` in 0/1 on a bounded sample: log-odds by logistic loss.

    ``single`` grows one tree whose leaf values are centred shares instead.
    """
    edges = [u[:-1] + np.diff(u) / 2 if len(u := np.unique(x[:, j])) <= bins else np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    share = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
    base = share - 0.5 if single else float(np.log(share / (1 - share)))
    score, grown = np.full(len(y), base), []
    for _ in range(1 if single else trees):
        p = score + 0.5 if single else 1 / (1 + np.exp(-score))
        nodes = grow(x, p - y, np.ones(len(y)) if single else np.maximum(p * (1 - p), 1e-6), edges, sign, depth=depth, ridge=ridge, least=least, rate=1.0 if single else rate)
        grown.append(nodes)
        score = score + flatten([nodes], depth, 0.0).score(x)
    return flatten(grown, depth, base)


def flatten(trees: list[list], depth: int, base: float) -> Forest:
    """Node lists as rectangular arrays; short trees are filled up with unused nodes."""
    width = max(map(len, trees))
    full = [t + [[0, 0.0, i, i, 0.0] for i in range(len(t), width)] for t in trees]
    of = lambda k, kind: np.array([[n[k] for n in t] for t in full], kind)
    return Forest(of(0, np.int32), of(1, float), of(2, np.int32), of(3, np.int32), of(4, float), depth, base)
