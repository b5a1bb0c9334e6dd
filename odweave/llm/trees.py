"""Small binned decision trees in numpy: gradient boosting and random forests over a few thousand rows."""

from __future__ import annotations

import numpy as np

BINS = 32


def edges_of(x: np.ndarray) -> list[np.ndarray]:
    return [np.unique(np.quantile(column, np.linspace(0, 1, BINS + 1)[1:-1])) for column in x.T]


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.column_stack([np.searchsorted(e, column, side="left") for e, column in zip(edges, x.T, strict=True)]).astype(np.int64)


def grow(x: np.ndarray, target: np.ndarray, weight: np.ndarray, depth: int, rng=None, tried: int | None = None, least: float = 3.0, ridge: float = 1.0) -> list[tuple]:
    """A tree as rows ``(feature, last bin to the left, left, right, value)``; feature -1 is a leaf.

    A leaf's value is sum(target) / (sum(weight) + ridge). With ``tried`` each split sees so many random features.
    """
    nodes: list[tuple] = []

    def split(rows: np.ndarray, left_depth: int) -> int:
        me = len(nodes)
        t, w = target[rows].sum(), weight[rows].sum()
        nodes.append((-1, 0, 0, 0, t / (w + ridge)))
        if not left_depth or w < 2 * least:
            return me
        best = (1e-9, -1, 0)
        features = range(x.shape[1]) if tried is None else rng.choice(x.shape[1], tried, replace=False)
        for f in features:
            own = x[rows, f]
            lt, lw = np.cumsum(np.bincount(own, target[rows])), np.cumsum(np.bincount(own, weight[rows]))
            gain = lt**2 / (lw + ridge) + (t - lt) ** 2 / (w - lw + ridge) - t**2 / (w + ridge)
            gain[(lw < least) | (w - lw < least)] = 0
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (gain[k], int(f), k)
        if best[1] < 0:
            return me
        low = x[rows, best[1]] <= best[2]
        left, right = split(rows[low], left_depth - 1), split(rows[~low], left_depth - 1)
        nodes[me] = (best[1], best[2], left, right, nodes[me][4])
        return me

    split(np.arange(len(x)), depth)
    return nodes


def values(tree: list[tuple], x: np.ndarray) -> np.ndarray:
    feature, cut, left, right = (np.array([n[k] for n in tree]) for k in range(4))
    value = np.array([n[4] for n in tree])
    at = np.zeros(len(x), np.int64)
    while (inner := feature[at] >= 0).any():
        rows = np.flatnonzero(inner)
        here = at[rows]
        at[rows] = np.where(x[rows, feature[here]] <= cut[here], left[here], right[here])
    return value[at]


class Boosted:
    """Gradient boosted trees on the logistic loss."""

    def __init__(self, x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 3, rate: float = 0.2):
        self.edges = edges_of(x)
        b = binned(x, self.edges)
        share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.bias, self.trees = float(np.log(share / (1 - share))), []
        f = np.full(len(y), self.bias)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-f))
            tree = grow(b, y - p, p * (1 - p), depth, least=1.0)
            tree = [(*n[:4], rate * n[4]) for n in tree]
            self.trees.append(tree)
            f += values(tree, b)

    def margin(self, x: np.ndarray) -> np.ndarray:
        b = binned(x, self.edges)
        return self.bias + sum((values(t, b) for t in self.trees), np.zeros(len(x)))


class Forest:
    """A random forest: bootstrap samples, random features at each split, mean of the leaves' shares."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 8, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.edges = edges_of(x)
        b = binned(x, self.edges)
        tried = max(1, int(np.sqrt(x.shape[1])) + 1)
        self.trees = []
        for _ in range(trees):
            weight = rng.poisson(1.0, len(y)).astype(float)
            self.trees.append(grow(b, weight * y, weight, depth, rng, tried, least=2.0, ridge=1e-6))

    def score(self, x: np.ndarray) -> np.ndarray:
        b = binned(x, self.edges)
        return sum((values(t, b) for t in self.trees), np.zeros(len(x))) / len(self.trees)
