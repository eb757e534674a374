"""Boosted trees over binned features, for models of which there are many: one for each fold.

Features are cut into bins by quantiles of the training rows, one byte each; a tree's depth is
grown at once for all its nodes from sums of gradients by node and bin. A fold is one task,
and folds are trained side by side; what a task holds is its fold's rows at a byte a feature.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 64


@dataclass(frozen=True)
class Boosting:
    """Fixed values, as a fold's model is defined: the defaults."""

    trees: int = 300
    depth: int = 4
    rate: float = 0.05
    row_share: float = 0.8
    column_share: float = 0.8
    least_weight: float = 20.0
    ridge: float = 1.0
    seed: int = 7


def edges_of(x: np.ndarray, bins: int = BINS) -> list[np.ndarray]:
    """Cuts between the bins of each feature; a value equal to a cut lies above it."""
    return [np.unique(np.quantile(column, np.arange(1, bins) / bins)) for column in x.T]


def coded(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, column, side="right") for e, column in zip(edges, x.T)], 1).astype(np.uint8)


def best_splits(codes: np.ndarray, node: np.ndarray, width: int, g: np.ndarray, h: np.ndarray, columns: np.ndarray, how: Boosting) -> tuple[np.ndarray, np.ndarray]:
    """Feature and last left bin of the best split of each node of a depth; feature -1 where none gains."""
    feature, cut, best = np.full(width, -1), np.full(width, BINS), np.zeros(width)
    for f in columns:
        key = node * BINS + codes[:, f]
        left_g = np.bincount(key, g, width * BINS).reshape(width, BINS).cumsum(1)
        left_h = np.bincount(key, h, width * BINS).reshape(width, BINS).cumsum(1)
        all_g, all_h = left_g[:, -1:], left_h[:, -1:]
        right_g, right_h = all_g - left_g, all_h - left_h
        gain = left_g**2 / (left_h + how.ridge) + right_g**2 / (right_h + how.ridge) - all_g**2 / (all_h + how.ridge)
        gain[(left_h < how.least_weight) | (right_h < how.least_weight)] = 0
        at = gain.argmax(1)
        top = gain[np.arange(width), at]
        better = top > best + 1e-12
        feature[better], cut[better], best[better] = f, at[better], top[better]
    return feature, cut


def leaves(codes: np.ndarray, splits: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The leaf that each row comes to; a node that isn't split sends all to the left."""
    node = np.zeros(len(codes), np.int64)
    for feature, cut in splits:
        own = feature[node]
        value = codes[np.arange(len(codes)), np.maximum(own, 0)]
        node = 2 * node + ((own >= 0) & (value > cut[node]))
    return node


def scores(train: np.ndarray, y: np.ndarray, others: list[np.ndarray], how: Boosting = Boosting()) -> list[np.ndarray]:
    """Chances of a 1 for the rows of ``others``, by trees boosted on ``train`` for logistic loss; features as numbers."""
    edges, draw = edges_of(train), np.random.default_rng(how.seed)
    codes, rest = coded(train, edges), [coded(x, edges) for x in others]
    base = np.log(y.mean() / (1 - y.mean()))
    raw, told = np.full(len(y), base), [np.full(len(x), base) for x in others]
    for _ in range(how.trees):
        p = 1 / (1 + np.exp(-raw))
        some = np.flatnonzero(draw.random(len(y)) < how.row_share)
        columns = np.sort(draw.choice(train.shape[1], max(1, round(how.column_share * train.shape[1])), replace=False))
        own, g, h = codes[some], (p - y)[some], (p * (1 - p))[some]
        splits: list[tuple[np.ndarray, np.ndarray]] = []
        for depth in range(how.depth):
            splits.append(best_splits(own, leaves(own, splits), 1 << depth, g, h, columns, how))
        leaf, n = leaves(own, splits), 1 << how.depth
        value = -how.rate * np.bincount(leaf, g, n) / (np.bincount(leaf, h, n) + how.ridge)
        raw += value[leaves(codes, splits)]
        for x, out in zip(rest, told):
            out += value[leaves(x, splits)]
    return [1 / (1 + np.exp(-out)) for out in told]


def pooled(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression: distinct x in order and their values, neighbours that fall pooled."""
    at, kind, n = np.unique(x, return_inverse=True, return_counts=True)
    pools: list[list[float]] = []
    for mean, size in zip(np.bincount(kind, y) / n, n):
        pools.append([mean, size, 1])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            b, a = pools.pop(), pools.pop()
            pools.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2] + b[2]])
    return at, np.repeat([p[0] for p in pools], [int(p[2]) for p in pools])


def auc(score: np.ndarray, y: np.ndarray) -> float:
    """Area under the curve from average ranks."""
    _, kind, n = np.unique(score, return_inverse=True, return_counts=True)
    rank = (np.cumsum(n) - (n - 1) / 2)[kind]
    ones = y.sum()
    return float((rank[y == 1].sum() - ones * (ones + 1) / 2) / (ones * (len(y) - ones)))
