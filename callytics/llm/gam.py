"""A generalised additive model with pairwise interactions, boosted by shallow trees and applied by table look-ups.

Each feature is cut into bins. In turn, round after round, a tree of at most four leaves is fitted to what the model still
misses, on one feature alone, and a small part of it is added to that feature's table: so features share what they
explain evenly, whatever their order. Then the pairs of features with the most left to explain get tables of two
dimensions in the same way. The score of a row is the sum of the table entries of its bins, through a logistic function.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 48
PAIR_BINS = 12
PAIRS = 8
ROUNDS = 60
PAIR_ROUNDS = 30
RATE = 0.15
#: Added to the weight of each leaf.
DAMP = 1.0
#: Least weight (sum of p (1 - p)) of a leaf.
LEAST = 0.5
#: Least gain of a cut.
GAIN = 1e-3


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def cuts_of(values: np.ndarray, bins: int) -> np.ndarray:
    """Places between bins: quantiles between different values, at most bins - 1."""
    found = np.unique(values)
    if len(found) <= bins:
        return (found[1:] + found[:-1]) / 2
    return np.unique(np.quantile(values, np.arange(1, bins) / bins))


def gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + DAMP)


def best_cut(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """Of the cuts of a row of bins the best: (gain, bins before it); gain 0 if none."""
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    if not len(left_g):
        return 0.0, 0
    right_g, right_h = g.sum() - left_g, h.sum() - left_h
    better = gain(left_g, left_h) + gain(right_g, right_h) - gain(g.sum(), h.sum())
    better[(left_h < LEAST) | (right_h < LEAST)] = 0
    at = int(better.argmax())
    return float(better[at]), at + 1


def tree(g: np.ndarray, h: np.ndarray, depth: int = 2) -> np.ndarray:
    """Values of a tree over bins along one axis (g of one dimension) or two."""
    if depth:
        found = [(*best_cut(*(x.sum(axis=tuple(a for a in range(g.ndim) if a != axis)) for x in (g, h))), axis) for axis in range(g.ndim)]
        better, at, axis = max(found, key=lambda f: f[0])
        if better > GAIN:
            parts = [tree(a, b, depth - 1) for a, b in zip(np.split(g, [at], axis), np.split(h, [at], axis))]
            return np.concatenate(parts, axis)
    return np.full(g.shape, g.sum() / (h.sum() + DAMP))


@dataclass
class Model:
    offset: float
    cuts: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_cuts: list[np.ndarray]
    pair_tables: list[np.ndarray]

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of the label 1 of rows of features."""
        total = np.full(len(x), self.offset)
        for values, cuts, table in zip(x.T, self.cuts, self.tables):
            total += table[np.searchsorted(cuts, values, "right")]
        coarse = {j: np.searchsorted(self.pair_cuts[j], x[:, j], "right") for pair in self.pairs for j in pair}
        for (j, k), table in zip(self.pairs, self.pair_tables):
            total += table[coarse[j], coarse[k]]
        return logistic(total)


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Model:
    """Learn from rows of features, labels 0 and 1 and weights. Without rows the score is 1/2."""
    n, features = x.shape
    ones, all_ = float(weight[y == 1].sum()), float(weight.sum())
    cuts = [cuts_of(v, BINS) for v in x.T]
    pair_cuts = [cuts_of(v, PAIR_BINS) for v in x.T]
    offset = float(np.log((ones + 1) / (all_ - ones + 1)))
    model = Model(offset, cuts, [np.zeros(len(c) + 1) for c in cuts], [], pair_cuts, [])
    if not n:
        return model
    bins = [np.searchsorted(c, v, "right") for c, v in zip(cuts, x.T)]
    total = np.full(n, offset)

    def left() -> tuple[np.ndarray, np.ndarray]:
        p = logistic(total)
        return weight * (y - p), weight * p * (1 - p)

    def step(table: np.ndarray, cell: np.ndarray) -> None:
        g, h = (np.bincount(cell, v, table.size).reshape(table.shape) for v in left())
        add = RATE * tree(g, h)
        table += add
        total[:] += add.ravel()[cell]

    for _ in range(ROUNDS):
        for table, cell in zip(model.tables, bins):
            step(table, cell)
    coarse = [np.searchsorted(c, v, "right") for c, v in zip(pair_cuts, x.T)]
    g, h = left()
    found = []
    for j in range(features):
        for k in range(j):
            shape = (len(pair_cuts[j]) + 1, len(pair_cuts[k]) + 1)
            cell = coarse[j] * shape[1] + coarse[k]
            both = [np.bincount(cell, v, shape[0] * shape[1]).reshape(shape) for v in (g, h)]
            fitted = tree(*both)
            found.append((float((fitted * both[0]).sum()), j, k))
    for _, j, k in sorted(found, reverse=True)[:PAIRS]:
        model.pairs.append((j, k))
        model.pair_tables.append(np.zeros((len(pair_cuts[j]) + 1, len(pair_cuts[k]) + 1)))
    for _ in range(PAIR_ROUNDS):
        for (j, k), table in zip(model.pairs, model.pair_tables):
            step(table, coarse[j] * table.shape[1] + coarse[k])
    return model
