"""Gradient-boosted trees small enough to become one SQL expression."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Leaf:
    value: float


@dataclass
class Split:
    feature: int
    at: float  # left where the feature is <= at
    left: object
    right: object


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, rate: float, least: float = 4.0):
    value = Leaf(float(rate * g.sum() / (h.sum() + 1.0)))
    if depth == 0 or len(x) < 8:
        return value
    best, gain = None, 1e-6
    base = g.sum() ** 2 / (h.sum() + 1.0)
    for f in range(x.shape[1]):
        for at in np.unique(x[:, f])[:-1]:
            left = x[:, f] <= at
            if min(left.sum(), (~left).sum()) < least:
                continue
            new = g[left].sum() ** 2 / (h[left].sum() + 1.0) + g[~left].sum() ** 2 / (h[~left].sum() + 1.0) - base
            if new > gain:
                best, gain = (f, float(at)), new
    if best is None:
        return value
    left = x[:, best[0]] <= best[1]
    return Split(*best, _grow(x[left], g[left], h[left], depth - 1, rate), _grow(x[~left], g[~left], h[~left], depth - 1, rate))


def _value(tree, row: np.ndarray) -> float:
    while isinstance(tree, Split):
        tree = tree.left if row[tree.feature] <= tree.at else tree.right
    return tree.value


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 12, depth: int = 3, rate: float = 0.4) -> list:
    """Trees whose values sum to the log-odds of ``y``."""
    trees, score = [], np.zeros(len(y))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        tree = _grow(x, y - p, p * (1 - p), depth, rate)
        trees.append(tree)
        score += np.array([_value(tree, r) for r in x])
    return trees


def predict(trees: list, x: np.ndarray) -> np.ndarray:
    return np.array([sum(_value(t, r) for t in trees) for r in x])


def to_sql(trees: list, names: list[str]) -> str:
    """The sum of the trees as a SQL expression over the named features."""

    def one(tree) -> str:
        if isinstance(tree, Leaf):
            return f"{tree.value:.9f}D"
        return f"IF({names[tree.feature]} <= {tree.at:g}, {one(tree.left)}, {one(tree.right)})"

    return " + ".join(map(one, trees))
