"""A small gradient-boosted tree fitter for bounded samples, and its scores as a Column."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

Tree = float | tuple[int, float, "Tree", "Tree"]


@dataclass(frozen=True)
class Model:
    """Log-odds ``base`` plus the trees; a node is (feature, threshold, left if value <= threshold, right)."""

    base: float
    trees: tuple[Tree, ...]

    def column(self, feature: Callable[[int], Column]) -> Column:
        """The score as one expression over the features' columns."""

        def walk(tree: Tree) -> Column:
            if isinstance(tree, float):
                return F.lit(tree)
            at, cut, low, high = tree
            return F.when(feature(at) <= cut, walk(low)).otherwise(walk(high))

        total = F.lit(self.base)
        for tree in self.trees:
            total = total + walk(tree)
        return total

    def scores(self, x: np.ndarray) -> np.ndarray:
        def walk(tree: Tree, rows: np.ndarray) -> np.ndarray:
            if isinstance(tree, float):
                return np.full(len(rows), tree)
            at, cut, low, high = tree
            return np.where(rows[:, at] <= cut, walk(low, rows), walk(high, rows))

        return self.base + sum((walk(t, x) for t in self.trees), np.zeros(len(x)))


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 24, depth: int = 2, rate: float = 0.4, cuts: int = 24) -> Model:
    """Newton boosting of the logistic loss. Deterministic; one class or no rows gives a constant."""
    if not len(y) or y.min() == y.max():
        return Model(8.0 if len(y) and y[0] else -8.0, ())
    base = float(np.log(y.mean() / (1 - y.mean())))
    grids = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, cuts + 2)[1:-1], method="lower")) for j in range(x.shape[1])]
    score, trees = np.full(len(y), base), []

    def gain(g: np.ndarray, h: np.ndarray) -> float:
        return float(g.sum() ** 2 / (h.sum() + 1.0))

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, left: int) -> Tree:
        best = (1e-6, None)
        for j, grid in enumerate(grids if left else []):
            for cut in grid:
                low = x[rows, j] <= cut
                if 0 < low.sum() < len(rows):
                    a, b = rows[low], rows[~low]
                    won = gain(g[a], h[a]) + gain(g[b], h[b]) - gain(g[rows], h[rows])
                    if won > best[0]:
                        best = (won, (j, float(cut), a, b))
        if best[1] is None:
            return float(rate * g[rows].sum() / (h[rows].sum() + 1.0))
        j, cut, a, b = best[1]
        return (j, cut, grow(a, g, h, left - 1), grow(b, g, h, left - 1))

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        tree = grow(np.arange(len(y)), y - p, p * (1 - p), depth)
        trees.append(tree)
        score = score + Model(0.0, (tree,)).scores(x)
    return Model(base, tuple(trees))


def calibrate(score: np.ndarray, y: np.ndarray, precision: float) -> float:
    """The lowest score from which upward the held-out share of positives is at least ``precision``."""
    order = np.argsort(-score, kind="stable")
    ranked, hits = score[order], np.cumsum(y[order])
    last = np.r_[ranked[1:] != ranked[:-1], True] if len(ranked) else np.zeros(0, bool)
    good = last & (hits >= precision * np.arange(1, len(ranked) + 1))
    return float(ranked[np.flatnonzero(good)[-1]]) if good.any() else float("inf")


def as_matrix(rows: Sequence[Sequence[float]], width: int) -> np.ndarray:
    return np.array(rows, dtype=float).reshape(len(rows), width)
