"""A small random forest: fitted on the driver from a bounded labelled sample, applied as one DataFrame expression."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass
class Node:
    """A leaf has share alone; an inner node sends values up to cut to low, others to high."""

    share: float
    feature: int = -1
    cut: float = 0.0
    low: Node | None = None
    high: Node | None = None


def _best_cut(x: np.ndarray, y: np.ndarray, features: np.ndarray) -> tuple[int, float] | None:
    """The (feature, cut) with the least Gini impurity after it, if any lowers it."""
    n, ones = len(y), y.sum()
    best, found = ones * (n - ones) / n - 1e-9, None
    for f in features:
        order = np.argsort(x[:, f], kind="stable")
        v, positive = x[order, f], np.cumsum(y[order])[:-1]
        left = np.arange(1, n)
        impurity = positive * (left - positive) / left + (ones - positive) * (n - left - ones + positive) / (n - left)
        impurity[v[1:] == v[:-1]] = np.inf
        if len(impurity) and impurity.min() < best:
            i = int(impurity.argmin())
            best, found = impurity[i], (int(f), float((v[i] + v[i + 1]) / 2))
    return found


def _grow(x: np.ndarray, y: np.ndarray, depth: int, tried: int, rng: np.random.Generator) -> Node:
    node = Node(float((y.sum() + 0.5) / (len(y) + 1)))
    if depth == 0 or len(y) < 8 or y.min() == y.max():
        return node
    cut = _best_cut(x, y, rng.permutation(x.shape[1])[:tried])
    if cut:
        node.feature, node.cut = cut
        below = x[:, node.feature] <= node.cut
        node.low, node.high = (_grow(x[side], y[side], depth - 1, tried, rng) for side in (below, ~below))
    return node


def fit(x: np.ndarray, y: np.ndarray, trees: int = 15, depth: int = 6, seed: int = 5) -> list[Node]:
    rng = np.random.default_rng(seed)
    tried = max(1, int(np.ceil(np.sqrt(x.shape[1])))) + 1
    grown = []
    for _ in range(trees):
        rows = rng.integers(0, len(y), len(y))
        grown.append(_grow(x[rows], y[rows], depth, tried, rng))
    return grown


def predict(forest: list[Node], x: np.ndarray) -> np.ndarray:
    def walk(node: Node, row: np.ndarray) -> float:
        while node.low is not None:
            node = node.low if row[node.feature] <= node.cut else node.high
        return node.share

    return np.array([np.mean([walk(t, r) for t in forest]) for r in x])


def as_column(forest: list[Node], feature: Callable[[int], Column]) -> Column:
    """The mean of all trees' leaves as nested CASE expressions over the feature columns."""

    def tree(node: Node) -> Column:
        if node.low is None:
            return F.lit(node.share)
        return F.when(feature(node.feature) <= F.lit(node.cut), tree(node.low)).otherwise(tree(node.high))

    total = tree(forest[0])
    for t in forest[1:]:
        total = total + tree(t)
    return total / F.lit(float(len(forest)))
