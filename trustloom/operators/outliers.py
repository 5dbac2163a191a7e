"""Isolation forests: short paths mean outliers. Trees are grown from a bounded sample and score rows as columns."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trustloom.functions import expr as E
from trustloom.operators.staged import Split, tree_column


def average_path(n: int) -> float:
    """Mean depth of an unsuccessful search among ``n`` rows in a random binary tree."""
    if n <= 1:
        return 0.0
    return 1.0 if n == 2 else 2.0 * (math.log(n - 1) + 0.5772156649015329) - 2.0 * (n - 1) / n


@dataclass
class Isolation:
    """Trees whose leaves are path lengths, grown from ``sample`` rows each."""

    trees: list[Split | float]
    sample: int

    def score(self, x: Column) -> Column:
        """-2^(-mean path / expected path): from -1, an outlier, towards 0."""
        paths = E.let(x, lambda x: sum((tree_column(t, x) for t in self.trees), F.lit(0.0)))
        return -F.pow(F.lit(2.0), -paths / F.lit(len(self.trees) * max(average_path(self.sample), 1e-12)))


@dataclass
class IsolationForest:
    """Random cuts of random features. Learns from sample x trees rows at most, those with the least hashes of their ids."""

    trees: int = 32
    sample: int = 256
    seed: int = 0

    def fit(self, df: DataFrame) -> Isolation:
        order = F.xxhash64(F.lit(self.seed), "id")
        rows = df.select("x").orderBy(order, "id").limit(self.trees * self.sample).collect()
        X, rng = np.array([r["x"] for r in rows], float), np.random.default_rng(self.seed)
        size = min(self.sample, len(X))
        if not size:
            return Isolation([0.0], 1)
        depth = math.ceil(math.log2(max(2, size)))

        def grow(part: np.ndarray, at: int) -> Split | float:
            low, high = part.min(axis=0), part.max(axis=0)
            open_ = np.flatnonzero(high > low)
            if at == depth or len(part) <= 1 or not len(open_):
                return at + average_path(len(part))
            j = int(rng.choice(open_))
            cut = float(rng.uniform(low[j], high[j]))
            left = part[:, j] <= cut
            return Split(j, cut, grow(part[left], at + 1), grow(part[~left], at + 1))

        return Isolation([grow(X[rng.choice(len(X), size, replace=False)], 0) for _ in range(self.trees)], size)
