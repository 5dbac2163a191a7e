"""Kendall's tau-b of two columns, without a table of pairs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trustloom.sources.store import ranged


def inversions(rank: np.ndarray, weight: np.ndarray) -> int:
    """Of a sequence: the weight of pairs whose ranks fall, by merging halves. Exact in Python's integers."""
    n = len(rank)
    if n < 2:
        return 0
    half = n // 2
    left, right = np.argsort(rank[:half]), half + np.argsort(rank[half:])
    below = np.concatenate([[0], np.cumsum(weight[right].astype(object))])
    across = sum((weight[left].astype(object) * below[np.searchsorted(rank[right], rank[left])]).tolist())
    return inversions(rank[:half], weight[:half]) + inversions(rank[half:], weight[half:]) + int(across)


def _fallen(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> int:
    """Inversions of points between the orders (x, y) and (y, x): neither ties in x nor in y are any."""
    order = np.lexsort((y, x))
    rank = np.empty(len(x), np.int64)
    rank[np.lexsort((x, y))] = np.arange(len(x))
    return inversions(rank[order], n[order])


def kendall(df: DataFrame, a: str, b: str) -> DataFrame:
    """tau: (concordant - discordant) / sqrt((pairs - ties in a) (pairs - ties in b)), null where a column is constant.

    Points are counted, then dealt into ranges of (a, b) and of (b, a). A
    discordant pair stands in one range of the first kind, or in one of the
    second, or in none of both, when the counts of the grid of ranges tell.
    Ranges hold about equal numbers of points, also where one value is on a
    third of the rows. Rows with a null aren't looked at.
    """
    points = df.select(F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y")).dropna().groupBy("x", "y").agg(F.count("*").alias("n"))
    points = ranged(ranged(points, "x", "y", name="a"), "y", "x", name="b")

    def count(by: str):
        def run(rows: pa.Table) -> pa.Table:
            x, y, n = (rows.column(c).to_numpy() for c in ("x", "y", "n"))
            out = _fallen(x, y, n)
            if by == "a":  # pairs that share both ranges would count twice
                other = rows.column("b").to_numpy()
                out -= sum(_fallen(x[other == k], y[other == k], n[other == k]) for k in np.unique(other))
            return pa.table([pa.array([str(out)])], names=["d"])

        return points.groupBy(by).applyInArrow(run, "d string")

    inside = sum(int(r["d"]) for by in ("a", "b") for r in count(by).collect())  # a row a range
    grid = points.groupBy("a", "b").agg(F.sum("n").alias("n")).collect()  # ranges times ranges
    rows, columns = ({v: k for k, v in enumerate(sorted({r[c] for r in grid}))} for c in ("a", "b"))
    N = np.zeros((len(rows) + 1, len(columns) + 1), object)
    for r in grid:
        N[rows[r["a"]], columns[r["b"]]] = r["n"]
    # Of a cell: all points in later ranges of the first kind and earlier ones of the second.
    later = N[::-1].cumsum(axis=0)[::-1]
    before = later.cumsum(axis=1)
    across = sum(int(N[i, j]) * int(before[i + 1, j - 1]) for i in range(len(rows)) for j in range(1, len(columns)))
    pairs = lambda n: n * (n - 1) // 2
    tied = lambda *by: int(points.groupBy(*by).agg(F.sum("n").alias("n")).agg(F.sum(F.col("n").cast("decimal(38,0)") * (F.col("n") - 1) / 2)).first()[0] or 0)
    whole = pairs(int(N.sum()))
    ties_a, ties_b, both = tied("x"), tied("y"), tied("x", "y")
    discordant = inside + across
    concordant = whole - ties_a - ties_b + both - discordant
    scale = float(whole - ties_a) ** 0.5 * float(whole - ties_b) ** 0.5
    return df.sparkSession.createDataFrame([((concordant - discordant) / scale if scale else None,)], "tau double")
