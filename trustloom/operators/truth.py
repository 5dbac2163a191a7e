"""Ground truth of two-dimensional data: p(y | x) from a logistic on a kernel map, p(x) from a histogram."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trustloom.operators.kernels import Map, nystroem
from trustloom.operators.linear import LinearModel
from trustloom.operators.paths import fit_logistic_newton
from trustloom.operators.staged import Scores, standardised
from trustloom.sources.store import stored


class Mapped(Scores):
    """A linear model behind a map of the features."""

    def __init__(self, map_: Map, model: LinearModel) -> None:
        self.map, self.model = map_, model

    def margin(self, x: Column) -> Column:
        return F.get(self.model.decision(self.map(x)), F.lit(0))


@dataclass
class KernelLogistic:
    """Two classes by a logistic on a kernel map of standardised features, fitted by Newton steps on summed blocks.

    ``kernel`` makes the map from a frame, by default Nystroem's with 100
    landmarks drawn by distance. The mapped rows are stored once; a step is an
    aggregation of as many numbers as the map has pairs of components.
    """

    kernel: Callable[[DataFrame], Map] | None = None
    regul: float = 1.0

    def fit(self, df: DataFrame) -> Mapped:
        rows = stored(df.filter("x is not null and y is not null").select("id", "x", "y"), "rows")
        if not rows.take(1):
            return Mapped(lambda x: x, LinearModel([[0.0, 0.0]], [0.0]))
        scaled = standardised(rows)
        kernel = (self.kernel or nystroem(100, 0.5))(rows.withColumn("x", scaled(F.col("x"))))
        whole = lambda x: kernel(scaled(x))
        model = fit_logistic_newton(rows.select(whole(F.col("x")).alias("x"), "y"), self.regul)
        return Mapped(whole, model)


def truth_grid(df: DataFrame, model: Scores, bins: tuple[int, int] = (120, 80), low: tuple[float, float] = (-1.75, -1.25), high: tuple[float, float] = (2.75, 1.75)) -> DataFrame:
    """i, j, p_x, p_y: of each cell with rows its share of them, and the model's probability of class 1 at its middle.

    ``df`` has the features x; rows outside the grid are left aside, and shares
    are of those inside. One aggregation to at most as many rows as cells.
    """
    cell = lambda k: F.floor((F.get("x", F.lit(k)) - F.lit(low[k])) * F.lit(bins[k] / (high[k] - low[k]))).cast("int")
    middle = lambda name, k: F.lit(low[k]) + (F.col(name) + 0.5) * F.lit((high[k] - low[k]) / bins[k])
    inside = F.col("i").between(0, bins[0] - 1) & F.col("j").between(0, bins[1] - 1)
    cells = df.select(cell(0).alias("i"), cell(1).alias("j")).filter(inside).groupBy("i", "j").agg(F.count("*").alias("n"))
    cells = stored(cells, "cells")
    total = cells.agg(F.sum("n")).first()[0] or 1
    p = F.get(model.probabilities(F.array(middle("i", 0), middle("j", 1))), F.lit(1))
    return cells.select("i", "j", (F.col("n") / F.lit(total)).alias("p_x"), p.alias("p_y"))
