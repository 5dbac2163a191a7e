"""Toy data: shapes generated by row number, so that any size is made in parallel."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PI = math.pi


def _spread(x1: Column, x2: Column, spread: float | None, seed: int) -> list[Column]:
    if spread is not None:
        x1, x2 = x1 + F.lit(spread) * F.randn(seed), x2 + F.lit(spread) * F.randn(seed + 1)
    return [x1.alias("x1"), x2.alias("x2")]


def blobs(spark: SparkSession, n: int = 100, k: int = 2, gap: float = 1.0, spread: float | None = None, seed: int = 0) -> DataFrame:
    """k points on a circle, from 45 degrees on."""
    y = (F.col("id") % k).cast("int")
    t = F.lit(PI / 4) + y * F.lit(2 * PI / k)
    return spark.range(n // k * k).select("id", *_spread(gap * F.cos(t), gap * F.sin(t), spread, seed), y.alias("y"))


def spirals(spark: SparkSession, n: int = 100, k: int = 2, rotations: float = 1.0, gap: float = 0.0, spread: float | None = None, seed: int = 0) -> DataFrame:
    m = n // k
    y = (F.col("id") % k).cast("int")
    t = F.floor(F.col("id") / k) * F.lit(2 * PI * rotations / max(1, m - 1)) + gap
    a = t + y * F.lit(2 * PI / k)
    return spark.range(m * k).select("id", *_spread(t * F.cos(a), t * F.sin(a), spread, seed), y.alias("y"))


def circles(spark: SparkSession, n: int = 100, k: int = 2, spread: float | None = None, seed: int = 0) -> DataFrame:
    """Circles of radius 0 to k - 1: the first is one point, repeated."""
    m = n // k
    y = (F.col("id") % k).cast("int")
    t = F.floor(F.col("id") / k) * F.lit(2 * PI / m)
    return spark.range(m * k).select("id", *_spread(y * F.cos(t), y * F.sin(t), spread, seed), y.alias("y"))


def xor_camembert(spark: SparkSession, n: int = 100, k: int = 2, gap: float = 1.0, spread: float | None = None, seed: int = 0) -> DataFrame:
    """2 k spokes; the label is the spoke's number modulo k."""
    m = n // (2 * k)
    spoke = F.col("id") % (2 * k)
    r = F.floor(F.col("id") / (2 * k)) / F.lit(float(m)) + gap
    a = spoke * F.lit((2 * PI - PI / k) / (2 * k - 1))
    return spark.range(m * 2 * k).select("id", *_spread(r * F.cos(a), -r * F.sin(a), spread, seed), (spoke % k).cast("int").alias("y"))


def moons(spark: SparkSession, n: int = 100, bias: str = "none", strength: float = 2.0, imbalance: float = 1.0, spread: float | None = None, seed: int = 0) -> DataFrame:
    """Two half circles; ``bias`` thins out parts of them, ``imbalance`` is the ratio of class 1 to class 0."""
    if bias not in ("none", "asymmetric", "symmetric_out", "symmetric_in"):
        raise ValueError("bias is none, asymmetric, symmetric_out or symmetric_in")
    outer = round(n / (1 + imbalance))
    inner = n - outer
    y = (F.col("id") >= outer).cast("int")
    u = F.when(y == 0, F.col("id") / F.lit(float(max(1, outer - 1)))).otherwise((F.col("id") - outer) / F.lit(float(max(1, inner - 1))))
    power = F.pow(u, F.lit(float(strength)))
    t = {"none": u, "symmetric_out": power, "symmetric_in": 1.0 - power, "asymmetric": F.when(y == 0, power).otherwise(1.0 - power)}[bias]
    x1 = F.when(y == 0, F.cos(PI * t)).otherwise(1.0 - F.cos(PI * t))
    x2 = F.when(y == 0, F.sin(PI * t)).otherwise(0.5 - F.sin(PI * t))
    return spark.range(n).select("id", *_spread(x1, x2, spread, seed), y.alias("y"))


def histogram_truth(df: DataFrame, bins: tuple[int, int] = (120, 80), low: tuple[float, float] = (-2.0, -1.5), high: tuple[float, float] = (3.0, 2.0)) -> DataFrame:
    """A two-dimensional histogram as ground truth: cell, p_x (share of rows) and p_y (share of class 1)."""
    cell = lambda c, k: F.greatest(F.lit(0), F.least(F.lit(bins[k] - 1), F.floor((F.col(c) - low[k]) * F.lit(bins[k] / (high[k] - low[k]))).cast("int")))
    rows = df.select(cell("x1", 0).alias("i"), cell("x2", 1).alias("j"), "y")
    cells = rows.groupBy("i", "j").agg(F.count("*").alias("n"), F.avg(F.col("y").cast("double")).alias("p_y"))
    total = df.agg(F.count("*").alias("total"))
    return cells.crossJoin(F.broadcast(total)).select("i", "j", (F.col("n") / F.col("total")).alias("p_x"), "p_y")
