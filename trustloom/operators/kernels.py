"""Kernel maps and a one-class machine on them (§2.14: random Fourier, Nystroem, one-class SVM).

A map is a transformer as pipelines take them: fitted on a frame, it gives a
function of the feature column. What it needs, frequencies or landmarks, is of a
size that the caller sets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trustloom.functions import expr as E
from trustloom.operators.decide import quantiles
from trustloom.operators.trees import matrix
from trustloom.sources.store import stored

Map = Callable[[Column], Column]


def _width(df: DataFrame) -> int:
    row = df.select(F.size("x").alias("d")).first()
    return row["d"] if row else 0


# Random Fourier features ---------------------------------------------------------------------------------


def fourier_map(frequencies: list[list[float]], phases: list[float]) -> Map:
    """sqrt(2 / D) cos(W x + b): inner products approximate the kernel whose spectrum the frequencies are drawn from."""
    scale = float(np.sqrt(2 / len(phases)))
    return lambda x: F.transform(E.linear(x, E.matrix(frequencies), E.doubles(phases)), lambda z: F.lit(scale) * F.cos(z))


def random_fourier(features: int = 100, gamma: float = 1.0, seed: int = 7) -> Callable[[DataFrame], Map]:
    """A transformer for the Gaussian kernel exp(-gamma |x - y|^2)."""

    def fit(df: DataFrame) -> Map:
        rng = np.random.default_rng(seed)
        W = rng.standard_normal((features, _width(df))) * np.sqrt(2 * gamma)
        return fourier_map(W.tolist(), rng.uniform(0, 2 * np.pi, features).tolist())

    return fit


# Nystroem --------------------------------------------------------------------------------------------------


def nystroem_map(landmarks: np.ndarray, gamma: float, floor: float = 1e-12) -> Map:
    """K(x, landmarks) times the inverse root of the landmarks' own kernel."""
    L = np.asarray(landmarks, float)
    K = np.exp(-gamma * ((L[:, None] - L[None]) ** 2).sum(axis=2))
    w, U = np.linalg.eigh(K)
    root = (U * np.where(w > floor, 1 / np.sqrt(np.maximum(w, floor)), 0.0)) @ U.T

    def of(x: Column) -> Column:
        near = E.let(x, lambda x: F.transform(E.matrix(L.tolist()), lambda p: F.exp(F.lit(-gamma) * E.norm2(F.zip_with(x, p, lambda a, b: a - b)))))
        return E.let(near, lambda k: F.transform(E.matrix(root.tolist()), lambda r: E.dot(k, r)))

    return of


def landmarks(df: DataFrame, k: int, rounds: int = 4, seed: int = 7) -> np.ndarray:
    """k rows spread over the data, by k-means++ on a sample that is itself drawn by distance (k-means||).

    A round draws about 2 k rows, each by its share of the squared distances to
    what is drawn already, from a hash of its id; so few rows reach the driver,
    and it is the same ones however the rows are dealt. Each drawn row is
    weighed by the rows it is nearest to before k are chosen.
    """
    rows = stored(df.filter("x is not null").select("id", "x"), "rows")
    first = rows.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(1).select("x").collect()
    if not first:
        return np.zeros((0, 0))
    drawn = np.array([first[0]["x"]], float)
    for n in range(rounds):
        near = _nearest(rows, drawn)
        whole = near.agg(F.sum("d")).first()[0]
        if not whole:
            break
        u = F.pmod(F.xxhash64(F.lit(seed + n + 1), "id"), F.lit(1 << 53)) / F.lit(float(1 << 53))
        new = near.filter(u < F.lit(2.0 * k) * F.col("d") / F.lit(whole)).select("x").distinct().orderBy("x").collect()  # about 2 k rows
        if new:
            drawn = np.concatenate([drawn, np.array([r["x"] for r in new], float)])
    weight = np.zeros(len(drawn))
    for r in _nearest(rows, drawn).groupBy("at").agg(F.count("*").alias("n")).collect():  # a row a drawn one
        weight[r["at"]] = r["n"]
    rng, chosen = np.random.default_rng(seed), [int(weight.argmax())]
    while len(chosen) < min(k, len(drawn)):
        d = ((drawn[:, None] - drawn[chosen][None]) ** 2).sum(axis=2).min(axis=1) * weight
        if not d.sum():
            break
        chosen.append(int(rng.choice(len(drawn), p=d / d.sum())))
    return drawn[chosen]


def _nearest(rows: DataFrame, to: np.ndarray) -> DataFrame:
    """id, x, at, d: the nearest of ``to`` and its squared distance."""
    shared = rows.sparkSession.sparkContext.broadcast(to)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                X, C = matrix(b.column(1)), shared.value
                D = (X**2).sum(axis=1)[:, None] - 2 * X @ C.T + (C**2).sum(axis=1)
                at = D.argmin(axis=1)
                d = ((X - C[at]) ** 2).sum(axis=1)
                yield pa.record_batch([*b.columns, pa.array(at, pa.int32()), pa.array(d)], ["id", "x", "at", "d"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, x array<double>, at int, d double")


def nystroem(components: int = 50, gamma: float = 1.0, seed: int = 7) -> Callable[[DataFrame], Map]:
    """A transformer for the Gaussian kernel from landmarks of the data."""
    return lambda df: nystroem_map(landmarks(df, components, seed=seed), gamma)


# One-class machine -----------------------------------------------------------------------------------------


@dataclass
class OneClass:
    """A fitted machine: ``score`` is positive inside, and negative for about the share nu of the rows it was fitted on."""

    features: Map
    weights: list[float]
    offset: float

    def score(self, x: Column) -> Column:
        return E.dot(self.features(x), E.doubles(self.weights)) - F.lit(self.offset)


@dataclass
class OneClassSvm:
    """Min 1/2 |w|^2 - rho + mean(max(0, rho - w f(x))) / nu, by conditional gradients.

    The dual is the shortest mean of rows in which none weighs over 1 / (nu n).
    A step moves w towards the mean of the share nu of rows that score least:
    two aggregations over stored features. The offset is the exact quantile nu
    of the scores, so that nu is the share outside.
    """

    nu: float = 0.1
    features: Callable[[DataFrame], Map] | None = None  #: by default 100 random Fourier features
    steps: int = 30

    def fit(self, df: DataFrame) -> OneClass:
        of = (self.features or random_fourier())(df)
        rows = stored(E.held(df.filter("x is not null").select("x"), z=of(F.col("x"))).select("z"), "features")
        d = rows.select(F.size("z").alias("d")).first()
        if d is None:
            return OneClass(of, [], 0.0)
        w = np.array(rows.agg(*[F.avg(F.get("z", F.lit(j))) for j in range(d["d"])]).first(), float)
        for t in range(self.steps):
            scored = E.held(rows, s=E.dot(F.col("z"), E.doubles(w)))
            cut = scored.agg(F.percentile_approx("s", self.nu, 10_000)).first()[0]
            tail = np.array(scored.filter(F.col("s") <= F.lit(cut)).agg(*[F.avg(F.get("z", F.lit(j))) for j in range(len(w))]).first(), float)
            w = w + 2.0 / (t + 3.0) * (tail - w)
        return OneClass(of, w.tolist(), quantiles(E.held(rows, s=E.dot(F.col("z"), E.doubles(w))), "s", self.nu)[None])
