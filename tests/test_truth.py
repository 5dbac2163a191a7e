"""The kernel logistic against a dense fit on the exact kernel, and its grid."""

import numpy as np
from pyspark.sql import functions as F

from trustloom.operators.kernels import nystroem
from trustloom.operators.truth import KernelLogistic, truth_grid
from trustloom.sources import toy


def _moons(spark):
    rows = toy.moons(spark, 300, spread=0.3, seed=4)
    return rows.select("id", F.array("x1", "x2").alias("x"), "y")


def test_probabilities_near_the_exact_kernel(spark):
    df = _moons(spark).cache()
    data = df.orderBy("id").collect()
    X, y = np.array([r.x for r in data]), np.array([r.y for r in data], float)
    model = KernelLogistic(nystroem(80, 0.5)).fit(df)
    got = np.array([r.p for r in df.select("id", model.probabilities(F.col("x"))[1].alias("p")).orderBy("id").collect()])
    # Dense: f = K a + b, penalty a' K a / 2, by Newton on (K^1/2 a, b).
    Z = (X - X.mean(axis=0)) / X.std(axis=0)
    K = np.exp(-0.5 * ((Z[:, None] - Z[None]) ** 2).sum(axis=2))
    v, U = np.linalg.eigh(K)
    A = np.hstack([U * np.sqrt(np.maximum(v, 0)), np.ones((300, 1))])
    w, R = np.zeros(301), np.diag(np.append(np.ones(300), 0.0))
    for _ in range(50):
        p = 1 / (1 + np.exp(-A @ w))
        w = w - np.linalg.solve(A.T @ (A * (p * (1 - p))[:, None]) + R, A.T @ (p - y) + R @ w)
    exact = 1 / (1 + np.exp(-A @ w))
    assert np.abs(got - exact).max() < 0.01
    assert ((got > 0.5) == (exact > 0.5)).mean() > 0.98


def test_grid(spark):
    df = _moons(spark).cache()
    model = KernelLogistic(nystroem(10, 0.5)).fit(df)
    rows = truth_grid(df, model, (12, 8)).collect()
    X = np.array([r.x for r in df.collect()])
    want, _, _ = np.histogram2d(X[:, 0], X[:, 1], bins=(np.linspace(-1.75, 2.75, 13), np.linspace(-1.25, 1.75, 9)))
    got = np.zeros((12, 8))
    for r in rows:
        got[r.i, r.j] = r.p_x
        assert 0 <= r.p_y <= 1
    assert np.allclose(got, want / want.sum())
    # The upper moon is class 0, the lower one class 1.
    at = {(r.i, r.j): r.p_y for r in rows}
    assert at[4, 5] < 0.3 and at[7, 2] > 0.7, at


def test_no_rows(spark):
    df = _moons(spark).limit(0)
    model = KernelLogistic().fit(df)
    assert truth_grid(df, model).count() == 0
