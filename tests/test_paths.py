"""Chosen penalties against refits of every fold and penalty."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trustloom.operators import linear as L
from trustloom.operators import paths


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(2)
    X = rng.normal(size=(200, 4))
    z = X @ [1.0, -2.0, 0.0, 0.5] + 0.7
    y, c = z + rng.normal(size=200), (z + rng.logistic(size=200) > 0).astype(int)
    df = spark.createDataFrame([(i, [float(v) for v in X[i]], float(y[i]), int(c[i]), i % 4) for i in range(200)], "id long, x array<double>, t double, c int, fold int").repartition(3).cache()
    return X, y, c, df


def ridge(X, y, a):
    A = np.hstack([X, np.ones((len(X), 1))])
    return np.linalg.solve(A.T @ A + a * np.diag([1.0] * X.shape[1] + [0.0]), A.T @ y)


def test_ridge_paths_equal_refits(data):
    X, y, _, df = data
    df, alphas, fold = df.withColumn("y", F.col("t")), [0.01, 1.0, 30.0, 1000.0], np.arange(200) % 4
    out = lambda w, x: x[:, :4] @ w[:4] + w[4]
    want = {a: sum(((y[fold == f] - out(ridge(X[fold != f], y[fold != f], a), X[fold == f])) ** 2).sum() for f in range(4)) / 200 for a in alphas}
    model, errors = paths.ridge_by_folds(df, alphas, 4, deal=lambda d: d)
    assert errors == pytest.approx(want) and model.regul == min(want, key=want.get)
    assert np.allclose([*model.coef[0], model.intercept[0]], ridge(X, y, model.regul))
    keep = lambda i: np.arange(200) != i
    want = {a: np.mean([(y[i] - out(ridge(X[keep(i)], y[keep(i)], a), X[i : i + 1])[0]) ** 2 for i in range(200)]) for a in alphas}
    model, errors = paths.ridge_by_leave_one_out(df, alphas)
    assert errors == pytest.approx(want) and model.regul == min(want, key=want.get)


def newton(X, y, r):
    A, w = np.hstack([X, np.ones((len(X), 1))]), np.zeros(X.shape[1] + 1)
    R = r * np.diag([1.0] * X.shape[1] + [0.0])
    for _ in range(60):
        p = 1 / (1 + np.exp(-A @ w))
        w = w - np.linalg.solve(A.T @ (A * (p * (1 - p))[:, None]) + R, A.T @ (p - y) + R @ w)
    return w


def test_logistic_path_equals_refits(data):
    X, _, c, df = data
    df, reguls, fold = df.withColumn("y", F.col("c")), [0.1, 3.0, 100.0], np.arange(200) % 4

    def loss(w, x, y):
        z = x @ w[:4] + w[4]
        return np.logaddexp(0, np.where(y > 0, -z, z)).sum()

    want = {r: sum(loss(newton(X[fold != f], c[fold != f], r), X[fold == f], c[fold == f]) for f in range(4)) / 200 for r in reguls}
    model, losses = paths.logistic_by_folds(df, reguls, 4, deal=lambda d: d)
    assert losses == pytest.approx(want) and model.regul == min(want, key=want.get)
    assert np.allclose([*model.coef[0], model.intercept[0]], newton(X, c, model.regul), atol=1e-6)
    one = paths.fit_logistic_newton(df, 2.0)
    assert np.allclose([*one.coef[0], one.intercept[0]], newton(X, c, 2.0), atol=1e-6)
    # At the optimum the gradient vanishes: influence probes may rely on it.
    g = df.select(L.LinearModel(one.coef, one.intercept).grad_y(F.col("x"), F.col("y"))[0].alias("g")).agg(F.sum("g")).first()[0]
    assert abs(g) < 1e-6


def test_no_rows(data):
    df = data[3].limit(0)
    assert paths.ridge_by_folds(df.withColumn("y", F.col("t")), [1.0], 4, deal=lambda d: d)[1] == {1.0: 0.0}
    assert paths.logistic_by_folds(df.withColumn("y", F.col("c")), [1.0], 4, deal=lambda d: d)[1] == {1.0: 0.0}


def test_mixture_over_two_scores(spark):
    """Neither column alone tells the two groups apart: they lie along two parallel lines."""
    from trustloom.operators.decide import MixtureSplitter

    rng = np.random.default_rng(5)
    t = rng.normal(size=400)
    group = np.arange(400) % 2
    a, b = t + 1.2 * group, -t + 1.2 * group + rng.normal(size=400) * 0.1
    df = spark.createDataFrame([(i, float(a[i]), float(b[i])) for i in range(400)] + [(400, None, 1.0)], "id long, a double, b double")
    got = {r.id: r.trusted for r in MixtureSplitter(40).split(df, "a", "b").collect()}
    assert np.mean([got[i] == bool(group[i]) for i in range(400)]) > 0.97 and got[400] is False
    assert MixtureSplitter().split(df.limit(0), "a", "b").count() == 0
    # One column: as the mixture of one score, but for the floor's place.
    one = {r.id: r.trusted for r in MixtureSplitter(5).split(df.filter("id < 400"), "a").collect()}
    assert len(one) == 400 and set(one.values()) == {True, False}
