"""Leave-one-out states against a refit for each row."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trustloom.functions import probes as P
from trustloom.operators import left_out as O
from tests.test_paths import newton, ridge


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(9)
    X = rng.normal(size=(200, 3)) + 5
    z = (X - 5) @ [1.0, -2.0, 0.5]
    y, c = z + rng.normal(size=200), (z + rng.logistic(size=200) > 0).astype(int)
    rows = [(i, [float(v) for v in X[i]], float(y[i]), int(c[i])) for i in range(200)]
    return X, y, c, spark.createDataFrame(rows, "id long, x array<double>, t double, c int").repartition(3).cache()


@pytest.mark.parametrize("rows", [7, 64, 1000])
def test_ridge_equals_refits(data, rows):
    X, y, _, df = data
    got = {r.id: r.z[0] for r in O.left_out_scores(df.withColumn("y", F.col("t")), O.LeftOutRidge(2.0), rows).collect()}
    for i in range(200):
        w = ridge(np.delete(X, i, 0), np.delete(y, i), 2.0)
        assert got[i] == pytest.approx(X[i] @ w[:3] + w[3], abs=1e-8)


def test_logistic_equals_refits(data):
    X, _, c, df = data
    ensemble = O.LeftOutEnsemble(O.LeftOutLogistic(1.0), 50)
    got = {r.id: r.score[0] for r in ensemble.probe(df.withColumn("y", F.col("c")), P.confidence("logits")).collect()}
    worst = 0.0
    for i in range(200):
        w = newton(np.delete(X, i, 0), np.delete(c, i), 1.0)
        z = X[i] @ w[:3] + w[3]
        worst = max(worst, abs(got[i] - (z if c[i] else -z)))
    assert worst < 2e-3, worst


def test_gaussian_equals_refits(data):
    X, _, c, df = data
    learner = O.LeftOutGaussian(3)
    got = {r.id: r.z for r in O.left_out_scores(df.withColumn("y", F.col("c")), learner, 9).collect()}
    for i in range(200):
        want = learner.scores(learner.learn(np.delete(X, i, 0), np.delete(c, i)), X[i : i + 1])[0]
        assert np.allclose(got[i], want)


def test_states_that_have_no_inverse(data):
    """The largest value of any other row: what no subtraction gives."""

    class Largest(O.Learner):
        def learn(self, X, y):
            return (X.max(axis=0),)

        def merge(self, a, b):
            return (np.maximum(a[0], b[0]),)

        def scores(self, state, X):
            return np.repeat(state[0][None], len(X), axis=0)

    X, _, _, df = data
    got = {r.id: r.z for r in O.left_out_scores(df.withColumn("y", F.col("t")), Largest(), 11).collect()}
    assert all(np.array_equal(got[i], np.delete(X, i, 0).max(axis=0)) for i in range(200))


def test_odd_rows(spark):
    rows = [(1, [1.0], 1.0), (1, [1.0], 1.0), (None, [2.0], 3.0), (4, None, 1.0), (5, [1.0], None)]
    df = spark.createDataFrame(rows, "id long, x array<double>, y double")
    got = O.left_out_scores(df, O.LeftOutRidge(1.0)).collect()
    assert sorted((str(r.id), round(r.z[0], 6)) for r in got) == [("1", 1.666667), ("1", 1.666667), ("None", 1.0)]
    assert O.left_out_scores(df.limit(0), O.LeftOutRidge()).count() == 0
    assert [r.z for r in O.left_out_scores(df.filter("id is null"), O.LeftOutRidge()).collect()] == [None]
