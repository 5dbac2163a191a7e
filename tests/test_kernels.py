"""Kernel maps against the kernel, landmarks, and the one-class machine on planted outliers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trustloom.operators import detectors as T
from trustloom.operators import kernels as R
from trustloom.operators import staged as S


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(1)
    X = np.concatenate([rng.normal(c, 0.4, (60, 2)) for c in (0, 3)])
    X[[5, 70]] = [[9.0, -8.0], [-7.0, 9.0]]
    return X, spark.createDataFrame([(i, [float(v) for v in x], int(i >= 60)) for i, x in enumerate(X)], "id long, x array<double>, y int").repartition(3).cache()


def gaussian(X, Y, gamma):
    return np.exp(-gamma * ((X[:, None] - Y[None]) ** 2).sum(axis=2))


def mapped(df, of):
    return np.array([r.z for r in df.select("id", of(F.col("x")).alias("z")).orderBy("id").collect()])


def test_maps_approximate_the_kernel(data):
    X, df = data
    K = gaussian(X, X, 0.5)
    Z = mapped(df, R.random_fourier(3000, 0.5)(df))
    assert np.abs(Z @ Z.T - K).max() < 0.12
    few, many = (mapped(df, R.nystroem(k, 0.5)(df)) for k in (4, 40))
    errors = [np.abs(Z @ Z.T - K).mean() for Z in (few, many)]
    assert errors[1] < 0.01 < errors[0]
    assert np.allclose(*(lambda Z: (Z @ Z.T, K))(mapped(df, R.nystroem_map(X, 0.5))), atol=1e-6)


def test_landmarks_spread_and_repeat(data):
    X, df = data
    L = R.landmarks(df, 6)
    assert len({tuple(r) for r in L.tolist()}) == 6 and all((X == r).all(axis=1).any() for r in L)
    assert (L == R.landmarks(df.repartition(7), 6)).all()
    assert {tuple(x) for x in X[[5, 70]].tolist()} <= {tuple(r) for r in L.tolist()}  # far points are covered
    same = df.withColumn("x", F.array(F.lit(1.0), F.lit(2.0)))
    assert R.landmarks(same, 5).tolist() == [[1.0, 2.0]] and R.landmarks(df.limit(0), 3).size == 0


def test_one_class_finds_outliers_and_nu_is_their_share(data):
    X, df = data
    for nu in (0.05, 0.25):
        machine = R.OneClassSvm(nu, R.nystroem(30, 0.5)).fit(df)
        score = mapped(df, lambda x: F.array(machine.score(x)))[:, 0]
        assert abs((score < 0).mean() - nu) <= 1 / len(X) and {5, 70} <= set(np.flatnonzero(score < 0))
    scores = T.outlier_detector(R.OneClassSvm(0.1, R.random_fourier(200, 0.5))).trust_score(df).filter("trust < 0").collect()
    assert {5, 70} <= {r.id for r in scores} and len(scores) <= 13


def test_one_class_nears_the_optimum(data):
    """The dual: the shortest mean of features with no row over 1 / (nu n)."""
    _, df = data
    of = R.random_fourier(20, 0.5)(df)
    Z, nu = mapped(df, of), 0.2
    loss = lambda w: 0.5 * w @ w - (rho := np.quantile(Z @ w, nu)) + np.maximum(0, rho - Z @ w).mean() / nu
    few, many = (np.array(R.OneClassSvm(nu, lambda d: of, k).fit(df).weights) for k in (1, 60))
    w = Z.mean(axis=0)
    for t in range(5000):
        s = Z @ w
        w = w + 2 / (t + 3) * (Z[s <= np.sort(s)[int(nu * len(s)) - 1]].mean(axis=0) - w)
    assert loss(w) - 1e-4 <= loss(many) < loss(few) and loss(many) - loss(w) < 0.01


def test_a_pipeline_stages_a_model_on_a_kernel_map(data):
    X, df = data
    stages = S.staged_fit(S.Pipeline([S.standardised, R.nystroem(10, 1.0)], S.GradientDescent(3)), df)
    p = mapped(df, lambda x: stages[-1].score("probabilities", x)) if hasattr(stages[-1], "score") else None
    assert len(stages) == 3 and ((p[:, 1] > 0.5) == (np.arange(120) >= 60)).mean() > 0.9
