"""Networks trained here against numpy, numeric gradients and plain loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trustloom.operators import detectors as T
from trustloom.operators.networks import Mlp
from trustloom.operators.training import Network, NetworkTraining
from trustloom.plans.learners import linearize, parameter_count


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(6)
    X = rng.normal(size=(120, 3))
    t = np.sin(X[:, 0]) + X[:, 1] * X[:, 2]
    df = spark.createDataFrame([(i, [float(v) for v in X[i]], float(t[i]), int(t[i] > 0), int(i % 3)) for i in range(120)], "id long, x array<double>, t double, c int, k int").repartition(3).cache()
    return X, t, df


def flat(net):
    return np.concatenate([p for w, b in net.mlp.layers for p in (w.reshape(-1), b)])


@pytest.mark.parametrize("activation", ["tanh", "logistic", "relu", "identity"])
@pytest.mark.parametrize("loss,outputs", [("log_loss", 1), ("log_loss", 3), ("squared", 1)])
def test_gradient_is_numeric(data, activation, loss, outputs):
    X, t, _ = data
    y = t if loss == "squared" else (t > 0).astype(float) if outputs == 1 else np.arange(120.0) % 3
    net = Network(Mlp.init([3, 4, 2, outputs], 1, activation), loss)
    got = net.gradient(X, y)
    for k in range(0, net.mlp.num_params, 3):
        e = np.zeros(net.mlp.num_params)
        e[k] = 1e-6
        assert (net.moved(e).gradient(X, y)[-2] - net.moved(-e).gradient(X, y)[-2]) / 2e-6 == pytest.approx(got[k], abs=1e-4)
    assert got[-1] == 120


def test_columns_equal_numpy(data):
    X, t, df = data
    for loss, outputs, column, y in (("log_loss", 1, "c", (t > 0) * 1.0), ("log_loss", 3, "k", np.arange(120.0) % 3), ("squared", 1, "t", t)):
        net = Network(Mlp.init([3, 4, 2, outputs], 2), loss)
        x = F.col("x")
        rows = df.select("id", net.decision(x).alias("z"), net.predictions(x).alias("p"), net.grad_norm(x, F.col(column)).alias("g"), net.grad_x(x, F.col(column)).alias("gx")).orderBy("id").collect()
        z = net.mlp.forward(X)[-1]
        assert np.allclose([r.z for r in rows], z)
        assert np.allclose([r.p for r in rows], z[:, 0] if loss == "squared" else z.argmax(axis=1) if outputs == 3 else z[:, 0] > 0)
        own = np.array([net.gradient(X[i : i + 1], y[i : i + 1])[:-2] for i in range(120)])
        assert np.allclose([r.g for r in rows], (own**2).sum(axis=1))
        e = 1e-6 * np.eye(3)
        near = [[(net.gradient(X[i : i + 1] + v, y[i : i + 1])[-2] - net.gradient(X[i : i + 1] - v, y[i : i + 1])[-2]) / 2e-6 for v in e] for i in range(5)]
        assert np.allclose([r.gx for r in rows[:5]], near, atol=1e-5)


def test_stages_equal_a_plain_loop(data):
    """Mini-batches with momentum and a penalty, by the same deal and order."""
    X, t, df = data
    rows = df.withColumn("y", F.col("t"))
    training = NetworkTraining((4,), epochs=3, rate=0.1, batches=4, momentum=0.5, classes=None, regul=0.01, seed=5)
    got = training.stages(rows)
    batch = np.array([r.b for r in df.select("id", F.pmod(F.xxhash64("id"), F.lit(4)).alias("b")).orderBy("id").collect()])
    net, rng, speed = Network(Mlp.init([3, 4, 1], 5), "squared", 0.01), np.random.default_rng(5), 0.0
    for k in range(3):
        for b in rng.permutation(4):
            g = net.gradient(X[batch == b], t[batch == b])
            speed = 0.5 * speed - 0.1 * (g[:-2] / g[-1] + net.penalties())
            net = net.moved(speed)
        assert np.allclose(flat(got[k]), flat(net))
    further = NetworkTraining((4,), epochs=1, batches=4, classes=None, start=got[-1]).fit(rows)
    assert not np.allclose(flat(further), flat(got[-1])) and parameter_count(got[0]) == got[0].mlp.num_params


def test_learns_what_a_line_cannot(data):
    """A product of features: the loss falls well below that of the best line, and flipped labels get low trust."""
    X, t, df = data
    training = NetworkTraining((8,), epochs=60, rate=0.5, momentum=0.8, seed=1)
    flipped = F.col("id") % 15 == 0
    rows = df.withColumn("y", F.when(flipped, 1 - F.col("c")).otherwise(F.col("c"))).select("id", "x", "y").cache()
    models = training.stages(rows)
    loss = [m.gradient(X, (t > 0) * 1.0)[-2] / 120 for m in models]
    assert loss[-1] < 0.35 < loss[0]
    trust = {r.id: r.trust for r in T.area_under_margin(lambda d: models, steps=15).trust_score(rows).collect()}
    assert np.mean([trust[i] for i in range(0, 120, 15)]) < np.mean([trust[i] for i in range(120) if i % 15])


def test_linearised_regression(data):
    X, t, df = data
    rows = df.withColumn("y", F.col("t"))
    net = NetworkTraining((4,), epochs=2, classes=None, regul=0.1).fit(rows)
    model, hidden = linearize(net, rows)
    assert model.loss == "squared" and not model.classifier and model.regul == 0.1
    got = {r.id: r.p for r in hidden.select("id", model.predictions(F.col("x")).alias("p")).collect()}
    assert np.allclose([got[i] for i in range(120)], net.mlp.forward(X)[-1][:, 0])


def test_no_rows_and_nulls(spark, data):
    df = data[2].withColumn("y", F.col("c"))
    none = NetworkTraining((2,), epochs=2, batches=3).stages(df.limit(0))
    assert len(none) == 2 and np.array_equal(flat(none[0]), flat(none[1]))
    odd = df.select("id", "x", "y").unionByName(spark.createDataFrame([(900, None, 1), (901, [0.0, 0.0, 0.0], None)], "id long, x array<double>, y int"))
    assert np.allclose(flat(NetworkTraining((2,), epochs=2).fit(odd)), flat(NetworkTraining((2,), epochs=2).fit(df)))
    with pytest.raises(ValueError):
        NetworkTraining(epochs=0)
