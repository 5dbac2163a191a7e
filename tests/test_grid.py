"""A grid of quantiles runs its detector once and fits what separate runs fit."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trustloom.operators import grid
from trustloom.operators import linear as L


class Counting:
    runs = 0

    def __repr__(self):
        return "counting"

    def trust_score(self, df):
        Counting.runs += 1
        return df.select("id", (F.pmod(F.col("id") * 37, F.lit(101)) / F.lit(101.0)).alias("trust"))


def test_a_hundred_quantiles_cost_one_run(spark):
    rng = np.random.default_rng(4)
    X, y = rng.integers(0, 2, (150, 5)), rng.integers(0, 3, 150)
    X[:, 0] = y == 1
    df = spark.createDataFrame([(i, [float(v) for v in X[i]], int(y[i]), i % 3) for i in range(150)], "id long, x array<double>, y int, fold int").repartition(3).cache()
    shares, memory = [k / 100 for k in range(100)], {}
    got = {r["quantile"]: r for r in grid.quantile_grid(df, Counting(), shares, 3, 3, memory=memory).collect()}
    again = grid.quantile_grid(df.repartition(2), Counting(), [0.5], 3, 3, memory=memory).first()
    assert Counting.runs == 1 and len(got) == 100 and again == got[0.5]
    trust = np.array([(i * 37 % 101) / 101 for i in range(150)])
    for q in (0.0, 0.33, 0.9):
        cut, right = np.quantile(trust, q), 0
        assert got[q].threshold == pytest.approx(cut) and got[q].kept == (trust >= cut).sum()
        for f in range(3):
            model = L.fit_naive_bayes(df.filter((F.col("fold") != f) & F.col("id").isin([int(i) for i in np.flatnonzero(trust >= cut)])), 3)[0]
            z = X[np.arange(150) % 3 == f] @ np.array(model.coef).T + model.intercept
            right += (z.argmax(axis=1) == y[np.arange(150) % 3 == f]).sum()
        assert got[q].accuracy == pytest.approx(right / 150)
    # Other rows ask for another run.
    grid.quantile_grid(df.filter("id > 3"), Counting(), [0.5], 3, 3, memory=memory)
    assert Counting.runs == 2
    assert grid.quantile_grid(df.limit(0), Counting(), [0.5], 3, 3, memory=memory).count() == 0
