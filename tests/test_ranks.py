"""Kendall's tau against all pairs."""

import numpy as np
import pytest

from trustloom.operators.ranks import inversions, kendall


def brute(x, y):
    dx, dy = np.sign(x[:, None] - x[None]), np.sign(y[:, None] - y[None])
    low = np.tril_indices(len(x), -1)
    dx, dy = dx[low], dy[low]
    scale = np.sqrt((dx != 0).sum() * (dy != 0).sum())
    return (dx * dy).sum() / scale if scale else None


def test_inversions():
    rng = np.random.default_rng(0)
    rank, w = rng.permutation(70), rng.integers(1, 5, 70)
    want = sum(int(w[i] * w[j]) for i in range(70) for j in range(i + 1, 70) if rank[i] > rank[j])
    assert inversions(rank, w) == want and inversions(rank[:1], w[:1]) == 0


@pytest.mark.parametrize("case", ["free", "ties", "third", "constant"])
def test_kendall_equals_the_count_of_pairs(spark, case):
    rng = np.random.default_rng(7)
    x = rng.normal(size=300)
    y = 0.5 * x + rng.normal(size=300)
    if case == "ties":
        x, y = x.round(0), y.round(1)
    if case == "third":
        x[:100], y[50:150] = 0.25, -1.0
    if case == "constant":
        y[:] = 1.0
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)] + [(None, 1.0), (1.0, None)], "x double, y double")
    want, got = brute(x, y), kendall(df, "x", "y").first().tau
    assert got is None if want is None else got == pytest.approx(want)


def test_kendall_of_no_rows(spark):
    assert kendall(spark.createDataFrame([], "x double, y double"), "x", "y").first().tau is None
