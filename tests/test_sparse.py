"""Sparse rows give what dense ones give, and TF-IDF what its formula says."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from trustloom.operators import detectors as T
from trustloom.operators import linear as L
from trustloom.operators import sparse as S


@pytest.fixture(scope="module")
def dense(spark):
    rng = np.random.default_rng(0)
    X, y = rng.normal(size=(60, 7)), rng.integers(0, 3, 60)
    X[np.abs(X) < 0.6] = 0
    X[0] = 0  # a row without features
    return spark.createDataFrame([(i, [float(v) for v in x], int(c)) for i, (x, c) in enumerate(zip(X, y))], "id long, x array<double>, y int").cache()


@pytest.mark.parametrize("classes", [2, 3])
def test_detectors_agree_with_dense_ones(dense, classes):
    df = dense.withColumn("y", F.least("y", F.lit(classes - 1)))
    rows = S.from_dense(df).cache()
    fit = lambda d: L.fit_logistic_stages(d, 4, 1.0, classes, regul=0.1)[-1]
    own = S.fit_sparse_logistic(rows, 7, classes, 4, 1.0, regul=0.1)[-1]
    assert np.allclose(fit(df).coef, own.coef) and np.allclose(fit(df).intercept, own.intercept)
    same = {"self_influence": T.self_influence, "cook_distance": T.cook_distance, "approximate_loo": T.approximate_loo, "representer": T.representer, "agra": T.Agra}
    for name, detector in S.sparse_detectors(lambda d: own, 3).items():
        want = {r.id: r.trust for r in same[name](fit).trust_score(df).collect()}
        assert {r.id: r.trust for r in detector.trust_score(rows).collect()} == pytest.approx(want, abs=1e-8), name
    p = {r.id: r.p for r in S.probabilities(rows, own).collect()}
    want = {r.id: r.p for r in df.select("id", fit(df).probabilities(F.col("x")).alias("p")).collect()}
    assert all(np.allclose(p[i], want[i]) for i in want)


@pytest.mark.parametrize("whole", [0, 10_000])
def test_influence_meets_few_rows_a_group_and_loses_none(dense, monkeypatch, whole):
    monkeypatch.setattr(S, "WHOLE", whole)
    monkeypatch.setattr(S, "MEET", 7)
    df = dense.withColumn("y", F.least("y", F.lit(1)))
    m = L.fit_logistic_stages(df, 2, regul=0.2)[-1]
    m = L.LinearModel(m.coef, None, m.loss, m.regul)  # nothing but its features places a row
    want = {r.id: tuple(r)[1:] for r in L.influence(df, m).select("id", "self_influence", "leverage", "cook", "approximate_loo").collect()}
    out = S.influence(S.from_dense(df), S.SparseModel.of(m), 3)
    got = {r.id: tuple(r)[1:] for r in out.select("id", "self_influence", "leverage", "cook", "approximate_loo").collect()}
    assert len(got) == 60 and all(np.allclose(got[i], want[i]) for i in want)


@pytest.mark.parametrize("block", [1, 2, 5, 64])
def test_inverse_by_blocks(spark, dense, block):
    df = dense.withColumn("y", F.least("y", F.lit(1)))
    m = L.fit_logistic_stages(df, 2, regul=0.2)[-1]
    blocks = S.hessian_blocks(S.from_dense(df), S.SparseModel.of(m), block)
    whole = np.zeros((8, 8))
    for r in S.inverse_blocks(blocks, 8, block).collect():
        rows, columns = S._size(r.bi, block, 8), S._size(r.bj, block, 8)
        whole[r.bi * block : r.bi * block + rows, r.bj * block : r.bj * block + columns] = np.frombuffer(r.m).reshape(rows, columns)
    assert np.allclose(whole, np.linalg.inv(L.hessian(df, m)))


def test_tf_idf(spark):
    texts = ["A b a", "b c, é!", None, "", "c c É", "only"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").withColumn("kept", F.lit(1))
    out, width = S.tf_idf(df, least=2)
    words = [Counter(w for w in re.findall(r"[^\W\d_]+", (t or "").lower())) for t in texts]
    has = Counter(w for c in words for w in c)
    kept = sorted(w for w, n in has.items() if n >= 2)
    got = {r.id: dict(zip(r.i, r.v)) for r in out.collect()}
    assert width == len(kept) and out.columns == ["id", "kept", "i", "v"]
    for k, c in enumerate(words):
        v = {kept.index(w): n * (math.log(7 / (1 + has[w])) + 1) for w, n in c.items() if w in kept}
        norm = math.sqrt(sum(x * x for x in v.values()))
        assert got[k] == pytest.approx({i: x / norm for i, x in v.items()})


@pytest.mark.parametrize("frequent", [2, 1000])
def test_tf_idf_counts_words_without_a_shuffle(spark, monkeypatch, frequent):
    plans, stored = {}, S.stored

    def noted(df, name="table", **options):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return stored(df, name, **options)

    monkeypatch.setattr(S, "stored", noted)
    monkeypatch.setattr(S, "FREQUENT", frequent, raising=False)
    texts = ["a b a c d", "b c d d", "d a e", "e"]
    out, width = S.tf_idf(spark.createDataFrame(list(enumerate(texts)), "id long, text string").localCheckpoint(), least=2)
    got = {r.id: list(r.i) for r in out.collect()}
    assert width == 5 and got == {0: [0, 1, 2, 3], 1: [1, 2, 3], 2: [0, 3, 4], 3: [4]}
    v = np.array([2 * (math.log(5 / 3) + 1), math.log(5 / 3) + 1, math.log(5 / 3) + 1, math.log(5 / 4) + 1])
    assert np.allclose(out.filter("id = 0").first().v, v / np.linalg.norm(v))
    assert "Exchange" not in plans["words"]


def test_wide_rows_keep_clear_of_dense_matrices(spark):
    rows = spark.range(300).select("id", F.array((F.col("id") * 331 % 100_000).cast("int"), F.lit(100_001)).alias("i"), F.array(F.lit(1.0), F.lit(0.5)).alias("v"), (F.col("id") % 2).cast("int").alias("y"))
    model = S.fit_sparse_logistic(rows, 100_002, epochs=2)[-1]
    out = S.gradient_probes(rows, model).toPandas()
    assert len(out) == 300 and out.notna().all().all() and np.count_nonzero(model.coef) <= 301


def test_no_rows(spark, dense):
    rows = S.from_dense(dense.limit(0))
    model = S.SparseModel(np.zeros((1, 7)), np.zeros(1), "log_loss", 1.0)
    assert S.gradient_probes(rows, model).count() == 0 and S.influence(rows, model, 3).count() == 0 and S.probabilities(rows, model).count() == 0
    assert not S.mean_gradient(rows, model).any()
