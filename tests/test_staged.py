"""Stages, folds, quantiles, ranks and calibration against numpy, Spark's own models and by identity."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from trustloom.functions import expr as E
from trustloom.functions import probes as P
from trustloom.operators import aggregates as A
from trustloom.operators import decide as D
from trustloom.operators import detectors as T
from trustloom.operators import ensembles as N
from trustloom.operators import linear as L
from trustloom.operators import networks
from trustloom.operators import staged as S
from trustloom.plans import catalogue as C
from trustloom.plans import learners as K


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(0)
    X = (rng.random((300, 5)) < 0.5).astype(float)
    y = ((X[:, 0] + X[:, 1] + 0.3 * rng.standard_normal(300)) > 1).astype(int)
    return spark.createDataFrame([(i, list(map(float, x)), int(v)) for i, (x, v) in enumerate(zip(X, y))], "id long, x array<double>, y int").cache()


def test_variance_of_large_scores(spark):
    data = [(1, k, k % 2 == 0, 1.0 + k % 3, [1e8 + k % 2]) for k in range(6)] + [(2, 0, False, 1.0, [1e8]), (2, 1, False, 1.0, [1e8 + 1])]
    st = spark.createDataFrame(data, "id long, member int, oob boolean, weight double, score array<double>")
    w, s = np.array([d[3] for d in data[:6]]), np.array([d[4][0] for d in data[:6]])
    got = {r.id: r.value for r in A.VAR.run(st).collect()}
    assert got[2] == 0.25 and got[1] == pytest.approx(np.average((s - np.average(s, weights=w)) ** 2, weights=w))
    assert {r.id: r.value for r in A.from_axis(F.avg, A.VAR).run(st).collect()} == pytest.approx(got)


@pytest.mark.parametrize("estimator", [S.BoostedStumps(4), S.GradientBoosting(3, 2)])
def test_fit_staging_is_predict_staging(rows, estimator):
    for detector in (T.area_under_margin, T.forget_scores):
        fit = {r.id: r.trust for r in detector(estimator, 1, "fit").trust_score(rows).collect()}
        assert {r.id: r.trust for r in detector(estimator, 1, "predict").trust_score(rows).collect()} == pytest.approx(fit)
    assert N.ProgressiveEnsemble(estimator, 2, "predict").probe(rows, P.margin()).select("member").distinct().count() == 2


def test_stages_without_a_registration_raise(rows):
    with pytest.raises(NotImplementedError):
        N.ProgressiveEnsemble(S.GradientDescent(3), 1, "predict").probe(rows, P.margin())
    with pytest.raises(NotImplementedError):
        S.staged_fit(object(), rows)


def test_tree_sums_score_as_spark_does(rows):
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector, vector_to_array

    model = GBTClassifier(labelCol="y", maxIter=4, maxDepth=3, seed=1).fit(rows.withColumn("features", array_to_vector("x")))
    own = S.TreeSum.of_spark(model)
    out = model.transform(rows.withColumn("features", array_to_vector("x"))).select(vector_to_array("probability").alias("p"), own.probabilities(F.col("x")).alias("q"), own.predictions(F.col("x")).alias("a"), "prediction").collect()
    assert np.allclose([r.p for r in out], [r.q for r in out]) and all(r.a == r.prediction for r in out)
    assert K.parameter_count(own) == K.parameter_count(model) == sum(S.leaves(t) for t in own.trees)
    hot = K.leaf_features(own, rows).select("x").collect()
    assert all(len(r.x) == K.parameter_count(own) and sum(r.x) == 4 for r in hot)


def test_a_pipeline_stages_its_last_step(rows):
    scaled = E.held(rows, x=S.standardised(rows)(F.col("x")))
    X = np.array([r.x for r in scaled.collect()])
    assert np.allclose(X.mean(axis=0), 0) and np.allclose(X.std(axis=0), 1)
    own = T.area_under_margin(S.Pipeline([S.standardised], S.GradientDescent(3))).trust_score(rows).collect()
    want = {r.id: r.trust for r in T.area_under_margin(S.GradientDescent(3)).trust_score(scaled).collect()}
    assert {r.id: r.trust for r in own} == pytest.approx(want)


def test_folds(spark, rows):
    dealt = N.folds(rows, 4, 3).toPandas()
    assert len(dealt) == 900 and dealt.groupby(["repeat", "id"]).size().eq(1).all()
    sizes = dealt.groupby(["repeat", "y", "fold"]).size().unstack()
    assert ((sizes.max(axis=1) - sizes.min(axis=1)) <= 1).all()
    assert (dealt[dealt.repeat == 0].sort_values("id").fold.to_numpy() != dealt[dealt.repeat == 1].sort_values("id").fold.to_numpy()).any()
    # Each member against a fit on its own training rows.
    out = N.IndependentEnsemble(2, 4, 3).probe(rows, P.confidence("probabilities"))
    got = {(r.id, r.member): (r.oob, r.score[0]) for r in out.collect()}
    for repeat, fold in ((0, 1), (2, 3)):
        part = dealt[dealt.repeat == repeat].set_index("id").fold
        train = rows.join(spark.createDataFrame([(int(i),) for i in part[part != fold].index], "id long"), "id")
        model = L.fit_naive_bayes(train, 2)[0]
        for r in rows.select("id", F.get(model.probabilities(F.col("x")), F.col("y")).alias("p")).collect():
            oob, p = got[r.id, repeat * 4 + fold]
            assert p == pytest.approx(r.p) and oob == (part[r.id] == fold)
    split = N.IndependentEnsemble(2, 1, 5, deal=lambda df: N.shuffle_splits(df, 0.3, 5)).probe(rows, P.margin()).toPandas()
    assert set(split.member) == set(range(5)) and 0.15 < split.oob.mean() < 0.45
    given = N.IndependentEnsemble(2, 2, deal=N.predefined("part")).probe(rows.withColumn("part", (F.col("id") % 2).cast("int")), P.margin()).toPandas()
    assert (given.oob == (given.id % 2 == given.member)).all()


@pytest.mark.parametrize("kind", ["clustered", "tied", "spread"])
def test_quantiles_are_exact(spark, kind):
    rng = np.random.default_rng(1)
    s = {"clustered": np.concatenate([rng.normal(0, 1e-9, 400), [1e9, -1e9]]), "tied": rng.integers(0, 3, 400).astype(float), "spread": rng.standard_cauchy(401)}[kind]
    df = spark.createDataFrame([(i % 3, float(v)) for i, v in enumerate(s)] + [(0, None)], "y int, s double")
    for q in (0.0, 0.1, 0.5, 0.77, 1.0):
        assert D.quantiles(df, "s", q)[None] == pytest.approx(np.quantile(s, q), rel=1e-12, abs=1e-24)
        by = D.quantiles(df, "s", q, "y")
        assert all(by[k] == pytest.approx(np.quantile(s[k::3], q), rel=1e-12, abs=1e-24) for k in range(3))
    assert D.quantiles(df.limit(0), "s", 0.5) == {}


def test_row_numbers_of_clustered_ids(spark):
    ids = [*range(0, 300, 3), *range(10**15, 10**15 + 50), -7]
    got = {r.id: r._r for r in P.row_numbers(spark.createDataFrame([(i,) for i in ids], "id long")).collect()}
    assert got == {i: k for k, i in enumerate(sorted(ids))}


def test_calibration_of_any_ensemble(rows):
    on_slice = F.pmod("id", F.lit(3)) == 0
    for inner, members in ((N.NoEnsemble(lambda df: L.fit_naive_bayes(df, 2)[0]), 1), (N.IndependentEnsemble(2, 3, 2), 6), (N.ProgressiveEnsemble(S.GradientDescent(4)), 4)):
        for method in ("sigmoid", "isotonic"):
            out = N.CalibratedEnsemble(inner, 2, on_slice, method=method).probe(rows, P.confidence("probabilities")).toPandas()
            assert set(out.member) == set(range(members)) and (out.id % 3 != 0).all() and len(out) == 200 * members
            assert out.score.map(lambda v: -1e-9 <= v[0] <= 1 + 1e-9).all()
            assert out.oob.any() == isinstance(inner, N.IndependentEnsemble)


def test_networks_match_numpy(spark, rows):
    mlp = networks.Mlp.init([5, 3, 2], 2)
    X, y = np.array([r.x for r in rows.orderBy("id").collect()]), np.array([r.y for r in rows.orderBy("id").collect()])
    J = mlp.jacobian(X).reshape(len(X), -1)
    got = networks.kernel(rows, mlp, "id < 40").orderBy("id").collect()
    assert np.allclose([r.kernel for r in got], J @ J[:40].T)
    z = mlp.forward(X)[-1]
    want = z[np.arange(len(X)), y] - np.log(np.exp(z).sum(axis=1))
    assert np.allclose([r.value for r in networks.loglikelihood(rows, mlp).orderBy("id").collect()], want)
    # The last layer over hidden features is the network.
    hidden = networks.neural_random_features(rows, mlp, ("y",)).withColumnRenamed("features", "x")
    p = hidden.select("id", mlp.linearised().decision(F.col("x")).alias("z")).orderBy("id").collect()
    assert np.allclose([r.z for r in p], z)


def test_a_kernel_with_many_chosen_rows_is_not_shuffled(spark, rows, monkeypatch):
    monkeypatch.setattr(networks, "BLOCK", 16)
    monkeypatch.setattr(networks, "HELD", 500)
    mlp = networks.Mlp.init([5, 3, 2], 2)
    twice = rows.select("id", "x").unionByName(rows.select((F.col("id") + 1000).alias("id"), "x")).repartition(3)
    X = np.array([r.x for r in twice.orderBy("id").collect()])
    J = mlp.jacobian(X).reshape(len(X), -1)
    out = networks.kernel(twice.localCheckpoint(), mlp, "id % 3 = 0")
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    ids = [r.id for r in twice.orderBy("id").collect()]
    assert np.allclose([r.kernel for r in out.orderBy("id").collect()], J @ J[[i % 3 == 0 for i in ids]].T)
    assert all(r.kernel == [] for r in networks.kernel(twice, mlp, "id < 0").collect())


def test_a_kernel_is_made_once_for_equal_rows(spark, rows, monkeypatch):
    monkeypatch.setattr(networks, "BLOCK", 16)
    mlp = networks.Mlp.init([5, 3, 2], 2)
    many = rows.crossJoin(spark.range(20).toDF("copy")).select((F.col("id") * 20 + F.col("copy")).alias("id"), "x").repartition(7)
    met = networks.kernel_by_place(many, mlp, "id % 20 = 0", digits=6).collect()
    assert sorted(i for r in met for i in r.ids) == list(range(6000))
    assert len(met) <= rows.select("x").distinct().count() + 2 * 4  # 4 ranges: a place more where one begins within a place
    J = mlp.jacobian(np.array([r.x for r in rows.orderBy("id").collect()])).reshape(300, -1)
    got = {r.id: r.kernel for r in networks.kernel(many, mlp, "id % 20 = 0", digits=6).collect()}
    assert np.allclose([got[i] for i in range(6000)], np.repeat(J @ J.T, 20, axis=0), atol=6e-7)
    assert got == {i: r.kernel for r in met for i in r.ids}


def test_the_kernel_query_is_whole(spark, sf):
    name = "F04_neural_tangent_kernel"
    got = {r.id: r.kernel for r in C.QUERIES[name](spark, sf).collect()}
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count() and {len(k) for k in got.values()} == {len(got)}
    whole = np.array([got[i] for i in sorted(got)])
    assert (whole == whole.T).all()
    with duckdb.connect() as con:
        con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
        want = dict(con.execute(C.ORACLE_SQL[name]).fetchall())
    assert np.allclose(whole, [want[i] for i in sorted(want)], rtol=0, atol=1e-6)


def test_a_kernel_of_any_ids_and_of_no_rows(spark):
    mlp = networks.Mlp.init([2, 3, 2], 2)
    named = spark.createDataFrame([("b", [0.0, 1.0]), ("a", [1.0, 0.5]), ("c", [-0.0, 1.0])], "id string, x array<double>")
    J = mlp.jacobian(np.array([[1.0, 0.5], [0.0, 1.0], [0.0, 1.0]])).reshape(3, -1)
    assert np.allclose([r.kernel for r in networks.kernel(named, mlp).orderBy("id").collect()], J @ J.T)
    assert networks.kernel(named.limit(0), mlp).collect() == []


def test_rounding_is_that_of_spark(spark):
    rng = np.random.default_rng(3)
    v = [5e-7, 1.0000005, -2.5e-7, -1e-9, 0.0, 1.1234565, 2.0000015, -7.0000025, 1e9 + 0.1234565, 123456789.0123455, 1e15 + 0.3, 1e17, 1.7e308, float("inf"), *rng.normal(0, 30, 500), *np.round(rng.normal(0, 3, 500), 7)]
    want = [r.v for r in spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)], "i int, v double").orderBy("i").select(F.round("v", 6).alias("v")).collect()]
    assert networks._rounded(np.array(v), 6).tolist() == want
    assert np.isnan(networks._rounded(np.array([np.nan]), 6)).all()


def test_linearised_models_keep_their_predictions(rows):
    from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression
    from pyspark.ml.functions import array_to_vector

    df = rows.withColumn("features", array_to_vector("x"))
    model = LogisticRegression(labelCol="y", regParam=0.05, standardization=False).fit(df)
    linear, own = K.linearize(model, df)
    out = model.transform(own).select("prediction", linear.predictions(F.col("x")).alias("own")).collect()
    assert all(r.prediction == r.own for r in out) and linear.regul == pytest.approx(0.05 * 300)
    tree = DecisionTreeClassifier(labelCol="y", maxDepth=3, seed=1).fit(df)
    hot = K.tree_projections(tree, rows).collect()
    assert all(sum(r.x) == 1 for r in hot) and len({tuple(r.x) for r in hot}) == K.parameter_count(tree)
    surrogate, leaves = K.linearize(tree, df)
    both = leaves.select("id", surrogate.predictions(F.col("x")).alias("own")).join(tree.transform(df).select("id", "prediction"), "id")
    assert both.filter("own = prediction").count() >= 290


def test_isolation_forest_finds_outliers(spark):
    rng = np.random.default_rng(5)
    X = np.concatenate([rng.standard_normal((400, 3)), [[8.0, 8.0, 8.0], [-9.0, 7.0, 0.0]]])
    df = spark.createDataFrame([(i, list(map(float, x)), i % 2) for i, x in enumerate(X)], "id long, x array<double>, y int")
    from trustloom.operators import outliers as O

    model = O.IsolationForest(seed=1).fit(df)
    low = df.select("id", model.score(F.col("x")).alias("s")).orderBy("s").limit(2).collect()
    assert {r.id for r in low} == {400, 401} and all(-1 <= r.s < 0 for r in low)
    trust = T.outlier_detector(O.IsolationForest(8)).trust_score(df).orderBy("trust").limit(2).collect()
    assert {r.id for r in trust} == {400, 401}
    assert O.IsolationForest().fit(df.limit(0)).trees == [0.0] and O.average_path(2) == 1.0


def test_one_vs_rest_and_self_training(spark):
    rng = np.random.default_rng(6)
    y = np.arange(300) % 3
    X = np.eye(3)[y] * 2 + 0.3 * rng.standard_normal((300, 3))
    df = spark.createDataFrame([(i, list(map(float, x)), int(v)) for i, (x, v) in enumerate(zip(X, y))], "id long, x array<double>, y int").cache()
    one = L.fit_one_vs_rest(df, 3, S.GradientDescent(20).fit)
    binary = S.GradientDescent(20).fit(df.withColumn("y", (F.col("y") == 1).cast("int")))
    assert one.coef[1] == binary.coef[0] and df.filter(one.predictions(F.col("x")) == F.col("y")).count() > 290
    some = df.withColumn("y", F.when(F.col("id") < 30, F.col("y")).otherwise(-1))
    model = L.self_training(some, lambda d: L.fit_one_vs_rest(d, 3, S.GradientDescent(20).fit), 0.4, 3)
    assert df.filter(model.predictions(F.col("x")) == F.col("y")).count() > 290


def test_hat_blocks_have_the_leverage_as_trace(spark):
    rng = np.random.default_rng(3)
    X, y = rng.standard_normal((50, 2)), rng.integers(0, 3, 50)
    df = spark.createDataFrame([(i, list(map(float, x)), int(v)) for i, (x, v) in enumerate(zip(X, y))], "id long, x array<double>, y int")
    model = L.LinearModel([[0.5, -0.2], [-0.3, 0.4], [0.1, 0.2]], [0.1, -0.1, 0.0], "log_loss", 0.7)
    lever = {r.id: r.leverage for r in L.influence(df, model).collect()}
    for r in L.hat_blocks(df, model).collect():
        assert np.trace(np.array(r.block)) == pytest.approx(lever[r.id]) and np.allclose(r.block, np.array(r.block).T)


@pytest.mark.parametrize("aggregate", ["sum", "count", "mean", "var", A.FORGET, A.oob("mean"), A.itb("var"), A.oob(A.FORGET), A.from_axis(F.avg, A.VAR), A.from_axis(F.max, A.MEAN)])
def test_members_in_a_row_reduce_as_a_stream_does(spark, aggregate):
    rng = np.random.default_rng(6)
    data = [(i, [(k, bool(rng.integers(0, 2)), float(rng.integers(1, 4)), [float(rng.integers(0, 5)), float(rng.normal())]) for k in range(6)]) for i in range(20)]
    df = spark.createDataFrame([*data, (None, data[0][1])], "id long, _members array<struct<member: int, oob: boolean, weight: double, score: array<double>>>")
    a = A.check_aggregate(aggregate)
    own = {r.id: r.value for r in df.select("id", a.in_row(F.col("_members")).alias("value")).collect()}
    stream = df.select("id", F.explode("_members").alias("m")).select("id", "m.*")
    want = {r.id: r.value for r in a.run(stream).collect()}
    assert own.keys() == want.keys() and None in own
    for i, v in want.items():
        assert (v is None and own[i] is None) or own[i] == pytest.approx(v), i


def test_stage_detectors_shuffle_nothing_and_keep_null_ids(spark, rows):
    some = rows.withColumn("id", F.when(F.col("id") % 50 != 0, F.col("id")))
    model = S.GradientDescent(3).fit(rows)
    for detector in (T.area_under_margin(lambda df: [model] * 3), T.forget_scores(lambda df: [model] * 3), T.volg(lambda df: [model] * 3)):
        out = detector.trust_score(some)
        assert out.count() == some.count() and out.filter("id is null").count() == 6
        assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()


def test_a_hundred_boosted_stages_plan_fast(rows):
    import time

    trees = [S.Split(k % 2, (k % 7) / 7 - 0.5, S.Split((k + 1) % 2, 0.1, -0.2, 0.1), 0.05 * (k % 3)) for k in range(100)]
    model = S.TreeSum(trees, [0.1] * 100)
    N.ProgressiveEnsemble(lambda df: model, 1, "predict").members(rows.limit(5), P.margin()).collect()
    began = time.time()
    out = T.area_under_margin(lambda df: model, staging="predict").trust_score(rows)
    out._jdf.queryExecution().executedPlan()
    assert time.time() - began < 10  # 3 s on an idle machine
    last = {r.id: r.m for r in rows.select("id", (sum((S.TreeSum(trees[:k], [0.1] * k).margin(F.col("x")) for k in (1, 2)), F.lit(0.0))).alias("m")).collect()}
    two = {r.id: r.trust for r in T.area_under_margin(lambda df: S.TreeSum(trees[:2], [0.1] * 2), staging="predict").trust_score(rows.withColumn("y", F.lit(1))).collect()}
    assert two == pytest.approx({i: 2 * v for i, v in last.items()})
