"""Probes, influence, ensembles, aggregates, splitters and weak labels against numpy and by identity."""

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
from trustloom.plans import learners as K
from trustloom.sources import readers, toy


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(0)
    X = rng.standard_normal((60, 2))
    y = (X[:, 0] + 0.5 * X[:, 1] + 0.3 * rng.standard_normal(60) > 0).astype(int) + (X[:, 1] > 1).astype(int)
    return X, y


def frame(spark, X, y, kind="int"):
    return spark.createDataFrame([(i, list(map(float, x)), v.item()) for i, (x, v) in enumerate(zip(X, y))], f"id long, x array<double>, y {kind}")


MODEL = L.LinearModel([[0.5, -0.2], [-0.3, 0.4], [0.1, 0.2]], [0.1, -0.1, 0.0], "log_loss", 0.7)


def loss(w, X, y, regul, k):
    """Summed log loss of flat parameters: feature-major, intercepts last."""
    d = X.shape[1]
    W, b = w[: d * k].reshape(d, k), w[d * k :]
    z = X @ W + b
    m = z.max(axis=1, keepdims=True)
    return float((np.log(np.exp(z - m).sum(axis=1)) + m[:, 0] - z[np.arange(len(y)), y]).sum() + 0.5 * regul * (W**2).sum())


def test_hessian_and_gradient_match_finite_differences(spark, data):
    X, y = data
    w = np.concatenate([np.array(MODEL.coef).T.ravel(), MODEL.intercept])
    H = L.hessian(frame(spark, X, y), MODEL)
    eps, n = 1e-4, len(w)
    num = np.zeros((n, n))
    for i in range(n):
        for j in range(n):
            e = lambda a, b: loss(w + a * eps * np.eye(n)[i] + b * eps * np.eye(n)[j], X, y, 0.7, 3)
            num[i, j] = (e(1, 1) - e(1, -1) - e(-1, 1) + e(-1, -1)) / (4 * eps * eps)
    assert np.allclose(H, num, atol=1e-3)
    g = np.array([r.g for r in frame(spark, X, y).select(MODEL.grad_p(F.col("x"), F.col("y")).alias("g")).collect()]).sum(axis=0)
    num = np.array([(loss(w + eps * np.eye(n)[i], X, y, 0, 3) - loss(w - eps * np.eye(n)[i], X, y, 0, 3)) / (2 * eps) for i in range(n)])
    assert np.allclose(g, num, atol=1e-5)


def test_objective(spark, data):
    X, y = data
    w = np.concatenate([np.array(MODEL.coef).T.ravel(), MODEL.intercept])
    assert MODEL.objective(frame(spark, X, y)).first()[0] == pytest.approx(loss(w, X, y, 0.7, 3))


def test_influence_of_ridge_is_true_leave_one_out(spark, data):
    X, _ = data
    y = X @ [1.0, 2.0] + np.random.default_rng(1).standard_normal(60)
    df = frame(spark, X, y, "double")
    got = {r.id: r.approximate_loo for r in L.influence_one(df, L.fit_ridge(df, 1.0)).collect()}
    many = {r.id: r for r in L.influence(df, L.fit_ridge(df, 1.0)).collect()}
    A_ = np.hstack([X, np.ones((60, 1))])

    def fit(keep):
        B = A_[keep]
        return np.linalg.solve(B.T @ B + np.diag([1.0, 1.0, 0.0]), B.T @ y[keep])

    full = fit(np.arange(60))
    for i in range(60):
        w = fit(np.arange(60) != i)
        true = 0.5 * (A_[i] @ full - y[i]) ** 2 - 0.5 * (A_[i] @ w - y[i]) ** 2
        assert got[i] == pytest.approx(true, abs=1e-9) and many[i].approximate_loo == pytest.approx(true, abs=1e-9)


def test_influence_forms_agree(spark, data):
    X, y = data
    df = frame(spark, X, (y > 0).astype(int))
    one = L.LinearModel([[0.4, -0.7]], [0.2], "log_loss", 0.5)
    a, b = L.influence_one(df, one).toPandas().sort_values("id"), L.influence(df, one).toPandas().sort_values("id")
    for c in a.columns:
        assert np.allclose(a[c], b[c])


@pytest.mark.parametrize("classes", [2, 5])
def test_planted_flips_have_the_least_trust(spark, classes):
    rng = np.random.default_rng(2)
    centres = np.eye(classes).repeat(8, axis=1)[:, : 8 * classes]
    y = np.arange(400) % classes
    X = (rng.random((400, centres.shape[1])) < 0.1 + 0.8 * centres[y]).astype(float)
    bad = set(range(classes))
    y[: classes] = (y[:classes] + 1) % classes
    df = frame(spark, X, y).cache()
    nb = lambda d: L.fit_naive_bayes(d, classes)[0]
    for det in (
        T.confident_learning(classes, 5, 2),
        T.small_loss(nb),
        T.ModelProbingDetector(N.NoEnsemble(nb), "margin", "sum"),
        T.leave_one_out(classes),
        T.area_under_margin(lambda d: L.fit_logistic_stages(d, 6, 1.0, classes)),
        T.tracin(lambda d: L.fit_logistic_stages(d, 6, 1.0, classes)),
    ):
        rows = det.trust_score(df).orderBy("trust", "id").limit(classes).collect()
        assert {r.id for r in rows} == bad, det


def test_aggregates(spark):
    rng = np.random.default_rng(3)
    rows = [(i, m, bool(rng.integers(0, 2)), float(rng.random()), [float(rng.standard_normal())]) for i in range(20) for m in range(7)]
    st = spark.createDataFrame(rows, "id long, member int, oob boolean, weight double, score array<double>")
    by = {i: [r for r in rows if r[0] == i] for i in range(20)}
    for r in A.MEAN.run(st).collect():
        assert r.value == pytest.approx(np.average([x[4][0] for x in by[r.id]], weights=[x[3] for x in by[r.id]]))
    for r in A.VAR.run(st).collect():
        s, w = np.array([x[4][0] for x in by[r.id]]), np.array([x[3] for x in by[r.id]])
        m = np.average(s, weights=w)
        assert r.value == pytest.approx(np.average((s - m) ** 2, weights=w))
    none = spark.createDataFrame([(1, 0, False, 1.0, [2.0])], st.schema)
    assert A.oob("mean").run(none).first().value is None and A.itb("mean").run(none).first().value == 2.0
    with pytest.raises(ValueError):
        A.check_aggregate("median")
    assert A.sign(A.VAR, True) == -1 and A.sign(A.oob("sum"), True) == 1 and A.sign(A.MEAN, False) == -1


def test_probe_identities(spark, data):
    X, y = data
    df = frame(spark, X, y).withColumn("p", MODEL.probabilities(F.col("x")))
    same = df.select((P.core(P.margin(), F.col("p"), F.col("y"), [0.2, 0.3, 0.5], 0.0) - P.margin().column(F.col("p"), F.col("y"))).alias("d")).collect()
    assert all(r.d == 0 for r in same)
    adj = P.adjusted(df).groupBy("y").agg(F.avg(F.get("p", F.col("y"))).alias("m")).collect()
    raw = df.groupBy("y").agg(F.avg(F.get("p", F.col("y"))).alias("m")).collect()
    assert np.ptp([r.m for r in adj]) < np.ptp([r.m for r in raw])
    huge = spark.createDataFrame([([1e25, -1e25], 1), ([-1e25, 1e25], 1)], "z array<double>, y int")
    assert all(np.isfinite(r.v) for r in huge.select(P.cross_entropy_with_logits().column(F.col("z"), F.col("y")).alias("v")).collect())
    with pytest.raises(TypeError):
        P.check_probe(3)
    with pytest.raises(NotImplementedError):
        P.unsupervised(P.accuracy())
    with pytest.raises(ValueError):
        N.ProgressiveEnsemble(staging="other")
    with pytest.raises(ValueError):
        N.ProgressiveEnsemble(steps=0)


def test_splitters(spark):
    rng = np.random.default_rng(4)
    s = np.concatenate([rng.normal(0, 0.1, 40), rng.normal(1, 0.1, 160)])
    df = spark.createDataFrame([(i, i % 2, float(v), float(rng.random())) for i, v in enumerate(s)], "id long, y int, trust double, other double")
    assert D.QuantileSplitter(0.3).split(df, "trust").filter("trusted").count() == 140
    both = D.QuantileSplitter(0.3).split(df, "trust", "other").toPandas()
    q = 1 - 0.7**0.5
    assert (both.trusted == ((both.trust >= np.quantile(both.trust, q)) & (both.other >= np.quantile(both.other, q)))).all()
    gmm = {r.id: r.trusted for r in D.GmmSplitter(10).split(df).collect()}
    assert all(gmm[i] == (i >= 40) for i in range(200))
    per = D.PerClassSplitter(D.GmmSplitter(10)).split(df, "trust").toPandas()
    assert per.trusted.sum() == 160
    assert D.GmmSplitter().split(df.limit(0)).count() == 0 and D.QuantileSplitter().split(df.limit(0), "trust").count() == 0


def test_weak_labels(spark):
    df = spark.createDataFrame([(1, [0, 0, 1]), (2, [-1, 1, 1]), (3, [-1, -1, -1])], "id long, votes array<int>")
    major = D.WeakLabelEncoder("majority").fit(df).transform(df).orderBy("id").collect()
    assert [r.weak for r in major] == [0, 1, -1]
    soft = D.WeakLabelEncoder("soft").fit(df).transform(df).orderBy("id").collect()
    assert soft[0].weak == pytest.approx([2 / 3, 1 / 3]) and soft[1].weak == [0, 1] and soft[2].weak == [None, None]
    named = spark.createDataFrame([(1, ["a", "a", "b"]), (2, ["-1", "b", "b"])], "id long, votes array<string>")
    e = D.WeakLabelEncoder("majority").fit(named)
    assert [r.name for r in e.inverse(e.transform(named)).orderBy("id").collect()] == ["a", "b"]
    with pytest.raises(ValueError):
        D.WeakLabelEncoder("other").fit(df)
    t = spark.createDataFrame([("Good: of THE day!",)], "t string")
    assert t.select(D.tokens(F.col("t")).alias("v")).first().v == ["good", "of", "the", "day", "good of", "of the", "the day"]


def test_handlers_and_final_model(spark):
    rng = np.random.default_rng(6)
    y = np.arange(300) % 2
    X = (rng.random((300, 4)) < np.where(y[:, None], 0.85, 0.15)).astype(float)
    df = spark.createDataFrame([(i, list(map(float, x)), "ab"[v]) for i, (x, v) in enumerate(zip(X, y))], "id long, x array<double>, y string")
    for handler in (D.filter_untrusted, D.unlabel_untrusted, D.weight_untrusted):
        h = D.HandleClassifier(T.confident_learning(2, 3, 1), D.QuantileSplitter(0.1), lambda d, k: L.fit_naive_bayes(d, k)[0], handler).run(df)
        assert h.predict(df).filter("prediction = y").count() > 270


def test_weights_enter_the_final_fit(spark):
    rows = [(i, [float(i % 2)], i % 3 % 2, 1 + i % 4) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, x array<double>, y int, sample_quality int")
    many = spark.createDataFrame([r[:3] for r in rows for _ in range(r[3])], "id long, x array<double>, y int")
    a, b = L.fit_naive_bayes(df, 2)[0], L.fit_naive_bayes(many, 2)[0]
    assert np.allclose(a.coef, b.coef) and np.allclose(a.intercept, b.intercept)


def test_tree_complexity_fits_without_each_row(spark):
    rng = np.random.default_rng(9)
    X, y = rng.integers(0, 2, (60, 4)).astype(float), rng.integers(0, 3, 60)
    df = frame(spark, X, y)

    def leaves(keep, depth):
        def grow(rows, at):
            n = np.bincount(y[rows], minlength=3)
            gini = lambda r: len(r) - (np.bincount(y[r]) ** 2).sum() / max(1, len(r))
            best, gain = None, -1e-9 * len(rows)  # cuts that gain nothing are made too
            if at == depth or (n > 0).sum() < 2:
                return 1
            for j in range(4):
                on = [r for r in rows if X[r, j] > 0.5]
                off = [r for r in rows if X[r, j] <= 0.5]
                if on and off and gini(rows) - gini(on) - gini(off) > gain + 1e-12:
                    best, gain = (on, off), gini(rows) - gini(on) - gini(off)
            return 1 if best is None else grow(best[0], at + 1) + grow(best[1], at + 1)

        return grow(keep, 0)

    for depth in (2, None):
        got = {r.id: r.trust for r in T.TreeComplexity(depth).trust_score(df).collect()}
        assert got == {i: leaves([k for k in range(60) if k != i], depth) for i in range(60)}
    assert T.TreeComplexity().trust_score(df.limit(0)).count() == 0


def test_networks(spark, data):
    X, y = data
    mlp = networks.Mlp.init([2, 3, 2], 1)
    J = mlp.jacobian(X[:4])
    flat = np.concatenate([np.concatenate([w.ravel(), b]) for w, b in mlp.layers])

    def out(v):
        layers, at = [], 0
        for w, b in mlp.layers:
            layers.append((v[at : at + w.size].reshape(w.shape), v[at + w.size : at + w.size + b.size]))
            at += w.size + b.size
        return networks.Mlp(layers, "tanh").forward(X[:4])[-1]

    for k in range(len(flat)):
        e = 1e-6 * np.eye(len(flat))[k]
        assert np.allclose(J[:, :, k], (out(flat + e) - out(flat - e)) / 2e-6, atol=1e-6)
    df = frame(spark, X, y)
    whole = networks.fisher(df, mlp, 0.1)
    assert np.allclose(whole, networks.fisher(df.repartition(3), mlp, 0.1))
    blocks = networks.fisher(df, mlp, 0.1, by_layer=True)
    assert np.allclose(blocks[0], whole[: len(blocks[0]), : len(blocks[0])])


def test_metrics_and_counts(spark):
    rng = np.random.default_rng(8)
    s, good = rng.integers(0, 30, 300) / 10.0, rng.random(300) < 0.6
    df = spark.createDataFrame([(float(a), bool(b)) for a, b in zip(s, good)], "s double, good boolean")
    pos, neg = s[good], s[~good]
    want = ((pos[:, None] > neg).mean() + (pos[:, None] == neg).mean() / 2).item()
    assert K.roc_auc(df, "s", "good").first().auc == pytest.approx(want)
    assert K.parameter_count(L.LinearModel([[1.0, 0.0]], [2.0])) == 2
    with pytest.raises(NotImplementedError):
        K.parameter_count(object())


def test_generators(spark):
    with pytest.raises(ValueError):
        toy.moons(spark, 10, "sideways")
    m = toy.moons(spark, 100, imbalance=3.0).groupBy("y").count().collect()
    assert {r.y: r["count"] for r in m} == {0: 25, 1: 75}
    assert toy.blobs(spark, 10, 3, spread=0.1).count() == 9


def test_readers(spark, tmp_path):
    (tmp_path / "train.json").write_text('{"0": {"label": 1, "weak_labels": [0, -1], "data": {"text": "one"}}, "1": {"label": 0, "weak_labels": [1, 1], "data": {"text": "two"}}}')
    rows = readers.wrench(spark, f"file://{tmp_path}").orderBy("id").collect()
    assert [(r.id, r.text, r.y, r.votes) for r in rows] == [(0, "one", 1, [0, -1]), (1, "two", 0, [1, 1])]
    (tmp_path / "w.csv").write_text("text,label,fold\nhello,-1,train\nbye,1,test\n")
    assert [(r.text, r.y) for r in readers.weasel(spark, f"file://{tmp_path}/w.csv").collect()] == [("hello", 0)]
    with pytest.raises(ValueError):
        readers.wrench(spark, "x", "most")
    (tmp_path / "good.txt").write_text("Hello\nvery nice\n\n")
    (tmp_path / "bad.txt").write_text("bye\n")
    rules = readers.rules(spark, {0: f"file://{tmp_path}/good.txt", 1: f"file://{tmp_path}/bad.txt"})
    assert rules == {0: ["Hello", "very nice"], 1: ["bye"]}
    text = spark.createDataFrame([(1, "Hello, bye!"), (2, "very nice"), (3, None)], "id long, text string")
    assert [r.votes for r in readers.voted(text, rules).orderBy("id").collect()] == [[0, -1, 1], [-1, 0, -1], [-1, -1, -1]]
    named = {str(k): v for k, v in rules.items()}
    assert [r.votes for r in readers.voted(text, {"0": named["0"]}, {"1": named["1"]}).orderBy("id").collect()] == [["1", "-1", "-1"], ["-1", "-1", "0"], ["-1", "-1", "-1"]]


def test_softmax_and_logistic(spark):
    df = spark.createDataFrame([([1000.0, 0.0, -1000.0],)], "z array<double>")
    r = df.select(E.softmax(F.col("z")).alias("p"), E.logsumexp(F.col("z")).alias("l"), E.logistic(F.lit(-800.0)).alias("a"), E.logistic(F.lit(800.0)).alias("b")).first()
    assert r.p == [1.0, 0.0, 0.0] and r.l == 1000.0 and r.a == 0.0 and r.b == 1.0


def test_influence_of_many_classes_takes_no_product_over_all_indices(spark):
    import time

    rng = np.random.default_rng(0)
    X, y = rng.normal(size=(400, 10)), rng.integers(0, 10, 400)
    df = spark.createDataFrame([(i, [float(v) for v in x], int(c)) for i, (x, c) in enumerate(zip(X, y))], "id long, x array<double>, y int").coalesce(1)
    m = L.LinearModel(rng.normal(size=(10, 10)).tolist(), [0.0] * 10, "log_loss", 1.0)
    inv = np.linalg.pinv(L.hessian(df, m), hermitian=True)
    began = time.perf_counter()
    got = {r.id: r.self_influence for r in L.influence(df, m).collect()}
    assert time.perf_counter() - began < 20  # 4e10 products otherwise
    p, g, Xt = m.batch(X, y)
    grad = np.einsum("nd,nk->ndk", Xt, g).reshape(400, -1)
    assert np.allclose([got[i] for i in range(400)], -np.einsum("np,np->n", grad @ inv, grad))
