"""Trees from histograms against brute force: fits, pruning paths, forests, boosting, and trees without each row."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trustloom.functions import probes as P
from trustloom.operators import complexity
from trustloom.operators import detectors as T
from trustloom.operators import ensembles as N
from trustloom.operators import linear as L
from trustloom.operators import trees
from trustloom.operators.committees import AdaBoost, Bagging
from trustloom.operators.staged import staged_fit, staged_predict
from trustloom.plans.learners import parameter_count


def frame(spark, X, y, kind="int"):
    return spark.createDataFrame([(i, [None if v is None else float(v) for v in x], y[i].item()) for i, x in enumerate(np.asarray(X, object))], f"id long, x array<double>, y {kind}")


def brute(X, y, depth, purity):
    """(feature, threshold, left, right) or a leaf's rows, the best cut first in order of features and thresholds."""

    def grow(rows, at):
        best = None
        if at != depth and len(np.unique(y[rows])) > 1:
            for j in range(X.shape[1]):
                v = np.unique(X[rows, j])
                for t in (v[1:] + v[:-1]) / 2:
                    a, b = rows[X[rows, j] <= t], rows[X[rows, j] > t]
                    gain = round(purity(y[a]) + purity(y[b]) - purity(y[rows]), 9)
                    if best is None or gain > best[0]:
                        best = (gain, j, a, b)
        return rows if best is None else (best[1], grow(best[2], at + 1), grow(best[3], at + 1))

    return grow(np.arange(len(y)), 0)


def gini(y):
    return (np.bincount(y) ** 2).sum() / len(y)


def parts(tree, k=0):
    """A tree in the form of :func:`brute`, leaves as their sums."""
    n = tree.nodes[k]
    return tuple(n.sums) if n.at < 0 else (n.at, parts(tree, n.left), parts(tree, n.right))


def summed(node, y, of):
    return of(y[node]) if isinstance(node, np.ndarray) else (node[0], summed(node[1], y, of), summed(node[2], y, of))


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(4)
    X = np.column_stack([rng.normal(size=240).round(2), rng.integers(0, 5, 240), rng.integers(0, 2, 240)])
    y = ((X[:, 0] > 0.1).astype(int) + (X[:, 1] > 2) + (rng.uniform(size=240) < 0.1)).astype(int) % 3
    return X, y, frame(spark, X, y).repartition(5).cache()


@pytest.mark.parametrize("depth", [1, 3, None])
def test_classes_are_split_as_by_brute_force(data, depth):
    X, y, df = data
    tree = trees.DecisionTree(3, depth).grow(df)[0]
    assert parts(tree) == summed(brute(X, y, depth, gini), y, lambda v: tuple(np.bincount(v, minlength=3).astype(float)))
    model = trees.TreeClasses([tree], 3)
    got = df.select("y", model.probabilities(F.col("x")).alias("p"), model.score("predictions", F.col("x")).alias("q")).collect()
    assert all(abs(sum(r.p) - 1) < 1e-9 and r.q == int(np.argmax(r.p)) for r in got)
    if depth is None:
        assert all(r.q == r.y for r in got) or len({tuple(x) for x in X.tolist()}) < len(X)


def test_targets_are_split_as_by_brute_force(spark, data):
    X, _, _ = data
    y = (3 * X[:, 0] + X[:, 1]).round(1)
    df = frame(spark, X, y, "double")
    tree = trees.DecisionTree(None, 3).grow(df)[0]
    want = summed(brute(X, y, 3, lambda v: v.sum() ** 2 / len(v)), y, lambda v: (len(v), v.sum()))

    def close(a, b):
        return np.allclose(a[:2], b) if len(b) == 2 else a[0] == b[0] and close(a[1], b[1]) and close(a[2], b[2])

    assert close(parts(tree), want)
    mean = trees.TreeMeans([tree]).predictions(F.col("x"))
    assert df.select((F.col("y") - mean).alias("e")).agg(F.avg("e")).first()[0] == pytest.approx(0)


def test_features_of_many_values_are_cut_at_quantiles(spark):
    x = np.random.default_rng(0).permutation(1000).astype(float)
    df = frame(spark, x[:, None], (x > 500).astype(int))
    edges = trees.thresholds(df, 16)
    assert len(edges[0]) == 15 and np.allclose(np.diff(edges[0]), 62.5, atol=2)
    tree = trees.DecisionTree(2, bins=16).grow(df)[0]
    assert tree.nodes[0].at == 0 and abs(tree.nodes[0].threshold - 500) < 40


def test_nulls_go_left_and_empty_tables_have_one_leaf(spark):
    df = frame(spark, [[None], [None], [1.0], [2.0], [float("nan")]], np.array([0, 0, 1, 1, 1]))
    model = trees.DecisionTree(2).fit(df)
    assert [r.q for r in df.select(model.score("predictions", F.col("x")).alias("q")).collect()] == [0, 0, 1, 1, 1]
    assert trees.DecisionTree(2).grow(df.limit(0))[0].leaves() == 1
    assert trees.Boosting(2).fit(df.limit(0)).parameter_count() == 2


def naive_path(tree):
    """Subtrees by price: of all subtrees the one of least loss + price * leaves, the smallest of ties."""

    def subtrees(k):
        n = tree.nodes[k]
        out = [(tree.criterion.loss(n.sums) / sum(tree.nodes[0].sums), 1)]
        if n.at >= 0:
            out += [(a + c, b + d) for a, b in subtrees(n.left) for c, d in subtrees(n.right)]
        return out

    return lambda price: min((round(a + price * b, 9), b) for a, b in subtrees(0))[1]


def test_pruning_path(data):
    _, _, df = data
    tree = trees.DecisionTree(3, 3).grow(df)[0]
    path, best = tree.pruning_path(), naive_path(tree)
    prices, leaves = [p for p, _ in path], [t.leaves() for _, t in path]
    assert leaves[0] == 1 and leaves == sorted(set(leaves)) and prices == sorted(prices, reverse=True) and prices[-1] == 0
    for (p, t), before in zip(path, [prices[0] + 1, *prices]):
        assert best(p + 1e-7) == best((p + before) / 2) == t.leaves()
    stages = staged_fit(trees.DecisionTree(3, 3), df)
    assert [parameter_count(m) for m in stages] == leaves
    # A node that is cut keeps its own share.
    assert stages[0].trees[0].nodes[0].sums == tree.nodes[0].sums


def test_forests_and_extra_trees(data):
    X, y, df = data
    for make in (trees.random_forest, trees.extra_trees):
        model = make(3, 7, depth=5).fit(df)
        right = df.select((model.score("predictions", F.col("x")) == F.col("y")).cast("double").alias("r")).agg(F.avg("r")).first()[0]
        assert right > 0.8 and len({str(parts(t)) for t in model.trees}) > 1
        again = make(3, 7, depth=5).fit(df.repartition(2))
        assert [parts(t) for t in again.trees] == [parts(t) for t in model.trees]
    key = np.arange(20_000) * 7919
    drawn = trees.draws(key, 3)
    assert abs(drawn.mean() - 1) < 0.03 and abs((drawn == 0).mean() - np.exp(-1)) < 0.02 and (drawn != trees.draws(key, 4)).any()


@pytest.mark.parametrize("loss", ["log_loss", "squared"])
def test_boosting_takes_newton_steps(spark, data, loss):
    X, y, _ = data
    y = (y == 1).astype(int) if loss == "log_loss" else (X[:, 0] * 2).round(2)
    df = frame(spark, X, y, "int" if loss == "log_loss" else "double")
    model = trees.Boosting(4, 2, 0.5, loss).fit(df)
    m = np.full(len(y), np.log(y.mean() / (1 - y.mean())) if loss == "log_loss" else y.mean())
    margins = np.stack([np.array([r.m for r in df.select("id", s.margin(F.col("x")).alias("m")).orderBy("id").collect()]) for s in staged_predict(model)])
    for tree, got in zip(model.trees, margins):
        p = 1 / (1 + np.exp(-m)) if loss == "log_loss" else m
        g, h = p - y, p * (1 - p) if loss == "log_loss" else np.ones(len(y))
        at = trees.place(tree.arrays(), X, False)
        for k in np.unique(at):
            m = np.where(at == k, m - 0.5 * g[at == k].sum() / (h[at == k].sum() + 1), m)
        assert np.allclose(got, m)
    for detector in (T.area_under_margin, T.forget_scores) if loss == "log_loss" else ():
        fit = {r.id: r.trust for r in detector(trees.Boosting(4, 2, 0.5), 1, "fit").trust_score(df).collect()}
        assert {r.id: r.trust for r in detector(trees.Boosting(4, 2, 0.5), 1, "predict").trust_score(df).collect()} == pytest.approx(fit)


def test_committees_of_any_base(spark, data):
    X, y, df = data
    bayes = lambda rows: L.fit_naive_bayes(rows, 3)[0]
    hot = df.select("id", F.transform("x", lambda v: (v > 0.5).cast("double")).alias("x"), "y")
    bag = Bagging(bayes, 4, 3).fit(hot)
    assert parameter_count(bag) == sum(parameter_count(m) for m in bag.members) and len({str(m.coef) for m in bag.members}) == 4
    p = hot.select(bag.score("probabilities", F.col("x")).alias("p")).collect()
    assert all(abs(sum(r.p) - 1) < 1e-9 for r in p)
    boosted = AdaBoost(trees.DecisionTree(3, 1).fit, 6, 3)
    right = [df.select((s.score("predictions", F.col("x")) == F.col("y")).cast("double").alias("r")).agg(F.avg("r")).first()[0] for s in staged_fit(boosted, df)]
    assert right[-1] > right[0] and len(right) == 6
    # A model without errors ends the rounds.
    assert len(AdaBoost(trees.DecisionTree(2).fit, 5).fit(frame(spark, [[0], [1], [2]], np.array([0, 1, 1]))).members) == 1


# Without each row ------------------------------------------------------------------------------------


def test_gini_leaves_of_any_numbers():
    one = np.eye(2)
    assert complexity.gini_leaves([[0], [1], [2], [3]], one[[0, 0, 1, 1]]) == 2
    assert complexity.gini_leaves([[0.1], [0.2], [0.3], [0.4]], one[[0, 1, 0, 1]]) == 4
    assert complexity.gini_leaves([[0, 0], [0, 1], [1, 0], [1, 1]], one[[0, 1, 1, 0]]) == 4  # the first cut gains nothing
    assert complexity.gini_leaves([[1], [1]], one[[0, 1]]) == 1


def count(node):
    return 1 if isinstance(node, np.ndarray) else count(node[1]) + count(node[2])


@pytest.mark.parametrize("depth, local", [(None, 4000), (3, 4000), (None, 8), (4, 15)])
def test_leaves_without_each_row(spark, depth, local):
    rng = np.random.default_rng(11)
    X = np.column_stack([rng.normal(size=70).round(1), rng.integers(0, 3, 70), rng.integers(0, 2, 70)])
    y = rng.integers(0, 3, 70)
    X[60:], y[60:] = X[:10], y[:10]  # rows that repeat
    df = frame(spark, X, y)
    got = {r.id: r.trust for r in complexity.TreeComplexity(depth, local=local).trust_score(df).collect()}
    keep = lambda i: np.arange(70) != i
    assert got == {i: count(brute(X[keep(i)], y[keep(i)], depth, gini)) for i in range(70)}


def test_complexity_of_a_line_and_of_nothing(spark):
    df = frame(spark, np.arange(20.0)[:, None], (np.arange(20) > 10).astype(int))
    assert {r.trust for r in complexity.TreeComplexity().trust_score(df).collect()} == {2.0}
    assert complexity.TreeComplexity().trust_score(df.limit(0)).count() == 0


def test_planted_flips_have_simple_trees_without_them(spark):
    rng = np.random.default_rng(2)
    X = np.concatenate([rng.normal(c, 0.5, (100, 2)) for c in (0, 6)])
    y = np.repeat([0, 1], 100)
    y[[7, 150]] = 1 - y[[7, 150]]
    scores = complexity.TreeComplexity().trust_score(frame(spark, X, y)).orderBy("trust").limit(2).collect()
    assert {r.id for r in scores} == {7, 150}


def test_boosted_stages_probe(data):
    _, _, df = data
    two = df.withColumn("y", (F.col("y") == 1).cast("int"))
    out = N.ProgressiveEnsemble(trees.Boosting(3, 1), 2).probe(two, P.margin())
    assert out.select("member").distinct().count() == 2 and out.count() == 480
