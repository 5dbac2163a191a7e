"""Training stages and how they are had.

A stage is a model with the score methods of a linear model. :func:`staged_fit`
trains up to each stage; :func:`staged_predict` takes the stages out of one
fitted model. Both are registries by type, open to more through ``register``;
a probe needs nothing of its own, since every stage scores rows by columns.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import singledispatch

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trustloom.functions import expr as E
from trustloom.operators.linear import LinearModel, fit_logistic_stages
from trustloom.sources.store import stored


@singledispatch
def staged_fit(estimator, df: DataFrame) -> Sequence:
    """The models of an estimator's training stages on (id, x, y)."""
    if callable(estimator):
        return estimator(df)
    raise NotImplementedError(f"no staged fit for {type(estimator).__name__}")


@singledispatch
def staged_predict(model) -> Sequence:
    """The stages within a fitted model."""
    raise NotImplementedError(f"no stages within a {type(model).__name__}")


class Scores:
    """Score columns of a model with one output from its ``margin(x)``: at least zero means class 1."""

    outputs = 1

    def margin(self, x: Column) -> Column:
        raise NotImplementedError

    def decision(self, x: Column) -> Column:
        return F.array(self.margin(x))

    def logits(self, x: Column) -> Column:
        return E.let(self.margin(x), lambda m: F.array(-m, m))

    def probabilities(self, x: Column) -> Column:
        return E.let(E.logistic(self.margin(x)), lambda p: F.array(1.0 - p, p))

    def predictions(self, x: Column) -> Column:
        return (self.margin(x) > 0).cast("int")

    def score(self, source: str, x: Column) -> Column:
        of = {"probabilities": self.probabilities, "logits": self.logits, "scores": self.logits, "predictions": self.predictions}
        if source not in of:
            raise ValueError(f"{type(self).__name__} has no {source}")
        return of[source](x)


class Given(Scores):
    """A model whose margin is there already, which otherwise scores as ``like`` does."""

    def __init__(self, margin: Column, like: Scores) -> None:
        self._margin, self._like = margin, like

    def margin(self, x: Column) -> Column:
        return self._margin

    def predictions(self, x: Column) -> Column:
        return self._margin if getattr(self._like, "loss", None) == "squared" else super().predictions(x)


class Prefixes(list):
    """Stages that are the prefixes of one sum, ``whole``, which has a ``base`` and ``steps`` of x."""

    def __init__(self, stages: Sequence, whole) -> None:
        super().__init__(stages)
        self.whole = whole


def running(base: float, steps: Column) -> Column:
    """The sums of the base and the first 1, 2, .. steps."""
    start = F.struct(F.lit(float(base)).alias("sum"), F.array().cast("array<double>").alias("all"))
    add = lambda a, v: F.struct((a["sum"] + v).alias("sum"), F.array_append(a["all"], a["sum"] + v).alias("all"))
    return F.aggregate(steps, start, add, lambda a: a["all"])


# Gradient descent (S05) ------------------------------------------------------------------------------


@dataclass
class GradientDescent:
    """A logistic model by full-batch steps; a stage is a step."""

    epochs: int = 5
    rate: float = 1.0
    classes: int = 2
    regul: float = 0.0

    def fit(self, df: DataFrame) -> LinearModel:
        return fit_logistic_stages(df, self.epochs, self.rate, self.classes, regul=self.regul)[-1]


@staged_fit.register
def _(estimator: GradientDescent, df: DataFrame):
    return fit_logistic_stages(df, estimator.epochs, estimator.rate, estimator.classes, regul=estimator.regul)


# Boosted stumps (S04) --------------------------------------------------------------------------------


@dataclass
class StumpSum(Scores):
    """A fitted sum of one-feature stumps on 0/1 features: (feature, weight) in order of boosting."""

    stumps: list[tuple[int, float]] = field(default_factory=list)
    base: float = 0.0

    def steps(self, x: Column) -> Column:
        """What each stump adds."""
        return E.let(x, lambda x: F.array(*[F.lit(a) * (2.0 * F.get(x, F.lit(j)) - 1.0) for j, a in self.stumps]))

    def margin(self, x: Column) -> Column:
        return E.total(self.steps(x)) if self.stumps else F.lit(0.0)


@dataclass
class BoostedStumps:
    """AdaBoost of stumps: one aggregation a round over weights that follow from the rounds before."""

    rounds: int = 5

    def fit(self, df: DataFrame) -> StumpSum:
        """Features and weights are stored, so that a round reads neither texts nor the stumps so far."""
        first = df.select("x").first()
        d, model = len(first["x"]) if first else 0, StumpSum()
        rows = stored(df.select("x", (2.0 * F.col("y") - 1.0).alias("s"), F.lit(1.0).alias("w")), "stumps") if d else None
        for n in range(self.rounds if d else 0):
            sums = rows.agg(F.sum("w").alias("all"), *[F.sum(F.col("w") * F.col("s") * (2.0 * F.get("x", F.lit(j)) - 1.0)).alias(f"c{j}") for j in range(d)]).first()
            edge = [sums[f"c{j}"] / sums["all"] for j in range(d)]
            j = max(range(d), key=lambda k: abs(round(edge[k], 12)))
            r = min(max(edge[j], -1 + 1e-9), 1 - 1e-9)
            model.stumps.append((j, 0.5 * math.log((1 + r) / (1 - r))))
            if n + 1 < self.rounds:
                step = F.lit(model.stumps[-1][1]) * (2.0 * F.get("x", F.lit(j)) - 1.0)
                rows = stored(rows.withColumn("w", F.col("w") * F.exp(-F.col("s") * step)), "stumps")
        return model


@staged_predict.register
def _(model: StumpSum):
    return Prefixes([StumpSum(model.stumps[:k]) for k in range(1, len(model.stumps) + 1)], model)


@staged_fit.register
def _(estimator: BoostedStumps, df: DataFrame):
    # Boosting is the same up to any round, however many follow.
    return staged_predict(estimator.fit(df))


# Sums of trees (S02, S03, S06, S11 to S14) -----------------------------------------------------------


@dataclass(frozen=True)
class Split:
    """A tree: rows with feature ``at`` up to ``threshold`` go to ``left``; leaves are numbers, and ``value`` is the node's own."""

    at: int
    threshold: float
    left: "Split | float"
    right: "Split | float"
    value: float | None = None


def tree_column(tree: Split | float, x: Column, leaf: Callable[[int, float], float] = lambda k, v: v) -> Column:
    """The value of the leaf that a row falls in, or what ``leaf`` makes of its number (from the left) and value."""
    count = iter(range(1 << 30))

    def of(t):
        if not isinstance(t, Split):
            return F.lit(float(leaf(next(count), t)))
        left = of(t.left)
        return F.when(F.get(x, F.lit(t.at)) <= t.threshold, left).otherwise(of(t.right))

    return of(tree)


def leaves(tree: Split | float) -> int:
    return leaves(tree.left) + leaves(tree.right) if isinstance(tree, Split) else 1


def pruned(tree: Split | float, depth: int) -> Split | float:
    """The tree cut off at a depth; a node that is cut takes its own value, which it must have."""
    if not isinstance(tree, Split):
        return tree
    if depth == 0:
        if tree.value is None:
            raise ValueError("a node without a value of its own can't be a leaf")
        return tree.value
    return Split(tree.at, tree.threshold, pruned(tree.left, depth - 1), pruned(tree.right, depth - 1), tree.value)


@dataclass
class TreeSum(Scores):
    """Weighted trees whose sum is half the log odds, as gradient boosting fits them."""

    trees: list[Split | float]
    weights: list[float]
    base: float = 0.0

    def steps(self, x: Column) -> Column:
        """What each tree adds to the log odds."""
        return E.let(x, lambda x: F.array(*[F.lit(2.0 * w) * tree_column(t, x) for t, w in zip(self.trees, self.weights)]))

    def margin(self, x: Column) -> Column:
        return E.total(self.steps(x)) if self.trees else F.lit(0.0)

    @classmethod
    def of_spark(cls, model) -> "TreeSum":
        """From a boosted classifier of pyspark.ml."""

        def read(node):
            if node.getClass().getSimpleName() == "LeafNode":
                return float(node.prediction())
            s = node.split()
            return Split(int(s.featureIndex()), float(s.threshold()), read(node.leftChild()), read(node.rightChild()))

        return cls([read(t._call_java("rootNode")) for t in model.trees], [float(w) for w in model.treeWeights])


@staged_predict.register
def _(model: TreeSum):
    return Prefixes([TreeSum(model.trees[:k], model.weights[:k]) for k in range(1, len(model.trees) + 1)], model)


@dataclass
class GradientBoosting:
    """Gradient boosted trees of pyspark.ml for two classes; a stage is a prefix of the sequence."""

    rounds: int = 5
    depth: int = 2
    seed: int = 7

    def fit(self, df: DataFrame) -> TreeSum:
        from pyspark.ml.classification import GBTClassifier
        from pyspark.ml.functions import array_to_vector

        rows = df.select(array_to_vector("x").alias("features"), "y")
        return TreeSum.of_spark(GBTClassifier(labelCol="y", maxIter=self.rounds, maxDepth=self.depth, seed=self.seed).fit(rows))


@staged_fit.register
def _(estimator: GradientBoosting, df: DataFrame):
    return staged_predict(estimator.fit(df))


# Pipelines (S01) -------------------------------------------------------------------------------------


@dataclass
class After(Scores):
    """A model on transformed features."""

    model: object
    features: Callable[[Column], Column]

    @property
    def outputs(self):
        return self.model.outputs

    def score(self, source: str, x: Column) -> Column:
        return self.model.score(source, self.features(x))

    def margin(self, x: Column) -> Column:
        return F.get(self.model.decision(self.features(x)), F.lit(0))


def standardised(df: DataFrame) -> Callable[[Column], Column]:
    """A transformer: each feature less its mean, over its standard deviation, from one aggregation."""
    d = len(df.select("x").first()["x"])
    at = [F.get("x", F.lit(j)) for j in range(d)]
    row = df.agg(*[F.avg(a) for a in at], *[F.stddev_pop(a) for a in at]).first()
    mean, scale = E.doubles(row[:d]), E.doubles([s or 1.0 for s in row[d:]])
    return lambda x: F.zip_with(F.zip_with(x, mean, lambda v, m: v - m), scale, lambda v, s: v / s)


@dataclass
class Pipeline:
    """Transformers (frame -> function of the feature column), fitted once in turn, and a last estimator that is staged."""

    steps: list[Callable[[DataFrame], Callable[[Column], Column]]]
    last: object


@staged_fit.register
def _(estimator: Pipeline, df: DataFrame):
    features: Callable[[Column], Column] = lambda x: x
    for step in estimator.steps:
        # The frame's features as they are after the steps so far, evaluated once a row.
        fitted = step(E.held(df, x=features(F.col("x"))))
        features = (lambda inner, outer: lambda x: outer(inner(x)))(features, fitted)
    return [After(m, features) for m in staged_fit(estimator.last, E.held(df, x=features(F.col("x"))))]
