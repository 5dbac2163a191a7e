"""Models of pyspark.ml: parameter counts, linearisation, leaf features; and the metrics."""

from __future__ import annotations

from functools import singledispatch

from pyspark.ml import PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassificationModel,
    DecisionTreeClassifier,
    GBTClassificationModel,
    LogisticRegression,
    LogisticRegressionModel,
    MultilayerPerceptronClassifier,
    RandomForestClassificationModel,
)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trustloom.operators import linear as L
from trustloom.operators import networks
from trustloom.operators import staged as S
from trustloom.operators import training
from trustloom.operators import trees as T
from trustloom.operators.committees import Committee
from trustloom.plans import base as B
from trustloom.sources.store import before, ranged

# Parameters of a model, by its type; open to more through register() --------------------------


@singledispatch
def parameter_count(model) -> int:
    raise NotImplementedError(f"no parameter count for {type(model).__name__}")


@parameter_count.register
def _(model: L.LinearModel) -> int:
    return model.parameter_count()


@parameter_count.register
def _(model: PipelineModel) -> int:
    return parameter_count(model.stages[-1])


@parameter_count.register
def _(model: LogisticRegressionModel) -> int:
    import numpy as np

    return int(np.count_nonzero(model.coefficientMatrix.toArray())) + int(np.count_nonzero(model.interceptVector.toArray()))


@parameter_count.register
def _(model: DecisionTreeClassificationModel) -> int:
    return (model.numNodes + 1) // 2


@parameter_count.register(RandomForestClassificationModel)
@parameter_count.register(GBTClassificationModel)
def _(model) -> int:
    return sum((t.numNodes + 1) // 2 for t in model.trees)


@parameter_count.register
def _(model: S.TreeSum) -> int:
    return sum(S.leaves(t) for t in model.trees)


@parameter_count.register(T.TreeClasses)
@parameter_count.register(T.TreeMeans)
@parameter_count.register(T.BoostedTrees)
@parameter_count.register(Committee)
@parameter_count.register(training.Network)
def _(model) -> int:
    return model.parameter_count()


@parameter_count.register
def _(model: S.StumpSum) -> int:
    return 2 * len(model.stumps)


# Linearisation: a fitted model and its rows as (linear model, rows with new features) ----------------


@singledispatch
def linearize(model, df: DataFrame) -> tuple[L.LinearModel, DataFrame]:
    raise NotImplementedError(f"{type(model).__name__} can't be linearised")


@linearize.register
def _(model: L.LinearModel, df: DataFrame):
    return model, df


@linearize.register
def _(model: PipelineModel, df: DataFrame):
    """All steps but the last make the features."""
    rows = df
    for s in model.stages[:-1]:
        rows = s.transform(rows)
    return linearize(model.stages[-1], rows)


@linearize.register
def _(model: LogisticRegressionModel, df: DataFrame):
    """The penalty is the regularisation times the rows."""
    if model.getElasticNetParam():
        raise NotImplementedError("only an L2 penalty can be linearised")
    return L.LinearModel(model.coefficientMatrix.toArray().tolist(), model.interceptVector.toArray().tolist(), "log_loss", model.getRegParam() * df.count()), df


@linearize.register
def _(model: training.Network, df: DataFrame):
    return training.linearised(model, df)


@linearize.register(DecisionTreeClassificationModel)
@linearize.register(RandomForestClassificationModel)
@linearize.register(GBTClassificationModel)
def _(model, df: DataFrame):
    """One-hot leaves as features of a logistic surrogate."""
    rows = tree_projections(model, df)
    k = df.agg(F.max("y")).first()[0] + 1
    fitted = LogisticRegression(featuresCol="f", labelCol="y", regParam=0.01, standardization=False, maxIter=50, family="binomial" if k == 2 else "multinomial").fit(rows.withColumn("f", array_to_vector("x")))
    return linearize(fitted, rows)


def leaf_features(model: S.TreeSum, df: DataFrame) -> DataFrame:
    """F01 as columns: x becomes the one-hot leaf of every tree, leaves from the left."""
    place = [S.tree_column(t, F.col("x"), lambda k, v: k) for t in model.trees]
    hot = [F.transform(F.sequence(F.lit(0), F.lit(S.leaves(t) - 1)), (lambda p: lambda c: F.when(c == p, 1.0).otherwise(0.0))(p)) for t, p in zip(model.trees, place)]
    return df.withColumn("x", F.concat(*hot))


def tree_projections(model, df: DataFrame) -> DataFrame:
    """x becomes the one-hot leaf of every tree; a leaf that no tree has gives zeros."""
    model.setLeafCol("_leaf")
    trees = model.trees if hasattr(model, "trees") else [model]
    sizes = [(t.numNodes + 1) // 2 for t in trees]
    leaf = vector_to_array("_leaf") if hasattr(model, "trees") else F.array("_leaf")
    rows = model.transform(_features(df)).withColumn("_l", leaf)
    hot = [_hot(k, n) for k, n in enumerate(sizes)]
    return rows.select("id", F.concat(*hot).alias("x"), "y")


def _hot(k: int, n: int):
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda c: F.when(c == F.get("_l", F.lit(k)), 1.0).otherwise(0.0))


def _features(df: DataFrame) -> DataFrame:
    return df.withColumn("features", array_to_vector("x"))


# Metrics ---------------------------------------------------------------------------------------


def roc_auc(df: DataFrame, score: str, good: str) -> DataFrame:
    """auc: the share of (good, bad) pairs in order, ties half, by sums over distinct scores.

    Ranks are running sums over counts of distinct scores in two steps: ranges of
    about as many scores, then inside each, so that no task sorts all rows.
    """
    per = df.groupBy(F.col(score).alias("s")).agg(F.count_if(F.col(good)).alias("g"), F.count_if(~F.col(good)).alias("b"))
    per = ranged(per, "s", name="k")
    buckets = per.groupBy("k").agg(F.sum("b").alias("n"))
    buckets = buckets.select("k", before(buckets, "n", "k").alias("before"))  # a row a range
    inside = F.coalesce(F.sum("b").over(Window.partitionBy("k").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = per.withColumn("inside", inside).join(F.broadcast(buckets), "k")
    return rows.agg((F.sum(F.col("g") * (F.col("before") + F.col("inside") + F.col("b") / 2)) / (F.sum("g") * F.sum("b"))).alias("auc"))


def balanced_accuracy(df: DataFrame, y: str = "y", prediction: str = "prediction") -> DataFrame:
    per = df.groupBy(y).agg(F.avg((F.col(y) == F.col(prediction)).cast("double")).alias("r"))
    return per.agg(F.avg("r").alias("balanced_accuracy"))


# Queries ---------------------------------------------------------------------------------------

SEED = 7


def _tree(rows: DataFrame, depth: int = 4):
    return DecisionTreeClassifier(labelCol="y", maxDepth=depth, seed=SEED).fit(rows)


def _two(spark, sf) -> DataFrame:
    """English or not: what binary learners need."""
    return _features(B.languages(spark, sf).withColumn("y", (F.col("y") == 1).cast("int")).select("id", "x", "y"))


def z04_logistic(spark, sf):
    rows = _two(spark, sf)
    model, rows = linearize(LogisticRegression(labelCol="y", regParam=0.01, standardization=False).fit(rows), rows)
    return L.influence_one(rows, model).select("id", "self_influence")


def z07_trees(spark, sf):
    rows = _two(spark, sf)
    model, rows = linearize(_tree(rows, 3), rows)
    return L.influence(rows, model).select("id", "cook")


def _mlp(rows: DataFrame) -> networks.Mlp:
    sizes = [7, 5, 4]
    return networks.Mlp.of_spark(MultilayerPerceptronClassifier(labelCol="y", layers=sizes, seed=SEED, maxIter=30).fit(rows).weights.toArray(), sizes)


def z05_mlp(spark, sf):
    rows = _features(B.languages(spark, sf))
    mlp = _mlp(rows)
    hidden = networks.neural_random_features(rows, mlp, ("y",)).withColumnRenamed("features", "x")
    return L.influence(hidden, mlp.linearised(1.0)).select("id", "self_influence", "approximate_loo")


QUERIES = {
    "Z04_logistic_linearised": z04_logistic,
    "Z05_mlp_linearised": z05_mlp,
    "Z07_tree_linearised": z07_trees,
}
