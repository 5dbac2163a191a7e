"""Detectors: named compositions of model, ensemble, probe and aggregate.

``trust_score(df)`` takes (id, x, y) and returns (id, trust), low for suspects.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trustloom.functions import expr as E
from trustloom.functions import probes as P
from trustloom.operators import aggregates as A
from trustloom.operators import linear as L
from trustloom.operators.complexity import TreeComplexity  # noqa: F401  D07
from trustloom.operators.ensembles import IndependentEnsemble, LeaveOneOutEnsemble, NoEnsemble, OutlierEnsemble, ProgressiveEnsemble


@dataclass
class ModelProbingDetector:
    """Any ensemble, probe and aggregate; the sign makes more mean more trust."""

    ensemble: object
    probe: object = "margin"
    aggregate: object = "sum"
    maximize: bool | None = None  #: direction of a probe that is a plain function
    context: dict = field(default_factory=dict)

    def trust_score(self, df: DataFrame) -> DataFrame:
        probe = self.probe if callable(self.probe) and not isinstance(self.probe, P.Probe) else P.check_probe(self.probe)
        aggregate = A.check_aggregate(self.aggregate)
        better = probe.maximize if isinstance(probe, P.Probe) else bool(self.maximize)
        value = aggregate.in_row(F.col("_members")) if hasattr(self.ensemble, "members") else None
        if value is not None:  # all members stand in the row: no shuffle, and null ids stay apart
            out = self.ensemble.members(df, probe, **self.context).select("id", value.alias("value"))
        else:
            out = aggregate.run(self.ensemble.probe(df, probe, **self.context))
        return out.select("id", (F.col("value") * F.lit(float(A.sign(aggregate, better)))).alias("trust"))


@dataclass
class InfluenceDetector:
    """A fitted model, its Hessian, and a column of :func:`linear.influence`."""

    fit: Callable[[DataFrame], L.LinearModel]
    column: str
    maximize: bool

    def trust_score(self, df: DataFrame) -> DataFrame:
        model = self.fit(df)
        rows = L.influence_one(df, model) if model.outputs == 1 else L.influence(df, model)
        return rows.select("id", (F.col(self.column) * F.lit(1.0 if self.maximize else -1.0)).alias("trust"))


def outlier_detector(model=None) -> ModelProbingDetector:
    return ModelProbingDetector(OutlierEnsemble(model=model), P.outliers(), "sum")


def self_influence(fit) -> InfluenceDetector:
    return InfluenceDetector(fit, "self_influence", True)


def cook_distance(fit) -> InfluenceDetector:
    return InfluenceDetector(fit, "cook", False)


def approximate_loo(fit) -> InfluenceDetector:
    return InfluenceDetector(fit, "approximate_loo", True)


def representer(fit) -> ModelProbingDetector:
    return ModelProbingDetector(NoEnsemble(fit), lambda m, x, y: F.array(L.representer(m, x, y)), "sum", maximize=False)


@dataclass
class Agra:
    """Similarity of a row's gradient to the mean gradient."""

    fit: Callable[[DataFrame], L.LinearModel]

    def trust_score(self, df: DataFrame) -> DataFrame:
        return L.grad_similarity(df, self.fit(df)).select("id", F.col("value").alias("trust"))


def classifier(fit) -> ModelProbingDetector:
    return ModelProbingDetector(NoEnsemble(fit), "accuracy", "sum")


def regressor(fit) -> ModelProbingDetector:
    return ModelProbingDetector(NoEnsemble(fit), "l1", "sum")


def small_loss(fit, regression: bool = False) -> ModelProbingDetector:
    return ModelProbingDetector(NoEnsemble(fit), "l2" if regression else "cross_entropy", "sum")


def consensus_consistency(classes: int, n_splits: int = 5, n_repeats: int = 10) -> ModelProbingDetector:
    return ModelProbingDetector(IndependentEnsemble(classes, n_splits, n_repeats), "accuracy", A.oob("mean"))


def confident_learning(classes: int, n_splits: int = 5, n_repeats: int = 10) -> ModelProbingDetector:
    return ModelProbingDetector(IndependentEnsemble(classes, n_splits, n_repeats), P.confidence("probabilities"), A.oob("mean"))


def leave_one_out(classes: int, probe="cross_entropy") -> ModelProbingDetector:
    return ModelProbingDetector(LeaveOneOutEnsemble(classes), probe, A.oob("sum"))


def area_under_margin(stages, steps: int = 1, staging: str = "fit") -> ModelProbingDetector:
    return ModelProbingDetector(ProgressiveEnsemble(stages, steps, staging), "margin", "sum")


def tracin(stages, steps: int = 1) -> ModelProbingDetector:
    return ModelProbingDetector(ProgressiveEnsemble(stages, steps), lambda m, x, y: F.array(m.grad_norm(x, y) if hasattr(m, "grad_norm") else L.grad_norm(m, x, y)), "sum", maximize=False)


def forget_scores(stages, steps: int = 1, staging: str = "fit") -> ModelProbingDetector:
    return ModelProbingDetector(ProgressiveEnsemble(stages, steps, staging), "accuracy", A.FORGET)


def finite_difference_probe(probe: P.Probe, along: list[list[float]], epsilon: float = 0.1):
    """P33 of an inner probe: an array of differences over the directions."""

    def of(m: L.LinearModel, x: Column, y: Column) -> Column:
        return P.finite_differences(lambda v: probe.column(m.score(probe.source, v), y), x, along, epsilon)

    return of


def finite_diff_complexity(fit, along, epsilon: float = 0.1) -> ModelProbingDetector:
    absolute = lambda pairs: A.MEAN.local(F.transform(pairs, lambda p: F.struct(F.abs(p["s"]).alias("s"), p["w"].alias("w"))))
    each = A.Aggregate("mean of abs", lambda s, w: F.try_divide(F.sum(F.abs(s) * w), F.sum(w)), local=absolute)
    return ModelProbingDetector(NoEnsemble(fit), finite_difference_probe(P.margin(), along, epsilon), A.from_axis(F.avg, each), maximize=False)


def _variance_over_stages(stages, probe, steps: int, staging: str) -> ModelProbingDetector:
    return ModelProbingDetector(ProgressiveEnsemble(stages, steps, staging), probe, A.from_axis(F.avg, A.VAR), maximize=False)


def finite_diff_vog(stages, along, epsilon: float = 0.1, steps: int = 1, staging: str = "fit") -> ModelProbingDetector:
    return _variance_over_stages(stages, finite_difference_probe(P.confidence("logits"), along, epsilon), steps, staging)


def finite_diff_volg(stages, along, epsilon: float = 0.1, steps: int = 1, staging: str = "fit") -> ModelProbingDetector:
    return _variance_over_stages(stages, finite_difference_probe(P.cross_entropy(), along, epsilon), steps, staging)


def volg(stages, steps: int = 1) -> ModelProbingDetector:
    return _variance_over_stages(stages, lambda m, x, y: m.grad_x(x, y), steps, "fit")


@dataclass
class StumpComplexity:
    """D07 in closed form for a rule in place of a tree: the leaves of the stump of majorities fitted without the row.

    The stump on the first feature whose split changes the majority has two
    leaves, else one; without row i only i's own cell of the class counts moves.
    """

    classes: int

    def trust_score(self, df: DataFrame) -> DataFrame:
        d = len(df.select("x").first()["x"])
        counts = df.groupBy("y").agg(*[F.sum(F.when(F.get("x", F.lit(j)) > 0.5, 1).otherwise(0)).alias(f"on{j}") for j in range(d)], F.count("*").alias("n")).collect()
        on = {r["y"]: [r[f"on{j}"] for j in range(d)] for r in counts}
        n = {r["y"]: r["n"] for r in counts}
        y = F.col("y")
        useful = F.lit(False)
        for j in range(d):
            here = F.get("x", F.lit(j)) > 0.5
            own = lambda c: F.when(y == c, 1).otherwise(0)
            left = F.array(*[F.lit(on.get(c, [0] * d)[j]) - F.when(here, own(c)).otherwise(0) for c in range(self.classes)])
            right = F.array(*[F.lit(n.get(c, 0) - on.get(c, [0] * d)[j]) - F.when(here, 0).otherwise(own(c)) for c in range(self.classes)])
            useful = useful | ((E.argmax(left) != E.argmax(right)) & (F.array_max(left) > 0) & (F.array_max(right) > 0))
        return df.select("id", F.when(useful, 2.0).otherwise(1.0).alias("trust"))
