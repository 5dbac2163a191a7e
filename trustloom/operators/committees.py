"""Bagging and AdaBoost of any base model that honours the column sample_quality (P40d, S04)."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trustloom.functions import expr as E
from trustloom.operators.staged import staged_fit, staged_predict
from trustloom.sources.store import stored

#: Distribution of how often a bag draws a row: Poisson of mean 1.
_POISSON = [math.exp(-1) * sum(1 / math.factorial(i) for i in range(k + 1)) for k in range(9)]


def poisson_draws(member: int, seed: int = 7) -> Column:
    """How often a member of a bag draws a row, from a hash of its id: the same wherever and whenever it is asked for."""
    u = F.pmod(F.xxhash64(F.lit(seed), F.lit(member), F.col("id")), F.lit(1 << 53)) / F.lit(float(1 << 53))
    out = F.lit(float(len(_POISSON)))
    for k in range(len(_POISSON) - 1, -1, -1):
        out = F.when(u < _POISSON[k], float(k)).otherwise(out)
    return out


def _times(a: Column, w: float) -> Column:
    return F.transform(a, lambda v: v * F.lit(float(w)))


@dataclass
class Committee:
    """Members whose shares are averaged, or whose votes are added up (``votes``), by weight."""

    members: list
    weights: list[float]
    classes: int
    votes: bool = False

    @property
    def outputs(self) -> int:
        return self.classes

    def decision(self, x: Column) -> Column:
        total = None
        for m, w in zip(self.members, self.weights):
            own = E.one_hot(m.score("predictions", x), self.classes) if self.votes else m.score("probabilities", x)
            own = _times(own, w)
            total = own if total is None else F.zip_with(total, own, lambda a, b: a + b)
        return total

    def score(self, source: str, x: Column) -> Column:
        if source in ("scores", "logits"):
            return self.decision(x)
        return E.argmax(self.decision(x)) if source == "predictions" else E.shares(self.decision(x))

    def parameter_count(self) -> int:
        """P40d: the sum over the members."""
        from trustloom.plans.learners import parameter_count

        return sum(parameter_count(m) for m in self.members)


@dataclass
class Bagging:
    """Models of draws of the rows. ``draws`` of a member is a column: how often it draws a row."""

    base: Callable[[DataFrame], object]
    members: int = 10
    classes: int = 2
    draws: Callable[[int], Column] = poisson_draws

    def fit(self, df: DataFrame) -> Committee:
        rows = stored(df, "bag")
        models = []
        for m in range(self.members):
            drawn = E.held(rows, sample_quality=self.draws(m).cast("double"))
            models.append(self.base(drawn.filter("sample_quality > 0")))
        return Committee(models, [1.0] * self.members, self.classes)


@dataclass
class AdaBoost:
    """Boosting by weights (SAMME) of any base classifier; a stage is a prefix.

    Rows are stored with their weights after each round, so a round scores one
    model. It ends early at a model without errors, or no better than chance.
    """

    base: Callable[[DataFrame], object]
    rounds: int = 5
    classes: int = 2

    def fit(self, df: DataFrame) -> Committee:
        w = F.col("sample_quality")
        rows = stored(df.withColumn("sample_quality", w.cast("double") if "sample_quality" in df.columns else F.lit(1.0)), "boost")
        out = Committee([], [], self.classes, True)
        for _ in range(self.rounds):
            model = self.base(rows)
            judged = E.held(rows, wrong=(model.score("predictions", F.col("x")) != F.col("y")).cast("double"))
            sums = judged.agg(F.sum(w * F.col("wrong")).alias("wrong"), F.sum(w).alias("all")).first()
            error = (sums["wrong"] or 0.0) / (sums["all"] or 1.0)
            if error >= 1 - 1 / self.classes:
                if not out.members:
                    out = Committee([model], [1.0], self.classes, True)
                break
            error = max(error, 1e-10)
            alpha = math.log((1 - error) / error) + math.log(self.classes - 1)
            out.members.append(model)
            out.weights.append(alpha)
            if error <= 1e-10:
                break
            # Weights keep their sum near the rows', so that they neither vanish nor overflow.
            scale = 1 / (1 + error * (math.exp(alpha) - 1))
            rows = stored(judged.withColumn("sample_quality", w * F.exp(F.lit(alpha) * F.col("wrong")) * F.lit(scale)).drop("wrong"), "boost")
        return out


@staged_predict.register
def _(model: Committee) -> Sequence[Committee]:
    return [Committee(model.members[:k], model.weights[:k], model.classes, model.votes) for k in range(1, len(model.members) + 1)]


@staged_fit.register
def _(estimator: AdaBoost, df: DataFrame):
    return staged_predict(estimator.fit(df))
