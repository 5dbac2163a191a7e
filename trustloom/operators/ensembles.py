"""Ensembles: which fitted members look at which rows.

Members are rows of a small table of parameters that is sent to all tasks; its
size is members times parameters, set by the caller and not by the data. The
result is the probe stream (id, member, oob, weight, score), or the same as an
array in each row.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trustloom.functions import expr as E
from trustloom.functions.probes import Probe
from trustloom.operators.linear import LinearModel, fit_logistic_stages, fit_naive_bayes
from trustloom.operators.staged import Given, running, staged_fit, staged_predict
from trustloom.sources.store import stored

STREAM = ("id", "member", "oob", "weight", "score")


def member_score(m: LinearModel, probe: Probe | Callable, x: Column, y: Column, **context) -> Column:
    """A member's probe values as an array; ``probe`` may also be a function of (model, x, y) that gives one."""
    if isinstance(probe, Probe):
        return F.array(probe.column(m.score(probe.source, x), y, **context).cast("double"))
    return probe(m, x, y)


def members(df: DataFrame, models: dict[int, LinearModel], probe: Probe | Callable, oob: Column | None = None, **context) -> DataFrame:
    """``df`` with ``_members``: an array of (member, oob, weight, score) in the order of members.

    Stages of a sum (:class:`staged.Prefixes`) are had from one running sum of
    its terms, so that many stages cost as much as the last one alone.
    """
    x, y = F.col("x"), F.col("y")
    out = lambda k, score: F.struct(k.cast("int").alias("member"), (oob if oob is not None else F.lit(False)).alias("oob"), F.lit(1.0).alias("weight"), score.alias("score"))
    whole = getattr(models, "whole", None)
    if whole is None or not isinstance(probe, Probe):
        rows = F.array(*[out(F.lit(k), member_score(m, probe, x, y, **context)) for k, m in models.items()])
        return E.held(df, _members=rows)
    sums = E.held(df, _sums=running(whole.base, whole.steps(x)))
    kept = F.array(*[F.lit(k) for k in models])
    rows = F.transform(kept, lambda k: out(k, member_score(Given(F.get("_sums", k), whole), probe, x, y, **context)))
    return E.held(sums, _members=rows).drop("_sums")


def stream(df: DataFrame, models: dict[int, LinearModel], probe: Probe | Callable, oob: Column | None = None, **context) -> DataFrame:
    """All members on all rows: the array of :func:`members`, exploded."""
    return members(df, models, probe, oob, **context).select("id", F.explode("_members").alias("_m")).select("id", "_m.member", "_m.oob", "_m.weight", "_m.score")


class Stages(dict):
    """Models by member, those kept of a sequence of stages, with the sum they are prefixes of, if any."""

    def __init__(self, models: Sequence, steps: int) -> None:
        super().__init__({k: m for k, m in enumerate(models) if k % steps == 0})
        self.whole = getattr(models, "whole", None)


#: Modulus of the hash that folds are dealt by, and rows of a class that one task deals, about.
PRIME = (1 << 31) - 1
#: Factor of the hash in the first repeat, and what each repeat adds: large, so that neighbouring ids part.
FACTOR, STRIDE = 1_103_515_245, 620_089_847
DEAL_ROWS = 50_000


def _hash(id_: str, repeat: Column) -> Column:
    return F.pmod(F.pmod(F.col(id_), F.lit(PRIME)) * F.pmod(F.lit(FACTOR) + F.lit(STRIDE) * repeat.cast("long"), F.lit(PRIME)) + (F.lit(13) + repeat), F.lit(PRIME))


def folds(df: DataFrame, k: int, repeats: int = 1, stratify: str | None = "y", id_: str = "id") -> DataFrame:
    """Each row once a repeat, with repeat and fold (0 to k - 1): rows of a class in the order of a hash, dealt in turn.

    The window is by repeat, class and a bucket of the hash; buckets are as many
    as the rows ask for, so a class that holds a third of all rows is dealt by
    many tasks. A bucket's folds differ by one row at most.
    """
    buckets = max(1, df.count() // DEAL_ROWS)
    rows = df.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    rows = rows.withColumn("_h", _hash(id_, F.col("repeat")))
    keys = ["repeat", *([stratify] if stratify else []), F.floor(F.col("_h") * F.lit(buckets) / F.lit(PRIME))]
    w = Window.partitionBy(*keys).orderBy("_h", F.col(id_))
    return rows.withColumn("fold", F.pmod(F.row_number().over(w), F.lit(k)).cast("int")).drop("_h")


def shuffle_splits(df: DataFrame, share: float = 0.2, repeats: int = 5, id_: str = "id") -> DataFrame:
    """Independent splits: fold 0 is a repeat's test part, about ``share`` of the rows; fold 1 is the rest."""
    rows = df.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    return rows.withColumn("fold", (_hash(id_, F.col("repeat")) >= F.lit(int(share * PRIME))).cast("int"))


def predefined(column: str) -> Callable[[DataFrame], DataFrame]:
    """Folds that a column of the frame gives."""
    return lambda df: df.withColumns({"repeat": F.lit(0), "fold": F.col(column).cast("int")})


@dataclass
class NoEnsemble:
    """One model on everything."""

    fit: Callable[[DataFrame], LinearModel]

    def members(self, df: DataFrame, probe, **context) -> DataFrame:
        return members(df, {0: self.fit(df)}, probe, **context)

    def probe(self, df: DataFrame, probe, **context) -> DataFrame:
        return stream(df, {0: self.fit(df)}, probe, **context)


@dataclass
class IndependentEnsemble:
    """A model for each fold of each repeat, trained on the repeat's other folds and probed on all rows.

    ``deal`` makes the folds: stratified ones by default, or anything that adds
    repeat and fold; folds from ``k`` on have no model. All repeats are dealt,
    counted and scored together, from rows that are stored once.
    """

    classes: int
    k: int = 5
    repeats: int = 1
    fit: Callable[..., dict[tuple[int, int], LinearModel]] = fit_naive_bayes
    deal: Callable[[DataFrame], DataFrame] | None = None

    def probe(self, df: DataFrame, probe, **context) -> DataFrame:
        deal = self.deal or (lambda rows: folds(rows, self.k, self.repeats))
        rows = stored(deal(df), "folds")
        models = {key: m for key, m in self.fit(rows, self.classes, by="fold", within="repeat").items() if key[1] < self.k}
        x, y, members = F.col("x"), F.col("y"), None
        for r in sorted({r for r, _ in models}):
            own = [(f, m) for (of, f), m in sorted(models.items(), key=lambda x: x[0]) if of == r]
            here = F.array(*[F.struct(F.lit(r * self.k + f).alias("member"), (F.col("fold") == f).alias("oob"), member_score(m, probe, x, y, **context).alias("score")) for f, m in own])
            members = F.when(F.col("repeat") == r, here) if members is None else members.when(F.col("repeat") == r, here)
        return rows.select("id", F.explode(members).alias("_m")).select("id", "_m.member", "_m.oob", F.lit(1.0).alias("weight"), "_m.score")


@dataclass
class LeaveOneOutEnsemble:
    """E03 in closed form: naive Bayes counts less the row's own. One member a row, its own."""

    classes: int
    smoothing: float = 1.0

    def scores(self, df: DataFrame) -> Column:
        d = len(df.select("x").first()["x"])
        rows = {r["y"]: r for r in df.groupBy("y").agg(F.count("*").alias("n"), *[F.sum(F.get("x", F.lit(j))).alias(f"c{j}") for j in range(d)]).collect()}
        out, total = [], sum(r["n"] for r in rows.values()) - 1
        x, s = F.col("x"), self.smoothing
        for c in range(self.classes):
            own = F.when(F.col("y") == c, 1.0).otherwise(0.0)
            n = F.lit(float(rows[c]["n"] if c in rows else 0)) - own
            z = F.log((n + s) / F.lit(total + self.classes * s))
            for j in range(d):
                v = F.get(x, F.lit(j))
                theta = (F.lit(float(rows[c][f"c{j}"] if c in rows else 0)) - own * v + s) / (n + 2 * s)
                z = z + v * F.log(theta) + (1.0 - v) * F.log(1.0 - theta)
            out.append(z)
        return F.array(*out)

    def probe(self, df: DataFrame, probe: Probe, **context) -> DataFrame:
        z = self.scores(df)
        rows = df.withColumn("_z", z)
        s = F.col("_z") if probe.source in ("scores", "logits") else E.softmax(F.col("_z")) if probe.source == "probabilities" else E.argmax(F.col("_z"))
        return rows.select("id", F.col("id").alias("member"), F.lit(True).alias("oob"), F.lit(1.0).alias("weight"), F.array(probe.column(s, F.col("y"), **context).cast("double")).alias("score"))


@dataclass
class ProgressiveEnsemble:
    """A member for each training stage, every ``steps``-th kept.

    With staging "fit", ``stages`` is an estimator that :func:`staged_fit` knows,
    or a function of the frame that gives the stages' models. With "predict" it
    is an estimator with a fit method, or such a function that gives one model:
    it is fitted once and :func:`staged_predict` takes its stages apart.
    """

    stages: object = fit_logistic_stages
    steps: int = 1
    staging: str = "fit"

    def __post_init__(self) -> None:
        if self.staging not in ("fit", "predict"):
            raise ValueError("staging is 'fit' or 'predict'")
        if not isinstance(self.steps, int) or self.steps <= 0:
            raise ValueError("steps is a positive integer")

    def models(self, df: DataFrame) -> Sequence:
        if self.staging == "fit":
            return staged_fit(self.stages, df)
        return staged_predict(self.stages.fit(df) if hasattr(self.stages, "fit") else self.stages(df))

    def members(self, df: DataFrame, probe, **context) -> DataFrame:
        return members(df, Stages(self.models(df), self.steps), probe, **context)

    def probe(self, df: DataFrame, probe, **context) -> DataFrame:
        return stream(df, Stages(self.models(df), self.steps), probe, **context)


@dataclass
class OutlierEnsemble:
    """An outlier model for each class, on its own rows, times the class's share.

    By default a Gaussian of independent features; ``model`` is anything else with
    a fit method that gives a score column, as an isolation forest.
    """

    floor: float = 1e-6
    model: object = None

    def probe(self, df: DataFrame, probe=None, **context) -> DataFrame:
        if self.model is not None:
            return self._by_model(df)
        d = len(df.select("x").first()["x"])
        at = lambda j: F.get("x", F.lit(j))
        moments = df.groupBy("y").agg(
            F.count("*").alias("n"),
            F.array(*[F.avg(at(j)) for j in range(d)]).alias("mean"),
            F.array(*[F.greatest(F.var_pop(at(j)), F.lit(self.floor)) for j in range(d)]).alias("var"),
        )
        total = moments.agg(F.sum("n").alias("total"))
        moments = moments.crossJoin(F.broadcast(total))  # a row a class
        rows = df.join(F.broadcast(moments), "y")
        terms = F.zip_with(F.zip_with("x", "mean", lambda v, m: (v - m) * (v - m)), "var", lambda q, v: q / v + F.log(v))
        density = -0.5 * (E.total(terms) + F.lit(d) * F.log(F.lit(2 * 3.141592653589793)))
        score = density * (F.col("n") / F.col("total"))
        return rows.select("id", F.lit(0).alias("member"), F.lit(False).alias("oob"), F.lit(1.0).alias("weight"), F.array(score).alias("score"))


    def _by_model(self, df: DataFrame) -> DataFrame:
        counts = {r["y"]: r["n"] for r in df.groupBy("y").agg(F.count("*").alias("n")).collect()}  # a row a class
        score = F.lit(None).cast("double")
        for y, n in counts.items():
            own = self.model.fit(df.filter(F.col("y") == y)).score(F.col("x")) * F.lit(n / sum(counts.values()))
            score = F.when(F.col("y") == y, own).otherwise(score)
        return df.select("id", F.lit(0).alias("member"), F.lit(False).alias("oob"), F.lit(1.0).alias("weight"), F.array(score).alias("score"))


@dataclass
class CalibratedEnsemble:
    """Members calibrated on a slice of rows before they are probed; the rest are the rows returned.

    ``inner`` is any ensemble. Rows of ``slice_of`` (a boolean column) calibrate:
    a map of each member's score of each class, fitted there; probabilities are
    renormalised. Members train on the rest alone.
    """

    inner: object
    classes: int
    slice_of: Column
    epochs: int = 20
    rate: float = 1.0
    method: str = "sigmoid"

    def probe(self, df: DataFrame, probe: Probe, **context) -> DataFrame:
        marked = stored(df.withColumn("_slice", self.slice_of), "marked")
        scored = stored(self._member_probabilities(marked), "members")
        rows = scored.join(marked.select("id", F.col("y").alias("_y"), "_slice"), "id")
        held, rest = rows.filter("_slice"), rows.filter("not _slice")
        members = sorted(r["member"] for r in held.select("member").distinct().collect())  # a row a member
        calibrated = None
        for k in members:
            own = held.filter(F.col("member") == k)
            maps = [self._map(own.select(F.array(F.get("p", F.lit(c))).alias("x"), (F.col("_y") == c).cast("int").alias("y"))) for c in range(self.classes)]
            q = F.array(*[m(F.get("p", F.lit(c))) for c, m in enumerate(maps)])
            calibrated = F.when(F.col("member") == k, q) if calibrated is None else calibrated.when(F.col("member") == k, q)
        out = rest.withColumn("_q", calibrated)
        s = E.let(F.col("_q"), lambda q: E.let(F.greatest(E.total(q), F.lit(1e-12)), lambda t: F.transform(q, lambda v: v / t)))
        s = E.argmax(s) if probe.source == "predictions" else s
        return out.select("id", "member", "oob", "weight", F.array(probe.column(s, F.col("_y"), **context).cast("double")).alias("score"))

    def _member_probabilities(self, marked: DataFrame) -> DataFrame:
        """(id, member, oob, weight, p) of every row: models of the rest applied to all."""
        train = marked.filter("not _slice").drop("_slice")
        everywhere = lambda m, x, y: m.probabilities(x)
        if hasattr(self.inner, "models"):
            models = dict(enumerate(self.inner.models(train)))
        elif isinstance(self.inner, IndependentEnsemble):
            rows = stored(folds(train, self.inner.k, self.inner.repeats), "folds")
            found = self.inner.fit(rows, self.inner.classes, by="fold", within="repeat")
            models = {r * self.inner.k + f: m for (r, f), m in found.items()}
            oob = rows.select("id", (F.col("repeat") * self.inner.k + F.col("fold")).alias("member"), F.lit(True).alias("_out"))
            out = stream(marked, models, everywhere).drop("oob").join(oob, ["id", "member"], "left")
            return out.select("id", "member", F.coalesce("_out", F.lit(False)).alias("oob"), "weight", F.col("score").alias("p"))
        else:
            models = {0: self.inner.fit(train)}
        return stream(marked, models, everywhere).withColumnRenamed("score", "p")

    def _map(self, rows: DataFrame) -> Callable[[Column], Column]:
        if self.method == "sigmoid":
            m = fit_logistic_stages(rows, self.epochs, self.rate)[-1]
            return lambda v: F.get(m.probabilities(F.array(v)), F.lit(1))
        from pyspark.ml.regression import IsotonicRegression

        fitted = IsotonicRegression(featuresCol="f", labelCol="y").fit(rows.select(F.get("x", F.lit(0)).alias("f"), "y"))
        xs, ys = list(map(float, fitted.boundaries)), list(map(float, fitted.predictions))

        def step(v: Column) -> Column:
            """Linear between the boundaries, constant beyond them."""
            out = F.lit(ys[-1])
            for k in range(len(xs) - 2, -1, -1):
                width = xs[k + 1] - xs[k]
                between = F.lit(ys[k]) + (v - xs[k]) * ((ys[k + 1] - ys[k]) / width if width else 0.0)
                out = F.when(v <= xs[k + 1], between).otherwise(out)
            return F.when(v <= xs[0], F.lit(ys[0])).otherwise(out)

        return step
