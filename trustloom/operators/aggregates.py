"""Aggregates over the member axis of a probe stream (id, member, oob, weight, score array).

A stream is reduced by id: sums, counts and means with a partial step before the
shuffle; the variance and forgetting bring an id's members together. Ensembles
that hold all members of a row in one array don't make a stream at all: named
aggregates reduce the array where it is (:meth:`Aggregate.in_row`), and nothing
is shuffled. A row that no member selects gets null where the sum of weights is empty.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trustloom.functions import expr as E

@dataclass(frozen=True)
class Aggregate:
    """``of`` maps (value, weight) columns to an aggregate; direction is None where the probe's counts."""

    name: str
    of: Callable[[Column, Column], Column]
    maximize: bool | None = None
    before: Callable[[DataFrame, list[str]], DataFrame] | None = None
    selects: str | None = None  #: oob or itb
    along: Callable[[Column], Column] | None = None  #: over the probe axis, after the members
    each: "Aggregate | None" = None
    local: Callable[[Column], Column] | None = None  #: of an array of (s, w) in the order of members

    def in_row(self, members: Column) -> Column | None:
        """The value from a row's array of (member, oob, weight, score), or None where only a stream will do."""
        inner = self.each if self.along is not None else self
        over = _ALONG.get(getattr(self.along, "__name__", None)) if self.along is not None else None
        if inner is None or inner.local is None or (self.along is not None and over is None):
            return None
        weight = {"oob": lambda m: F.when(m["oob"], m["weight"]).otherwise(0.0), "itb": lambda m: F.when(m["oob"], 0.0).otherwise(m["weight"])}.get(self.selects, lambda m: m["weight"])

        def at(p: Column) -> Callable[[Column], Column]:
            return lambda members: E.let(F.transform(members, lambda m: F.struct(F.get(m["score"], p).alias("s"), weight(m).alias("w"))), inner.local)

        if self.along is None:
            return at(F.lit(0))(members)
        places = F.sequence(F.lit(0), F.size(F.get(members, F.lit(0))["score"]) - 1)
        return E.let(F.transform(places, lambda p: at(p)(members)), over)

    def run(self, stream: DataFrame) -> DataFrame:
        """(id, value)."""
        w = F.col("weight")
        if self.selects == "oob":
            w = F.when(F.col("oob"), w).otherwise(0.0)
        elif self.selects == "itb":
            w = F.when(F.col("oob"), 0.0).otherwise(w)
        if self.along is not None:
            flat = stream.select("id", "member", w.alias("weight"), F.posexplode("score").alias("pos", "s"))
            inner = self.each or TOTAL
            if inner.before is not None:
                flat = inner.before(flat, ["id", "pos"])
            return flat.groupBy("id", "pos").agg(inner.of(F.col("s"), F.col("weight")).alias("s")).groupBy("id").agg(self.along(F.col("s")).alias("value"))
        rows = stream.select("id", "member", w.alias("weight"), F.get("score", F.lit(0)).alias("s"))
        if self.before is not None:
            rows = self.before(rows, ["id"])
        return rows.groupBy("id").agg(self.of(F.col("s"), F.col("weight")).alias("value"))


def _mean(s: Column, w: Column) -> Column:
    return F.try_divide(F.sum(s * w), F.sum(w))


def _var(s: Column, w: Column) -> Column:
    """Weighted population variance of what :func:`_centred` gives."""
    m = _mean(s, w)
    return F.greatest(F.try_divide(F.sum(w * s * s), F.sum(w)) - m * m, F.lit(0.0))


def _centred(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Scores less their row's plain mean: large scores that differ little keep their differences."""
    means = rows.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.avg("s").alias("_mean"))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]  # null ids are rows too
    return rows.join(means, same).withColumn("s", F.col("s") - F.col("_mean")).select(*rows.columns)


def _steps(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Whether a stage falls below the one before it, in the order of members."""
    order = Window.partitionBy(*keys).orderBy("member")
    return rows.withColumn("s", F.coalesce((F.lag("s").over(order) > F.col("s")).cast("double"), F.lit(0.0)))


def _added(values: Column) -> Column:
    """The sum of an array without its nulls, null if there is nothing else."""
    return F.aggregate(values, F.lit(None).cast("double"), lambda a, v: F.coalesce(a + v, v, a))


def _weighted(of: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda pairs: _added(F.transform(pairs, of))


_LOCAL_SUM, _LOCAL_COUNT = _weighted(lambda p: p["s"] * p["w"]), _weighted(lambda p: p["w"])


def _local_mean(pairs: Column) -> Column:
    return F.try_divide(_LOCAL_SUM(pairs), _LOCAL_COUNT(pairs))


def _local_var(pairs: Column) -> Column:
    return E.let(_local_mean(pairs), lambda m: F.try_divide(_added(F.transform(pairs, lambda p: p["w"] * (p["s"] - m) * (p["s"] - m))), _LOCAL_COUNT(pairs)))


def _local_forget(pairs: Column) -> Column:
    """The weight of the members that fall below the one before them."""
    after = F.slice(pairs, 2, F.greatest(F.size(pairs) - 1, F.lit(0)))
    return F.coalesce(_added(F.zip_with(F.slice(pairs, 1, F.size(after)), after, lambda a, b: F.when(a["s"] > b["s"], b["w"]).otherwise(0.0))), F.lit(0.0))


_LOCAL_AVG = lambda a: F.try_divide(_added(a), F.size(F.filter(a, lambda v: v.isNotNull())))
#: Reductions of the probe axis that have a form on arrays, by their names in Spark.
_ALONG = {"avg": _LOCAL_AVG, "mean": _LOCAL_AVG, "sum": _added, "max": F.array_max, "min": F.array_min}

TOTAL = Aggregate("sum", lambda s, w: F.sum(s * w), local=_LOCAL_SUM)
COUNT = Aggregate("count", lambda s, w: F.sum(w), local=_LOCAL_COUNT)
MEAN = Aggregate("mean", _mean, local=_local_mean)
VAR = Aggregate("var", _var, maximize=False, before=_centred, local=_local_var)
FORGET = Aggregate("forget", lambda s, w: F.sum(s * w), maximize=False, before=_steps, local=_local_forget)

NAMED = {"sum": TOTAL, "count": COUNT, "mean": MEAN, "var": VAR}


def _selecting(a: Aggregate, what: str) -> Aggregate:
    return Aggregate(f"{what}({a.name})", a.of, a.maximize, a.before, what, a.along, a.each, a.local)


def oob(a: Aggregate | str) -> Aggregate:
    """Only members that did not train on the row."""
    return _selecting(check_aggregate(a), "oob")


def itb(a: Aggregate | str) -> Aggregate:
    """Only members that trained on the row."""
    return _selecting(check_aggregate(a), "itb")


def from_axis(along: Callable[[Column], Column], each: Aggregate = TOTAL) -> Aggregate:
    """Reduce the members with ``each`` at every place of the probe axis, then the axis with ``along``."""
    return Aggregate(f"axis({each.name})", each.of, each.maximize, along=along, each=each)


def stacked(stream: DataFrame) -> DataFrame:
    """(id, values): the first score of each member in the order of members, for reductions of one's own."""
    rows = stream.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("member", F.get("score", F.lit(0)).alias("s")))).alias("m"))
    return rows.select("id", F.transform("m", lambda r: r["s"]).alias("values"))


def check_aggregate(a: Aggregate | str | Callable) -> Aggregate:
    if isinstance(a, Aggregate):
        return a
    if isinstance(a, str) and a in NAMED:
        return NAMED[a]
    if callable(a):
        return Aggregate(getattr(a, "__name__", "aggregate"), a)
    raise ValueError(f"{a!r} is not an aggregate")


def sign(a: Aggregate, probe_maximizes: bool) -> int:
    """1 or -1, so that more is always more trust: by the aggregate's own direction, else the probe's."""
    return 1 if (probe_maximizes if a.maximize is None else a.maximize) else -1
