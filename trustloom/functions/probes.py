"""Row probes: how a fitted model sees a row and its label.

A probe is a function of a score column and a label column and a direction:
whether larger values mean more trust. Score sources say what the score column
is. Probes that need a global aggregate first take the frame in ``prepare``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trustloom.functions import expr as E
from trustloom.sources.store import before, ranged

#: What a probe reads: class probabilities, raw scores, hard predictions or a stored column.
SOURCES = ("probabilities", "logits", "scores", "predictions", "precomputed", "outliers")


def two_columns(p: Column, negate: bool = False) -> Column:
    """A one-output score as two columns: (1 - p, p), or (-z, z)."""
    one = E.F.get(p, F.lit(0))
    return F.when(F.size(p) == 1, F.array(-one if negate else 1.0 - one, one)).otherwise(p)


@dataclass(frozen=True)
class Probe:
    name: str
    maximize: bool
    source: str
    of: Callable[[Column, Column, dict[str, Any]], Column]
    inner: "Probe | None" = None
    options: dict[str, Any] = field(default_factory=dict)

    def column(self, s: Column, y: Column, **context) -> Column:
        return self.of(s, y, {**self.options, **context})

    def on(self, source: str) -> "Probe":
        """The same probe on another score source."""
        if source not in SOURCES:
            raise ValueError(f"unknown score source {source!r}")
        return replace(self, source=source)


def confidence(source: str = "scores") -> Probe:
    return Probe("confidence", True, source, lambda s, y, o: F.get(s, y))


def top_k(k: int = 1, source: str = "scores") -> Probe:
    return Probe("top_k", True, source, lambda s, y, o: F.get(F.sort_array(s, False), F.lit(k - 1)))


def accuracy() -> Probe:
    return Probe("accuracy", True, "predictions", lambda s, y, o: (s == y).cast("double"))


def margin(source: str = "scores") -> Probe:
    others = lambda s, y: F.array_max(F.filter(s, lambda v, i: i != y))
    return Probe("margin", True, source, lambda s, y, o: F.get(s, y) - others(s, y))


def unsupervised_margin(source: str = "scores") -> Probe:
    def of(s, y, o):
        down = F.sort_array(s, False)
        return F.get(down, F.lit(0)) - F.get(down, F.lit(1))

    return Probe("unsupervised_margin", True, source, of)


def cross_entropy(source: str = "probabilities") -> Probe:
    return Probe("cross_entropy", False, source, lambda s, y, o: -F.log(F.greatest(F.lit(E.EPS), F.least(F.lit(1 - E.EPS), F.get(s, y)))))


def cross_entropy_with_logits() -> Probe:
    return Probe("cross_entropy_with_logits", False, "logits", lambda s, y, o: E.logsumexp(s) - F.get(s, y))


def entropy(source: str = "probabilities") -> Probe:
    """Shannon entropy to the base of the number of distinct labels in the frame (``n_labels``)."""

    def of(s, y, o):
        h = F.aggregate(E.shares(s), F.lit(0.0), lambda a, v: a - F.when(v > 0, v * F.log(v)).otherwise(0.0))
        n = o["n_labels"]
        return h / F.log(n if isinstance(n, Column) else F.lit(float(n)))

    return Probe("entropy", False, source, of)


def l1() -> Probe:
    return Probe("l1", False, "predictions", lambda s, y, o: F.abs(y - s))


def l2() -> Probe:
    return Probe("l2", False, "predictions", lambda s, y, o: F.pow(y - s, F.lit(2.0)))


def outliers() -> Probe:
    """The score of an outlier model as it is: higher is more ordinary."""
    return Probe("outliers", True, "outliers", lambda s, y, o: s)


#: Supervised probes and what stands for them without labels; open to more.
UNSUPERVISED: dict[str, Callable[[Probe], Probe]] = {
    "confidence": lambda p: top_k(1, p.source),
    "cross_entropy": lambda p: entropy(p.source),
    "margin": lambda p: unsupervised_margin(p.source),
}


def unsupervised(probe: Probe) -> Probe:
    if probe.name not in UNSUPERVISED:
        raise NotImplementedError(f"no unsupervised form of {probe.name}")
    return UNSUPERVISED[probe.name](probe)


NAMED: dict[str, Callable[[], Probe]] = {
    "confidence": confidence,
    "margin": margin,
    "cross_entropy": cross_entropy,
    "accuracy": accuracy,
    "l1": l1,
    "l2": l2,
}


def check_probe(probe: str | Probe | Callable) -> Probe:
    """A probe by name; probes pass, and a plain function of (scores, label) becomes one that maximises."""
    if isinstance(probe, Probe):
        return probe
    if isinstance(probe, str) and probe in NAMED:
        return NAMED[probe]()
    if callable(probe):
        return Probe(getattr(probe, "__name__", "probe"), True, "scores", lambda s, y, o: probe(s, y))
    raise TypeError(f"{probe!r} is not a probe")


# Modifiers -----------------------------------------------------------------------------------


def adjusted(df: DataFrame, p: str = "p", y: str = "y") -> DataFrame:
    """Replace ``p`` by probabilities less each class's average confidence on its own rows.

    One aggregate of a row a class, collected into an array on one row and sent
    to all: as many doubles as classes.
    """
    classes = F.max(F.size(p))
    means = df.groupBy(y).agg(F.avg(F.get(p, F.col(y))).alias("_m"), classes.alias("_k"))
    table = means.agg(F.map_from_entries(F.collect_list(F.struct(F.col(y), "_m"))).alias("_by"), F.max("_k").alias("_k"))
    table = table.select(F.transform(F.sequence(F.lit(0), F.col("_k") - 1), lambda c: F.coalesce(F.try_element_at("_by", c), F.lit(0.0))).alias("_mean"))
    out = df.crossJoin(F.broadcast(table))
    moved = E.let(F.array_max("_mean"), lambda top: F.zip_with(p, "_mean", lambda v, m: v - m + top))
    return out.withColumn(p, E.shares(moved)).drop("_mean")


def core(probe: Probe, s: Column, y: Column, shares: list[float], alpha: float = 1.0) -> Column:
    """Probe value less alpha times its expectation over labels drawn by their shares."""
    expected = sum((F.lit(float(q)) * probe.column(s, F.lit(c)) for c, q in enumerate(shares)), F.lit(0.0))
    return probe.column(s, y) - alpha * expected


def label_shares(df: DataFrame, y: str = "y", classes: int | None = None) -> list[float]:
    """Empirical label frequencies: one number a class."""
    rows = {r[y]: r["n"] for r in df.groupBy(y).agg(F.count("*").alias("n")).collect()}
    k = classes or max(rows) + 1
    return [rows.get(c, 0) / sum(rows.values()) for c in range(k)]


def with_peers(df: DataFrame, id_: str = "id", y: str = "y", a: tuple[int, int] = (7919, 104729), b: tuple[int, int] = (13, 71)) -> DataFrame:
    """Add peer_x and peer_y: features of one pseudo-random row and the label of another.

    Rows are numbered by id; row r takes features from (a0 r + b0) mod n and the
    label from (a1 r + b1) mod n, so the draw is the same at every run. Numbers
    come from ordered ranges, not from one sort on one task.
    """
    n = df.count()
    if n == 0:
        return df.withColumns({"peer_x": F.col("x"), "peer_y": F.col(y)})
    numbered = df.join(row_numbers(df, id_), id_)
    pick = lambda k: F.pmod(F.col("_r") * F.lit(a[k] % n) + F.lit(b[k] % n), F.lit(n))
    numbered = numbered.withColumns({"_j": pick(0), "_k": pick(1)})
    xs = numbered.select(F.col("_r").alias("_j"), F.col("x").alias("peer_x"))
    ys = numbered.select(F.col("_r").alias("_k"), F.col(y).alias("peer_y"))
    return numbered.join(xs, "_j").join(ys, "_k").drop("_r", "_j", "_k")


def row_numbers(df: DataFrame, id_: str = "id") -> DataFrame:
    """(id, _r): ranks of unique ids from 0, by counting in ranges of about equal rows."""
    rows = ranged(df.select(id_), id_)
    counts = rows.groupBy("_range").agg(F.count("*").alias("_n"))
    counts = counts.select("_range", before(counts, "_n", "_range").alias("_before"))  # a row a range
    inside = Window.partitionBy("_range").orderBy(id_)
    return rows.withColumn("_i", F.row_number().over(inside) - 1).join(F.broadcast(counts), "_range").select(id_, (F.col("_before") + F.col("_i")).alias("_r"))


def directions(d: int, n: int = 10, seed: int = 0) -> list[list[float]]:
    """``n`` unit directions; a float says how many times ``d`` of them, rounded up."""
    import math

    import numpy as np

    count = math.ceil(n * d) if isinstance(n, float) else n
    v = np.random.default_rng(seed).standard_normal((count, d))
    return (v / np.linalg.norm(v, axis=1, keepdims=True)).tolist()


def finite_differences(value: Callable[[Column], Column], x: Column, along: list[list[float]], epsilon: float = 0.1) -> Column:
    """Array of (value(x + epsilon u) - value(x)) / epsilon over the directions u."""
    base = value(x)
    return F.array(*[(value(F.zip_with(x, E.doubles(u), lambda a, b: a + F.lit(epsilon) * b)) - base) / F.lit(epsilon) for u in along])
