"""Column builders on arrays: dot products, softmax and the like. All stay in the JVM.

A lambda that looks at another column evaluates that column's expression anew for
each element, wherever the optimizer has put the expression in the place of its
name. What a lambda needs more than once is therefore bound by :func:`let`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPS = 2.220446049250313e-16


def doubles(values) -> Column:
    """A literal array of doubles."""
    return F.array(*[F.lit(float(v)) for v in values])


def matrix(rows) -> Column:
    """A literal array of arrays of doubles."""
    return F.array(*[doubles(r) for r in rows])


def let(value: Column, of: Callable[[Column], Column]) -> Column:
    """``of(value)`` with ``value`` evaluated once, however often ``of`` refers to it."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def held(df: DataFrame, **columns: Column) -> DataFrame:
    """Add ``columns``, each evaluated once a row whatever refers to it: no projection is merged through a generator."""
    row = F.struct(*[c.alias(name) for name, c in columns.items()])
    kept = [c for c in df.columns if c not in columns]
    out = df.select(*kept, F.explode(F.array(row)).alias("_held"))
    return out.select(*kept, *[F.col(f"_held.{name}").alias(name) for name in columns])


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda u, v: u * v))


def norm2(a: Column) -> Column:
    """Squared norm."""
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v * v)


def linear(x: Column, coef: Column, intercept: Column) -> Column:
    """Scores z[k] = x . coef[k] + intercept[k]; coef holds a row per output."""
    return let(x, lambda x: F.zip_with(F.transform(coef, lambda w: dot(x, w)), intercept, lambda u, v: u + v))


def logsumexp(z: Column) -> Column:
    return let(z, lambda z: let(F.array_max(z), lambda top: F.log(F.aggregate(z, F.lit(0.0), lambda s, v: s + F.exp(v - top))) + top))


def shares(a: Column) -> Column:
    """Each element over the sum of all."""
    return let(a, lambda a: let(total(a), lambda t: F.transform(a, lambda v: v / t)))


def softmax(z: Column) -> Column:
    return shares(let(z, lambda z: let(F.array_max(z), lambda top: F.transform(z, lambda v: F.exp(v - top)))))


def logistic(z: Column) -> Column:
    """1 / (1 + exp(-z)), without overflow under ANSI arithmetic."""
    return let(z, lambda z: F.when(z >= 0, 1.0 / (1.0 + F.exp(-F.abs(z)))).otherwise(F.exp(-F.abs(z)) / (1.0 + F.exp(-F.abs(z)))))


def argmax(s: Column) -> Column:
    """Place of the first largest element, from 0."""
    return let(s, lambda s: (F.array_position(s, F.array_max(s)) - 1).cast("int"))


def one_hot(y: Column, classes: int) -> Column:
    """Indicator array of a label."""
    return F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda c: F.when(c == y, 1.0).otherwise(0.0))


def outer(x: Column, g: Column) -> Column:
    """Flattened outer product, feature-major."""
    return let(g, lambda g: F.flatten(F.transform(x, lambda v: F.transform(g, lambda u: u * v))))
