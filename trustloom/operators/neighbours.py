"""Exact k nearest neighbours of every row, and the ensembles that they give for free (§2.14, E02, E03).

Rows of one place are put together first, so that copies, however many, are one
point that keeps as many of its rows as can be asked for. Points are dealt to
the nearest of a bounded number of pivots, and neighbouring cells are put
together to blocks of bounded size. A point's neighbours within its own block
bound the distance that matters; by the triangle inequality only blocks with a
cell that reaches within it are searched, each once. Where nothing can be ruled
out (many features without structure) every pair of blocks meets once in a task of
its own, for both directions: a product of matrices in single precision rules
out all but a few pairs, and only their distances are summed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trustloom.functions import expr as E
from trustloom.functions.probes import Probe
from trustloom.operators.ensembles import folds
from trustloom.operators.trees import matrix
from trustloom.sources.store import stored

#: Points a cell, about, and pivots at most: both are sent to all tasks.
CELL, PIVOTS = 400, 2048
#: Points of a block.
BLOCK = 40_000
#: Queries and points of a product of matrices: what stays in a core's cache.
TILE = (256, 2048)
#: Points, about, that a first bound is drawn from.
SOME = 4096
#: Parts that a hot place's rows are first thinned in.
SALT = 64
#: Numbers that a block's distances take at once.
HELD = 4_000_000
#: Squares up to which single precision is trusted, and its unit of rounding.
LARGE, UNIT = 1e30, 2.0**-24


def _square_distances(Q: np.ndarray, X: np.ndarray) -> np.ndarray:
    """Squares of differences summed feature by feature: equal wherever a pair is met."""
    out = np.empty((len(Q), len(X)))
    step = max(1, HELD // max(1, X.size))
    for k in range(0, len(Q), step):
        out[k : k + step] = ((Q[k : k + step, None, :] - X[None, :, :]) ** 2).sum(axis=2)
    return out


def _of_pairs(Q: np.ndarray, X: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The same squares for single pairs."""
    out, step = np.empty(len(i)), max(1, HELD // max(1, X.shape[1]))
    for k in range(0, len(i), step):
        out[k : k + step] = ((Q[i[k : k + step]] - X[j[k : k + step]]) ** 2).sum(axis=1)
    return out


class _Rough:
    """Square distances to some points from one product of matrices, and how far they may be off for each query."""

    def __init__(self, X: np.ndarray) -> None:
        with np.errstate(over="ignore", invalid="ignore"):
            self.X, self.at = X, X.mean(axis=0)
            x = X - self.at
            self.n = (x * x).sum(axis=1)
        self.top = self.n.max()
        self.fits = bool(self.top <= LARGE)
        if self.fits:
            self.x = np.hstack([x, np.ones((len(X), 1)), self.n[:, None]]).astype(np.float32)

    def queries(self, Q: np.ndarray) -> tuple[np.ndarray | None, np.ndarray]:
        """What is multiplied with ``x``, or None where single precision can't hold it; and the queries' squares."""
        with np.errstate(over="ignore", invalid="ignore"):
            q = Q - self.at
            n = (q * q).sum(axis=1)
        if not (self.fits and n.max() <= LARGE):
            return None, n
        return np.hstack([-2 * q, n[:, None], np.ones((len(Q), 1))]).astype(np.float32), n

    def of(self, Q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        q, n = self.queries(Q)
        if q is None:
            return _square_distances(Q, self.X), np.zeros(len(Q))
        return q @ self.x.T, _off(n, self.top, Q.shape[1])


def _off(n: np.ndarray, top: float, d: int) -> np.ndarray:
    return 2 * (d + 16) * UNIT * (n + top) + 1e-35


def _most(limit: np.ndarray, off: np.ndarray | float, kind: type) -> np.ndarray:
    """What a rough distance may be at most where the true one is within ``limit``."""
    return np.minimum((limit + off) * (1 + 4 * UNIT), np.finfo(kind).max).astype(kind)


def _true(B: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``np.nonzero`` of a matrix that has few: eight at a time."""
    if B.shape[1] % 8 or not B.flags.c_contiguous:
        return np.nonzero(B)
    at = np.flatnonzero(B.reshape(-1).view(np.uint64))
    of, j = np.nonzero(B.reshape(-1, 8)[at])
    place = at[of] * 8 + j
    return place // B.shape[1], place % B.shape[1]


def _limits(Q: np.ndarray, X: np.ndarray, cut: np.ndarray, take: int, folds: tuple[np.ndarray, np.ndarray] | None) -> np.ndarray:
    """``cut``; where that is infinite, a distance that ``take`` points of other folds are within, if there are as many.

    Some of the points bound it; only where they are too few in other folds all of them are looked at.
    """
    out = cut.copy()
    for some in dict.fromkeys((max(1, len(X) // SOME), 1)):
        left, part = np.flatnonzero(np.isinf(out) & (out > 0)), X[::some]
        if not len(left) or len(part) < take:
            continue
        rough, step = _Rough(part), max(1, HELD // len(part))
        for k in range(0, len(left), step):
            own = left[k : k + step]
            A, off = rough.of(Q[own])
            if folds is not None:
                A[folds[0][own][:, None] == folds[1][::some][None, :]] = np.inf
            out[own] = np.partition(A, take - 1, axis=1)[:, take - 1] + off
    return out


class _Nearest:
    """Each query's ``take`` nearest rows of those met so far, by distance and id."""

    def __init__(self, rows: pa.ListArray, take: int) -> None:
        self.at, self.values, self.take = rows.offsets.to_numpy(), rows.values, take
        self.rank = np.empty(len(self.values), np.int64)
        self.rank[pc.sort_indices(pc.struct_field(self.values, "id")).to_numpy()] = np.arange(len(self.values))
        self.met: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, i: np.ndarray, j: np.ndarray, d: np.ndarray) -> None:
        """Pairs of queries and points, as pairs of queries and the points' rows."""
        size = np.diff(self.at)[j]
        row = np.repeat(self.at[j], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        self.met.append((np.repeat(i, size), row, np.repeat(d, size)))
        self.held += len(row)
        if self.held > HELD:
            self.met = [self._first()]
            self.held = len(self.met[0][0])

    def _first(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        i, row, d = (np.concatenate(c) for c in zip(*self.met)) if self.met else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
        order = np.lexsort((self.rank[row], d, i))
        i, row, d = i[order], row[order], d[order]
        new = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]])) if len(i) else np.zeros(0, int)
        kept = np.arange(len(i)) - np.repeat(new, np.diff(np.append(new, len(i)))) < self.take
        return i[kept], row[kept], d[kept]

    def found(self) -> tuple[np.ndarray, np.ndarray, pa.StructArray]:
        """Query, distance and row."""
        i, row, d = self._first()
        return i, d, self.values.take(pa.array(row))


def _meet(Q: np.ndarray, X: np.ndarray, cut: np.ndarray, forth: _Nearest, folds: tuple[np.ndarray, np.ndarray] | None, cut_back: np.ndarray | None = None, back: _Nearest | None = None) -> None:
    """Give ``forth`` what is within ``cut`` of Q among X, and ``back`` what is within ``cut_back`` of X among Q, from one product.

    An infinite cut stands for the nearest ones that can be asked for, a cut of minus infinity for none.
    ``folds`` of queries and points: those of equal ones are left out.
    """
    rough, d = _Rough(X), X.shape[1]
    q, n = rough.queries(Q)
    kind = np.float64 if q is None else np.float32
    ways = [(forth, (limit := _limits(Q, X, cut, forth.take, folds)), _most(limit, 0 if q is None else _off(n, rough.top, d), kind), False)]
    if back is not None:
        limit = _limits(X, Q, cut_back, back.take, folds and folds[::-1])
        ways.append((back, limit, _most(limit, 0 if q is None else _off(rough.n, n.max(), d), kind), True))
    rows, columns = TILE
    A, B = np.empty(rows * columns, np.float32), np.empty(rows * columns, bool)
    for k in range(0, len(Q), rows):
        own = Q[k : k + rows]
        for c in range(0, len(X), columns):
            other = X[c : c + columns]
            shape = (len(own), len(other))
            if q is None:
                near = _square_distances(own, other)
            else:
                near = np.matmul(q[k : k + rows], rough.x[c : c + columns].T, out=A[: shape[0] * shape[1]].reshape(shape))
            for to, limit, most, turned in ways:
                bound = most[None, c : c + columns] if turned else most[k : k + rows, None]
                i, j = _true(np.less_equal(near, bound, out=B[: shape[0] * shape[1]].reshape(shape)))
                if folds is not None:
                    apart = folds[0][k + i] != folds[1][c + j]
                    i, j = i[apart], j[apart]
                if len(i):
                    exact = _of_pairs(own, other, i, j)
                    asks, point = (c + j, k + i) if turned else (k + i, c + j)
                    good = np.isfinite(exact) & (exact <= limit[asks])
                    to.add(asks[good], point[good], exact[good])


def _leaves(pivots: np.ndarray, cells: list[int], sizes: list[int]) -> list[list[int]]:
    """Cells in groups of at most BLOCK points (or one cell), halved along the feature that spreads most."""
    if len(cells) < 2 or sum(sizes) <= BLOCK:
        return [cells] if cells else []
    X = pivots[cells]
    order = np.argsort(X[:, np.argmax(np.ptp(X, axis=0))], kind="stable")
    total = np.cumsum(np.array(sizes)[order])
    half = min(len(cells) - 1, max(1, int(np.searchsorted(total, total[-1] / 2)) + 1))
    pick = lambda a, of: [a[k] for k in of]
    return [leaf for of in (order[:half], order[half:]) for leaf in _leaves(pivots, pick(cells, of), pick(sizes, of))]


def _points(df: DataFrame, k: int, apart: str | None, within: str | None) -> DataFrame:
    """pid, x, apart, within, rows: a place (and fold), with its first k + 1 rows by id."""
    keys = ["x", "_apart", "_within"]
    rows = df.select("id", "x", "y", (F.col(apart) if apart else F.lit(0)).cast("int").alias("_apart"), (F.col(within) if within else F.lit(0)).cast("int").alias("_within"))
    first = lambda *more: F.row_number().over(Window.partitionBy(*keys, *more).orderBy("id"))
    rows = rows.withColumn("_salt", F.pmod(F.xxhash64("id"), F.lit(SALT)))
    rows = rows.withColumn("_place", first("_salt")).filter(F.col("_place") <= k + 1).withColumn("_place", first()).filter(F.col("_place") <= k + 1)
    return rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("id", "y"))).alias("rows")).withColumn("pid", F.monotonically_increasing_id())


def neighbours(df: DataFrame, k: int = 5, apart: str | None = None, within: str | None = None) -> DataFrame:
    """id, y, near: the k nearest rows (square distance ``d``, ``id``, ``y``) of each row of (id, x, y), nearest first.

    A row isn't its own neighbour; with the column ``apart`` no row of the same
    value is. With ``within`` only rows of the same value are looked at. Of
    equally near rows the least id comes first. Fewer rows than k give all.
    Rows whose x is null, or holds what isn't a finite number, have null
    neighbours and are nobody's.
    """
    spark, folded = df.sparkSession, apart is not None
    take = k if folded else k + 1  # of what is found, one may be the row itself
    kept = df.filter(F.col("x").isNotNull() & F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))))
    points = stored(_points(kept, k, apart, within), "points")
    n = points.count()
    wanted = max(1, min(PIVOTS, n // CELL))
    pivots = np.array([r["x"] for r in points.orderBy(F.xxhash64("pid"), "pid").limit(wanted).select("x").collect()], float)  # at most PIVOTS rows
    shared = spark.sparkContext.broadcast(pivots)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rough = _Rough(shared.value) if len(shared.value) else None
        for b in batches:
            if b.num_rows:
                X = matrix(b.column("x"))
                cell = rough.of(X)[0].argmin(axis=1)
                r = np.sqrt(_of_pairs(X, shared.value, np.arange(len(X)), cell))
                yield pa.record_batch([*b.columns, pa.array(cell, pa.int32()), pa.array(r)], [*b.schema.names, "cell", "r"])

    id_kind, y_kind = (df.schema[c].dataType.simpleString() for c in ("id", "y"))
    row_kind = f"array<struct<id: {id_kind}, y: {y_kind}>>"
    cells = stored(points.mapInArrow(assign, f"x array<double>, _apart int, _within int, rows {row_kind}, pid long, cell int, r double"), "cells")
    sizes: dict[int, dict[int, tuple]] = {}
    for r in cells.groupBy("_within", "cell").agg(F.count("*").alias("n"), F.min("r").alias("lo"), F.max("r").alias("hi")).collect():  # parts x pivots
        sizes.setdefault(r["_within"], {})[r["cell"]] = (r["n"], r["lo"], r["hi"])
    where, rings, leaf_of, count = [], {}, {}, 0
    for w, of in sizes.items():
        leaves = _leaves(pivots, list(of), [m for m, _, _ in of.values()])
        blocks = []
        for leaf in leaves:
            parts = -(-sum(of[c][0] for c in leaf) // BLOCK) if len(leaf) == 1 else 1
            where += [(w, c, count, parts) for c in leaf]
            leaf_of |= {m: (w, len(blocks)) for m in range(count, count + parts)}
            blocks.append(range(count, count + parts))
            count += parts
        flat = [c for leaf in leaves for c in leaf]
        starts = np.cumsum([0, *map(len, leaves[:-1])])
        rings[w] = (np.array(flat), np.array([of[c][1] for c in flat]), np.array([of[c][2] for c in flat]), starts, blocks)
    at = spark.createDataFrame(where, "_within int, cell int, base int, parts int")
    block = (F.col("base") + F.pmod(F.xxhash64("pid"), F.col("parts"))).cast("int")
    cells = cells.join(F.broadcast(at), ["_within", "cell"]).select("x", "_apart", "_within", "rows", "pid", block.alias("block"))

    shared_rings = spark.sparkContext.broadcast((rings, leaf_of))

    def reach(X: np.ndarray, cut: np.ndarray, own: int, other: int | None = None) -> Iterator[np.ndarray]:
        """Of some points of block ``own`` at a time, which leaves, or whether that of block ``other``, may hold a neighbour."""
        rings, leaf_of = shared_rings.value
        cell, lo, hi, starts, _ = rings[leaf_of[own][0]]
        if other is not None:
            k = leaf_of[other][1]
            cell, lo, hi = (a[starts[k] :][: np.diff(starts, append=len(cell))[k]] for a in (cell, lo, hi))
            starts = np.zeros(1, int)
        rough, far, step = _Rough(shared.value[cell]), np.sqrt(cut), max(1, HELD // len(cell))
        for k in range(0, len(X), step):
            D, off = rough.of(X[k : k + step])
            least = np.maximum(np.sqrt(np.maximum(D - off[:, None], 0)) - hi, lo - np.sqrt(np.maximum(D + off[:, None], 0)))
            yield np.logical_or.reduceat(least <= far[k : k + step, None] * (1 + 1e-9) + 1e-9, starts, axis=1)

    def asked_by(X: np.ndarray, cut: np.ndarray, own: int) -> list[int]:
        """The other blocks that may hold a neighbour of any of the points."""
        rings, leaf_of = shared_rings.value
        leaves = np.logical_or.reduce([some.any(axis=0) for some in reach(X, cut, own)])
        return [m for k, numbers in enumerate(rings[leaf_of[own][0]][4]) if leaves[k] for m in numbers if m != own]

    # The k-th distance within a point's own block bounds the search.
    def own(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        X, fold, of = matrix(rows.column("x").combine_chunks()), rows.column("_apart").to_numpy(), rows.column("rows").combine_chunks()
        nearest = _Nearest(of, take)
        _meet(X, X, np.full(len(X), np.inf), nearest, (fold, fold) if folded else None)
        i, d, found = nearest.found()
        many = np.bincount(i, minlength=len(X))
        ends, cut = np.cumsum(many), np.full(len(X), np.inf)
        cut[many == take] = d[ends[many == take] - 1]
        near = pa.StructArray.from_arrays([pa.array(d), *found.flatten()], ["d", "id", "y"])
        near = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), near)
        asks = pa.array([asked_by(X, cut, rows.column("block")[0].as_py()), *[None] * (len(X) - 1)], pa.list_(pa.int32()))  # once for the block
        return pa.table([*rows.columns, near, pa.array(cut), asks], names=[*rows.column_names, "near", "cut", "asks"])

    near_kind = f"array<struct<d: double, id: {id_kind}, y: {y_kind}>>"
    first = cells.groupBy("block").applyInArrow(own, f"x array<double>, _apart int, _within int, rows {row_kind}, pid long, block int, near {near_kind}, cut double, asks array<int>")
    first = stored(first, "first")
    asked = first.select("block", F.explode("asks").alias("other")).distinct()
    met = stored(asked.select(F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b")).distinct(), "met")  # pairs of blocks

    def side(own: str) -> DataFrame:
        """The points of one block of each pair."""
        rows = first.withColumnRenamed("block", own).join(F.broadcast(met), own)
        return rows.select(*[F.col(c).alias(c) for c in ("a", "b", "x", "_apart", "rows", "pid", "cut")])  # new columns: both sides are of one table

    def search(pair: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        sides = [t.combine_chunks() for t in (left, right)]
        kinds = left.schema.field("rows").type.value_type
        names, types = ["pid", "d", "id", "y"], [pa.int64(), pa.float64(), kinds.field("id").type, kinds.field("y").type]
        if not (left.num_rows and right.num_rows):
            return pa.table([pa.array([], t) for t in types], names=names)
        X, Y = (matrix(t.column("x").combine_chunks()) for t in sides)
        a, b = (v.as_py() for v in pair)
        cuts = []
        for t, Z, own, other in ((sides[0], X, a, b), (sides[1], Y, b, a)):  # points that don't ask the other block are only found
            cut = t.column("cut").to_numpy()
            cuts.append(np.where(np.concatenate([some[:, 0] for some in reach(Z, cut, own, other)]), cut, -np.inf))
        apart = tuple(t.column("_apart").to_numpy() for t in sides) if folded else None
        ways = [_Nearest(t.column("rows").combine_chunks(), take) for t in sides[::-1]]
        _meet(X, Y, cuts[0], ways[0], apart, cuts[1], ways[1])
        out = []
        for asking, nearest in zip(sides, ways):
            i, d, rows = nearest.found()
            out.append(pa.table([asking.column("pid").take(pa.array(i)), pa.array(d), *rows.flatten()], names=names))
        return pa.concat_tables(out).combine_chunks()

    pairs = side("a").groupBy("a", "b").cogroup(side("b").groupBy("a", "b")).applyInArrow(search, f"pid long, d double, id {id_kind}, y {y_kind}")
    pairs = pairs.unionByName(first.select("pid", F.explode("near").alias("v")).select("pid", "v.*"))
    place = F.row_number().over(Window.partitionBy("pid").orderBy("d", "id"))
    near = pairs.withColumn("_place", place).filter(F.col("_place") <= take).groupBy("pid").agg(F.array_sort(F.collect_list(F.struct("d", "id", "y"))).alias("near"))
    near = stored(first.select("pid", "x", "_apart", "_within").join(near, "pid", "left"), "near")
    key = lambda f, name: (F.col(name) if name else F.lit(0)).cast("int").eqNullSafe(near[f])
    rows = df.join(near, (df["x"] == near["x"]) & key("_apart", apart) & key("_within", within), "left").select(*[df[c] for c in df.columns], near["near"])
    return rows.withColumn("near", F.slice(F.filter("near", lambda v: v["id"] != F.col("id")), 1, k))


# Ensembles -------------------------------------------------------------------------------------------


def _stream(rows: DataFrame, classes: int, probe: Probe, member, **context) -> DataFrame:
    """The probe stream of rows with neighbours: shares of the neighbours' labels are the model's probabilities."""
    hits = lambda c: F.size(F.filter("near", lambda v: v["y"] == c))
    share = F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda c: F.try_divide(hits(c), F.size("near")))
    rows = E.held(rows.withColumn("_member", member), _p=share)
    if probe.source == "logits":
        raise ValueError("neighbours have probabilities and predictions, no logits")
    s = E.argmax(F.col("_p")) if probe.source == "predictions" else F.col("_p")
    return rows.select("id", F.col("_member").alias("member"), F.lit(True).alias("oob"), F.lit(1.0).alias("weight"), F.array(probe.column(s, F.col("y"), **context).cast("double")).alias("score"))


@dataclass
class NeighboursLeaveOneOut:
    """E03 over k nearest neighbours: each row's member is the model without it, which is its own neighbours."""

    classes: int
    k: int = 5

    def probe(self, df: DataFrame, probe: Probe, **context) -> DataFrame:
        return _stream(neighbours(df.select("id", "x", "y"), self.k), self.classes, probe, F.col("id"), **context)


@dataclass
class NeighboursFolds:
    """E02 over k nearest neighbours: the out-of-fold member of each row and repeat, the only one that out-of-bag aggregates look at."""

    classes: int
    k: int = 5
    splits: int = 5
    repeats: int = 1

    def probe(self, df: DataFrame, probe: Probe, **context) -> DataFrame:
        rows = stored(folds(df.select("id", "x", "y"), self.splits, self.repeats).select("id", "x", "y", "repeat", "fold"), "folds")
        near = neighbours(rows, self.k, apart="fold", within="repeat")
        return _stream(near, self.classes, probe, F.col("repeat") * self.splits + F.col("fold"), **context)
