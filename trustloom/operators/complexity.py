"""Leaves of the decision tree fitted without each row, for all rows at once.

Without row i only the sums of the nodes on i's own path change, by one row. So
a node (a region of the feature space) is looked at once for all rows: rows whose
absence leaves its split alone go on to its child, and only the others ask for
the regions that their own split makes. A side without row i is the same region
for all such rows. The count is that of the side left behind, at each step,
plus the last leaf.

Large regions are halved by passes of histograms, as trees grow; a region of few
distinct rows is finished by one task in memory.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trustloom.operators import trees as T
from trustloom.sources.store import stored

#: Distinct rows (features and label) of a region that one task finishes, and numbers it holds for them at once.
LOCAL, HELD = 4000, 4_000_000
#: Gains that agree in so many digits are ties, as in the trees.
_ROUND = T.DIGITS


def _sides(cum: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, ...]:
    """Weights and squares of both sides of every cut; ``cum`` is cuts x classes."""
    right = whole - cum
    return cum.sum(axis=1), (cum**2).sum(axis=1), right.sum(axis=1), (right**2).sum(axis=1)


def _best(gain: np.ndarray) -> np.ndarray:
    """The first cut of the best gain in each row, or -1."""
    gain = np.round(gain, _ROUND)
    at = gain.argmax(axis=1)
    return np.where(np.isfinite(gain[np.arange(len(gain)), at]), at, -1)


@dataclass
class Cuts:
    """All cuts of all features in a row: feature and bin of each."""

    width: list[int]  #: bins of each feature

    def __post_init__(self) -> None:
        self.offset = np.concatenate([[0], np.cumsum(self.width)]).astype(np.int64)
        self.feature = np.repeat(np.arange(len(self.width)), self.width)
        self.bin = np.arange(self.offset[-1]) - self.offset[self.feature]

    def histogram(self, B: np.ndarray, C: np.ndarray) -> np.ndarray:
        """bins x classes: the cells' counts by bin of every feature."""
        H = np.zeros((self.offset[-1], C.shape[1]))
        for j in range(B.shape[1]):
            for k in range(C.shape[1]):
                H[self.offset[j] : self.offset[j + 1], k] = np.bincount(B[:, j], C[:, k], self.width[j])
        return H

    def choose(self, H: np.ndarray, B: np.ndarray, label: np.ndarray, leaf: bool) -> tuple[int, np.ndarray]:
        """The best cut of a region with histogram ``H``, and the best without one row of each given cell; -1 for a leaf."""
        own = np.full(len(B), -1)
        if leaf or not len(self.feature):
            return -1, own
        cum = np.concatenate([np.cumsum(H[a:b], axis=0) for a, b in zip(self.offset, self.offset[1:])])
        whole = H[: self.width[0]].sum(axis=0)
        lw, ls, rw, rs = _sides(cum, whole)
        n, square = whole.sum(), (whole**2).sum()

        def gain(lw, ls, rw, rs, all_):
            ok = (lw > 0.5) & (rw > 0.5)
            return np.where(ok, ls / np.where(ok, lw, 1) + rs / np.where(ok, rw, 1) - all_, -np.inf)

        main = -1 if square > n * n - 0.5 else int(_best(gain(lw, ls, rw, rs, square / n)[None])[0])
        step = max(1, HELD // len(self.feature))
        for k in range(0, len(B), step):
            b, y = B[k : k + step], label[k : k + step]
            left = b[:, self.feature] <= self.bin
            lc, rc = cum[:, y].T, (whole - cum)[:, y].T
            sq = square - 2 * whole[y] + 1
            pure = sq > (n - 1) ** 2 - 0.5
            g = gain(lw - left, ls - left * (2 * lc - 1), rw - ~left, rs - ~left * (2 * rc - 1), (sq / max(n - 1, 1))[:, None])
            own[k : k + step] = np.where(pure, -1, _best(g))
        return main, own


def leaves_without(cuts: Cuts, B: np.ndarray, C: np.ndarray, label: np.ndarray, here: np.ndarray, own: np.ndarray, whole: bool, room: int | None) -> tuple[int, np.ndarray]:
    """Leaves of the tree on the cells ``here`` (if ``whole``), and without one row of each cell of ``own``.

    ``B`` has a cell's bins, ``C`` its counts by class, ``label`` its class.
    ``room`` is how many levels the tree may still have.
    """
    main, apart = cuts.choose(cuts.histogram(B[here], C[here]), B[own], label[own], room == 0)
    result, count = np.ones(len(own)), 1
    after = None if room is None else room - 1
    for cut in sorted({*apart.tolist(), *([main] if whole else [])} - {-1}):
        left = B[here, cuts.feature[cut]] <= cuts.bin[cut]
        mine = np.flatnonzero(apart == cut)
        mine_left = B[own[mine], cuts.feature[cut]] <= cuts.bin[cut]
        ask = whole and cut == main
        l, r = mine[mine_left], mine[~mine_left]
        a, own_a = leaves_without(cuts, B, C, label, here[left], own[l], ask or len(r) > 0, after)
        b, own_b = leaves_without(cuts, B, C, label, here[~left], own[r], ask or len(l) > 0, after)
        result[l], result[r] = own_a + b, own_b + a
        count = a + b if ask else count
    return count, result


def gini_leaves(X: np.ndarray, counts: np.ndarray, depth: int | None = None) -> int:
    """Leaves of the tree on cells (rows of X, any numbers, with a count a class)."""
    X = np.asarray(X, float)
    values = [np.unique(X[:, j]) for j in range(X.shape[1])]
    B = np.stack([np.searchsorted(v, X[:, j]) for j, v in enumerate(values)], axis=1)
    cuts = Cuts([len(v) for v in values])
    return leaves_without(cuts, B, np.asarray(counts, float), np.zeros(len(X), int), np.arange(len(X)), np.zeros(0, int), True, depth)[0]


@dataclass
class _Region:
    depth: int
    main: int = -1
    children: dict[int, tuple[int, int]] = field(default_factory=dict)  #: by cut


def _walk(regions: list[dict[int, tuple[int, int]]], cuts: Cuts, B: np.ndarray, wanted: set[int]) -> Iterator[tuple[int, np.ndarray]]:
    """The rows of each wanted region; a row is in one child of every cut that is made of its region."""
    ahead = [(0, np.arange(len(B)))]
    while ahead:
        k, here = ahead.pop()
        if k in wanted:
            yield k, here
        for cut, (left, right) in regions[k].items():
            side = B[here, cuts.feature[cut]] <= cuts.bin[cut]
            ahead += [(left, here[side]), (right, here[~side])]


@dataclass
class TreeComplexity:
    """``trust`` is the leaves of the Gini tree fitted without the row, features of any numbers.

    Features of over ``bins`` values are cut at as many quantiles, of all rows.
    Work grows with the rows times the levels, and with the rows of the regions
    that some row's absence makes; a tree without limit of depth may have as
    many leaves as rows. Nulls among features go to the left end.
    """

    max_depth: int | None = None
    bins: int = T.BINS
    local: int = LOCAL

    def trust_score(self, df: DataFrame) -> DataFrame:
        edges = T.thresholds(df, self.bins)
        cuts = Cuts([len(e) + 1 for e in edges])
        rows = stored(T.binned(df, edges, F.array(F.lit(1.0)), "id", "y").select("id", "b", "y"), "binned")
        cells = stored(rows.groupBy("b", "y").agg(F.count("*").cast("double").alias("n")).withColumn("cell", F.monotonically_increasing_id()), "cells")
        classes = (cells.agg(F.max("y")).first()[0] or 0) + 1
        state = cells.withColumns({"region": F.lit(0), "behind": F.array().cast("array<int>")})
        regions, open_, small = [_Region(0)], [0], set()
        while open_:
            sizes = self._sizes(cells, regions, cuts, open_)
            large = [k for k in open_ if sizes.get(k, 0) > self.local and regions[k].depth != self.max_depth]
            small |= set(open_) - set(large)
            if not large:
                break
            state, open_ = self._halve(cells, state, regions, cuts, large, classes)
        own, leaves = self._finish(cells, state, regions, cuts, small, classes, self.max_depth)
        counted = self._sum(state, own, leaves)
        return rows.join(cells.select("b", "y", "cell").join(counted, "cell"), ["b", "y"]).select("id", "trust")

    @staticmethod
    def _sizes(cells: DataFrame, regions: list[_Region], cuts: Cuts, open_: list[int]) -> dict[int, int]:
        shared = cells.sparkSession.sparkContext.broadcast(([r.children for r in regions], set(open_)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            children, wanted = shared.value
            for batch in batches:
                found = [(k, len(here)) for k, here in _walk(children, cuts, T.matrix(batch.column(0)).astype(np.int64), wanted)]
                yield pa.record_batch([pa.array([k for k, _ in found], pa.int32()), pa.array([n for _, n in found], pa.int64())], ["region", "n"])

        return {r["region"]: r["n"] for r in cells.select("b").mapInArrow(run, "region int, n long").groupBy("region").agg(F.sum("n").alias("n")).collect()}

    @staticmethod
    def _halve(cells: DataFrame, state: DataFrame, regions: list[_Region], cuts: Cuts, large: list[int], classes: int) -> tuple[DataFrame, list[int]]:
        """Choose the cuts of large regions, by histograms in as many passes as memory asks for, and move the rows on."""
        sc, total = cells.sparkSession.sparkContext, int(cuts.offset[-1])
        room = max(1, T.CELLS // max(1, total * classes))
        chosen, opened = None, []
        for at in range(0, len(large), room):
            part = large[at : at + room]
            walk = sc.broadcast(([r.children for r in regions], part))

            def count(batches: Iterator[pa.RecordBatch], walk=walk) -> Iterator[pa.RecordBatch]:
                children, part = walk.value
                H = {k: np.zeros((total, classes)) for k in part}
                for batch in batches:
                    B, y, n = T.matrix(batch.column(0)).astype(np.int64), batch.column(1).to_numpy(), batch.column(2).to_numpy()
                    C = np.eye(classes)[y] * n[:, None]
                    for k, here in _walk(children, cuts, B, set(part)):
                        H[k] += cuts.histogram(B[here], C[here])
                for k, h in H.items():
                    i, j = np.nonzero(h)
                    yield pa.record_batch([pa.array(np.full(len(i), k), pa.int32()), pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(h[i, j])], ["region", "i", "j", "v"])

            H = {k: np.zeros((total, classes)) for k in part}
            for r in cells.select("b", "y", "n").mapInArrow(count, "region int, i int, j int, v double").groupBy("region", "i", "j").agg(F.sum("v").alias("v")).collect():  # at most CELLS rows
                H[r["region"]][r["i"], r["j"]] = r["v"]
            sums = sc.broadcast(H)

            def choose(batches: Iterator[pa.RecordBatch], sums=sums) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    B, y, region = T.matrix(batch.column("b")).astype(np.int64), batch.column("y").to_numpy(), batch.column("region").to_numpy()
                    cut = np.full(len(B), -1)
                    for k in np.unique(region).tolist():
                        here = np.flatnonzero(region == k)
                        cut[here] = cuts.choose(sums.value[k], B[here], y[here], False)[1]
                    yield pa.record_batch([*batch.columns, pa.array(cut, pa.int32())], [*batch.schema.names, "cut"])

            found = stored(state.filter(F.col("region").isin(part)).mapInArrow(choose, "b array<smallint>, y int, n double, cell long, region int, behind array<int>, cut int"), "chosen")
            chosen = found if chosen is None else chosen.unionByName(found)
            asked = {(r["region"], r["cut"]) for r in found.select("region", "cut").distinct().collect()}  # a row a cut
            for k in part:
                regions[k].main = cuts.choose(H[k], np.zeros((0, len(cuts.width)), int), np.zeros(0, int), False)[0]
                for cut in sorted({c for of, c in asked if of == k} | {regions[k].main} - {-1}):
                    if cut >= 0:
                        regions[k].children[cut] = (len(regions), len(regions) + 1)
                        opened += [len(regions), len(regions) + 1]
                        regions += [_Region(regions[k].depth + 1), _Region(regions[k].depth + 1)]
        moves = sc.broadcast({(k, cut): sides for k in large for cut, sides in regions[k].children.items()})

        def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                B, region, cut, behind = T.matrix(batch.column("b")).astype(np.int64), batch.column("region").to_pylist(), batch.column("cut").to_pylist(), batch.column("behind").to_pylist()
                for i, (k, c) in enumerate(zip(region, cut)):
                    if c < 0:  # a leaf without the row
                        region[i] = -1
                    else:
                        left, right = moves.value[k, c]
                        stays = B[i, cuts.feature[c]] <= cuts.bin[c]
                        region[i], other = (left, right) if stays else (right, left)
                        behind[i] = [*behind[i], other]
                yield pa.record_batch([*(batch.column(c) for c in ("b", "y", "n", "cell")), pa.array(region, pa.int32()), pa.array(behind, pa.list_(pa.int32()))], ["b", "y", "n", "cell", "region", "behind"])

        moved = chosen.mapInArrow(move, "b array<smallint>, y int, n double, cell long, region int, behind array<int>")
        return stored(state.filter(~F.col("region").isin(large)).unionByName(moved), "state"), opened

    @staticmethod
    def _finish(cells: DataFrame, state: DataFrame, regions: list[_Region], cuts: Cuts, small: set[int], classes: int, limit: int | None) -> tuple[DataFrame, list[int]]:
        """(cell, own leaves) of rows in small regions, and the leaves of every region's own tree."""
        shared = cells.sparkSession.sparkContext.broadcast(([r.children for r in regions], small, [r.depth for r in regions]))

        def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            children, wanted, _ = shared.value
            for batch in batches:
                for k, here in _walk(children, cuts, T.matrix(batch.column("b")).astype(np.int64), wanted):
                    part = batch.take(pa.array(here))
                    yield pa.record_batch([pa.array(np.full(len(here), k), pa.int32()), *part.columns, pa.array(np.zeros(len(here), bool))], ["region", "cell", "b", "y", "n", "own"])

        spread = cells.select("cell", "b", "y", "n").mapInArrow(members, "region int, cell long, b array<smallint>, y int, n double, own boolean")
        own = state.filter("region >= 0").select("region", "cell", "b", "y", "n", F.lit(True).alias("own"))

        def solve(rows: pa.Table) -> pa.Table:
            sys.setrecursionlimit(1_000_000)  # a tree may be as deep as it has rows
            rows = rows.combine_chunks()
            k, mine = rows.column("region")[0].as_py(), rows.column("own").to_numpy()
            cell, y = rows.column("cell").to_numpy(), rows.column("y").to_numpy()
            B, C = T.matrix(rows.column("b").combine_chunks()).astype(np.int64), np.eye(classes)[y] * rows.column("n").to_numpy()[:, None]
            here, asks = np.flatnonzero(~mine), np.flatnonzero(mine)
            room = None if limit is None else limit - shared.value[2][k]
            count, found = leaves_without(cuts, B, C, y, here, asks, True, room)
            ids, out = np.concatenate([[-1], cell[asks]]), np.concatenate([[count], found])
            return pa.table([pa.array(np.full(len(ids), k), pa.int32()), pa.array(ids), pa.array(out)], names=["region", "cell", "leaves"])

        solved = stored(spread.unionByName(own).groupBy("region").applyInArrow(solve, "region int, cell long, leaves double"), "leaves")
        leaves = [1] * len(regions)
        for r in solved.filter("cell < 0").collect():  # a row a region
            leaves[r["region"]] = int(r["leaves"])
        for k in range(len(regions) - 1, -1, -1):
            if regions[k].main >= 0:
                leaves[k] = sum(leaves[c] for c in regions[k].children[regions[k].main])
        return solved.filter("cell >= 0").select("cell", "leaves"), leaves

    @staticmethod
    def _sum(state: DataFrame, own: DataFrame, leaves: list[int]) -> DataFrame:
        shared = state.sparkSession.sparkContext.broadcast(np.array(leaves))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = [float(shared.value[b].sum()) if b else 0.0 for b in batch.column(1).to_pylist()]
                yield pa.record_batch([batch.column(0), pa.array(out, pa.float64())], ["cell", "past"])

        past = state.select("cell", "behind").mapInArrow(run, "cell long, past double")
        return past.join(own, "cell", "left").select("cell", (F.col("past") + F.coalesce("leaves", F.lit(1.0))).alias("trust"))
