"""Sparse rows through the linear algebra and the influence probes: what is done touches non-zeros only.

A sparse row has its features' places ``i`` (ascending) and values ``v``. Models
are a matrix of weights that goes to all tasks; gradients are summed by feature.
The Hessian is dealt in blocks of features and inverted block by block, so that
it never stands in one place, and a row meets only the blocks it has features in.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trustloom.functions import expr as E
from trustloom.operators.linear import LinearModel
from trustloom.sources.store import before, ranged, stored

#: Features of a block of the Hessian.
BLOCK = 512
#: Entries that a task sums up before it passes them on.
HELD = 2_000_000
#: Entries of an inverse that goes to all tasks whole; a larger one stays in blocks.
WHOLE = 1_000_000
#: Terms that are sent to all tasks with their places, the most frequent first.
FREQUENT = 100_000
#: Rows that meet a block of the inverse in one group.
MEET = 20_000

ROW = "i array<int>, v array<double>"


# Making sparse rows ------------------------------------------------------------------------------------


def from_dense(df: DataFrame) -> DataFrame:
    """``x`` as i and v: the places and values of what isn't zero; nulls count as zero."""
    kept = F.filter(F.transform("x", lambda v, k: F.struct(k.alias("k"), v.cast("double").alias("v"))), lambda p: p["v"] != 0.0)
    rows = df.withColumn("_kept", kept)
    return rows.select(*[c for c in df.columns if c != "x"], F.transform("_kept", lambda p: p["k"]).alias("i"), F.transform("_kept", lambda p: p["v"]).alias("v"))


def vocabulary(words: DataFrame, least: int = 2) -> DataFrame:
    """term, n (rows that hold it), place: terms of (id, term, n) in at least ``least`` rows, numbered without a gap.

    Terms are numbered by ranges and offsets, so no task sorts all of them.
    """
    terms = words.groupBy("term").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    rows = ranged(terms, "term")
    sizes = rows.groupBy("_range").agg(F.count("*").alias("rows"))
    offsets = sizes.select("_range", before(sizes, "rows", "_range").alias("offset"))  # a row a range
    inside = F.row_number().over(Window.partitionBy("_range").orderBy("term")) - 1
    return rows.withColumn("_at", inside).join(F.broadcast(offsets), "_range").select("term", "n", (F.col("_at") + F.col("offset")).cast("int").alias("place"))


def tf_idf(df: DataFrame, text: str = "text", least: int = 2) -> tuple[DataFrame, int]:
    """Sparse rows of unit norm from words in lower case, and how many features there are.

    A value is the count times ln((1 + rows) / (1 + rows with the term)) + 1. Rows
    without a kept word have no features. Columns but ``text`` stay.
    """
    others = [c for c in df.columns if c != text]
    token = F.array_sort(F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}]+"), lambda w: w != ""))  # counted within the row
    rows = E.held(df.select("id", text), _s=token)
    start = F.when(F.size("_s") > 0, F.filter(F.sequence(F.lit(0), F.size("_s") - 1), lambda k: (k == 0) | (F.get("_s", k) != F.get("_s", k - 1)))).otherwise(F.array().cast("array<int>"))
    rows = E.held(rows, _at=start)
    count = lambda k, c: (F.coalesce(F.get("_at", c + 1), F.size("_s")) - k).cast("long")
    words = rows.select("id", F.explode(F.transform("_at", lambda k, c: F.struct(F.get("_s", k).alias("term"), count(k, c).alias("n")))).alias("w")).select("id", "w.*")
    words = stored(words, "words")
    terms = stored(vocabulary(words, least).withColumnRenamed("n", "df"), "vocabulary")
    rows, width = df.count(), terms.count()
    value = lambda p: p["n"] * (F.log(F.lit(1.0 + rows) / (1.0 + p["df"])) + 1.0)
    if width <= FREQUENT:
        met = words.join(F.broadcast(terms), "term")
    else:  # most words are of few terms, which meet them where they are
        often = stored(terms.orderBy(F.desc("df"), "place").limit(FREQUENT), "frequent")
        known = F.broadcast(often.select("term"))
        met = words.join(F.broadcast(often), "term").unionByName(words.join(known, "term", "left_anti").join(terms.join(known, "term", "left_anti"), "term"))
    cells = met.select("id", F.struct(F.col("place").alias("k"), F.col("n").cast("int").alias("n"), F.col("df").alias("df")).alias("p"))  # small numbers, which pack well
    vectors = cells.groupBy("id").agg(F.array_sort(F.collect_list("p")).alias("p"))  # a row's own words
    vectors = E.held(vectors, p=F.transform("p", lambda p: F.struct(p["k"].alias("k"), value(p).alias("v"))))
    norm = F.sqrt(F.aggregate("p", F.lit(0.0), lambda s, p: s + p["v"] * p["v"]))
    scaled = E.let(norm, lambda n: F.transform("p", lambda p: p["v"] / n))
    vectors = vectors.select("id", F.transform("p", lambda p: p["k"]).alias("i"), scaled.alias("v"))
    empty = lambda c, kind: F.coalesce(c, F.array().cast(f"array<{kind}>")).alias(c)
    return df.select(*others).join(vectors, "id", "left").select(*others, empty("i", "int"), empty("v", "double")), width


# A batch of sparse rows ----------------------------------------------------------------------------------


@dataclass
class Rows:
    """Non-zeros of a batch: their row, place and value; an intercept is the last feature, of value 1."""

    n: int
    row: np.ndarray
    place: np.ndarray
    value: np.ndarray

    @classmethod
    def of(cls, i: pa.ListArray, v: pa.ListArray, intercept: int | None = None) -> Rows:
        size = np.diff(i.offsets.to_numpy())
        row, place, value = np.repeat(np.arange(len(i)), size), i.flatten().to_numpy().astype(np.int64), v.flatten().to_numpy().astype(float)
        if intercept is None:
            return cls(len(i), row, place, value)
        every = np.arange(len(i))
        row, place, value = np.concatenate([row, every]), np.concatenate([place, np.full(len(i), intercept)]), np.concatenate([value, np.ones(len(i))])
        order = np.argsort(row, kind="stable")
        return cls(len(i), row[order], place[order], value[order])

    def times(self, W: np.ndarray) -> np.ndarray:
        """Rows times a matrix of features x outputs."""
        return np.stack([np.bincount(self.row, self.value * W[self.place, k], self.n) for k in range(W.shape[1])], axis=1)

    def norms(self) -> np.ndarray:
        return np.bincount(self.row, self.value**2, self.n)


@dataclass
class SparseModel:
    """Weights (outputs x features) and intercepts, with the losses of :class:`LinearModel`."""

    coef: np.ndarray
    intercept: np.ndarray | None = None
    loss: str = "log_loss"
    regul: float | None = None

    @classmethod
    def of(cls, m: LinearModel) -> SparseModel:
        return cls(np.array(m.coef, float), None if m.intercept is None else np.array(m.intercept, float), m.loss, m.regul)

    @property
    def outputs(self) -> int:
        return len(self.coef)

    @property
    def width(self) -> int:
        """Features, with the intercept."""
        return self.coef.shape[1] + (self.intercept is not None)

    def rows(self, i: pa.ListArray, v: pa.ListArray) -> Rows:
        return Rows.of(i, v, None if self.intercept is None else self.coef.shape[1])

    def expectation(self, rows: Rows) -> np.ndarray:
        W = self.coef.T if self.intercept is None else np.vstack([self.coef.T, self.intercept])
        z = rows.times(W)
        if self.loss == "squared":
            return z
        if self.outputs == 1:
            return 1 / (1 + np.exp(-z))
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def gradient(self, p: np.ndarray, y: np.ndarray) -> np.ndarray:
        return p - (y.astype(float)[:, None] if self.outputs == 1 else np.eye(self.outputs)[y.astype(int)])

    def variances(self, p: np.ndarray) -> np.ndarray:
        return LinearModel([[0.0]] * self.outputs, None, self.loss).variances(p)


def _map(df: DataFrame, model: SparseModel, work, schema: str) -> DataFrame:
    """``work(model, ids, rows, gradient, p)`` of each batch of (id, i, v, y)."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            if b.num_rows:
                rows = m.rows(b.column(1), b.column(2))
                p = m.expectation(rows)
                yield from work(m, b.column(0), rows, m.gradient(p, b.column(3).to_numpy()), p)

    return df.select("id", "i", "v", "y").mapInArrow(run, schema)


def mean_gradient(df: DataFrame, model: SparseModel) -> np.ndarray:
    """features x outputs: the mean over rows, summed by feature; what comes back is as large as the model."""

    def work(m, ids, rows, g, p):
        place, at = np.unique(rows.place, return_inverse=True)
        for k in range(m.outputs):
            v = np.bincount(at, rows.value * g[rows.row, k], len(place))
            yield pa.record_batch([pa.array(place), pa.array(np.full(len(place), k)), pa.array(v)], ["place", "k", "g"])
        yield pa.record_batch([pa.array([-1]), pa.array([0]), pa.array([float(rows.n)])], ["place", "k", "g"])

    out, n = np.zeros((model.width, model.outputs)), 1.0
    sums = _map(df, model, work, "place long, k long, g double").groupBy("place", "k").agg(F.sum("g").alias("g")).toArrow()
    place, k, g = (sums.column(c).to_numpy() for c in ("place", "k", "g"))
    if len(g):
        n = g[place < 0][0]
        out[place[place >= 0], k[place >= 0]] = g[place >= 0]
    return out / n


def fit_sparse_logistic(df: DataFrame, width: int, classes: int = 2, epochs: int = 5, rate: float = 1.0, intercept: bool = True, regul: float = 0.0) -> list[SparseModel]:
    """Full-batch gradient descent as :func:`linear.fit_logistic_stages`, a stage an epoch; the rows should be stored."""
    k = 1 if classes == 2 else classes
    model, out = SparseModel(np.zeros((k, width)), np.zeros(k) if intercept else None, "log_loss", regul or None), []
    for _ in range(epochs):
        g = mean_gradient(df, model)
        coef = model.coef - rate * (g[:width].T + regul * model.coef)
        model = SparseModel(coef, model.intercept - rate * g[width] if intercept else None, "log_loss", regul or None)
        out.append(model)
    return out


# Probes ----------------------------------------------------------------------------------------------------


def probabilities(df: DataFrame, model: SparseModel) -> DataFrame:
    """id, p: probabilities of all classes, or the values of a squared loss."""

    def work(m, ids, rows, g, p):
        p = np.hstack([1 - p, p]) if m.outputs == 1 and m.loss != "squared" else p
        yield pa.record_batch([ids, pa.array(list(p), pa.list_(pa.float64()))], ["id", "p"])

    return _map(df, model, work, f"id {df.schema['id'].dataType.simpleString()}, p array<double>")


def gradient_probes(df: DataFrame, model: SparseModel) -> DataFrame:
    """id, grad_norm, representer, similarity (P50 to P52): of each row's gradient, without the intercept's part.

    Similarity is the cosine to the mean gradient, as in :func:`linear.grad_similarity`.
    """
    d = model.coef.shape[1]
    mean = mean_gradient(df, model)[:d]
    shared = df.sparkSession.sparkContext.broadcast(mean)

    def work(m, ids, rows, g, p):
        M = shared.value
        own = Rows(rows.n, *(a[rows.place < d] for a in (rows.row, rows.place, rows.value)))
        square, g2 = own.norms(), (g**2).sum(axis=1)
        dot = (own.times(M) * g).sum(axis=1)
        scale = np.sqrt(square * g2 * (M**2).sum())
        at = np.abs(g).sum(axis=1) if m.loss == "squared" else np.abs(g).max(axis=1)
        yield pa.record_batch([ids, pa.array(square * g2), pa.array(at * square), pa.array(np.where(scale > 0, dot / np.where(scale > 0, scale, 1), 0.0))], ["id", "grad_norm", "representer", "similarity"])

    return _map(df, model, work, f"id {df.schema['id'].dataType.simpleString()}, grad_norm double, representer double, similarity double")


# The Hessian in blocks -----------------------------------------------------------------------------------


def _crossed(left: np.ndarray, right: np.ndarray, each: int) -> Iterator[tuple[np.ndarray, int, np.ndarray, np.ndarray]]:
    """All pairs of a row's left and right non-zeros, some rows at a time, from how many there are of either in each row.

    Gives the pairs' rows, counted from a first one, that first row, and the places of both non-zeros.
    """
    many = left * right
    at_left, at_right = np.cumsum(left) - left, np.cumsum(right) - right
    part = np.cumsum(many) * each // HELD
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(many)]
    for start, end in zip(cuts, cuts[1:]):
        n = many[start:end]
        r = np.repeat(np.arange(end - start), n)
        if len(r):
            t, width = np.arange(len(r)) - np.repeat(np.cumsum(n) - n, n), right[start:end][r]
            yield r, start, at_left[start:end][r] + t // width, at_right[start:end][r] + t % width


def _forms(M: np.ndarray, left: np.ndarray, i: np.ndarray, v: np.ndarray, right: np.ndarray, j: np.ndarray, w: np.ndarray) -> np.ndarray:
    """rows x outputs x outputs: forms of rows' left and right non-zeros in M (features x outputs x features x outputs)."""
    k = M.shape[1]
    out = np.zeros((len(left), k, k))
    for r, at, a, b in _crossed(left, right, k * k):
        part = (v[a] * w[b])[:, None, None] * M[i[a], :, j[b], :]
        n = int(r[-1]) + 1
        for x in range(k):
            for y in range(k):
                out[at : at + n, x, y] += np.bincount(r, part[:, x, y], n)
    return out


def hessian_blocks(df: DataFrame, model: SparseModel, block: int = BLOCK) -> DataFrame:
    """bi, bj, m: blocks of the Hessian as matrices, the penalty on the weights' diagonal included.

    Parameters are in the order of features, outputs within; ``block`` counts
    features. Tasks sum products of non-zeros, Spark sums the tasks' entries, and
    each block is put together where its entries meet.
    """
    k, side = model.outputs, block * model.outputs
    spark, width, d = df.sparkSession, model.width, model.coef.shape[1]

    def work(m, ids, rows, g, p):
        V, size = m.variances(p), np.bincount(rows.row, minlength=rows.n)
        for r, at, i, j in _crossed(size, size, k * k):
            w = (rows.value[i] * rows.value[j])[:, None, None] * V[at + r]
            a, b = rows.place[i][:, None, None] * k + np.arange(k)[:, None], rows.place[j][:, None, None] * k + np.arange(k)
            key, to = np.unique((a * (width * k) + b).reshape(-1), return_inverse=True)
            yield pa.record_batch([pa.array(key // (width * k)), pa.array(key % (width * k)), pa.array(np.bincount(to.reshape(-1), w.reshape(-1)))], ["a", "b", "v"])

    entries = _map(df, model, work, "a long, b long, v double").groupBy("a", "b").agg(F.sum("v").alias("v"))
    # Every diagonal entry occurs, with the penalty on those of weights.
    every = spark.range(width * k).select(F.col("id").alias("a"), F.col("id").alias("b"), F.when(F.col("id") < d * k, float(model.regul or 0.0)).otherwise(0.0).alias("v"))
    if k > 1 and model.intercept is not None and model.loss != "squared":
        # A softmax doesn't see intercepts that move alike, and gradients don't either: this fixes that direction and changes no form of theirs.
        alike = spark.range(k * k).select((d * k + F.floor(F.col("id") / k)).alias("a"), (d * k + F.col("id") % k).alias("b"), F.lit(1.0).alias("v"))
        every = every.unionByName(alike)
    entries = entries.unionByName(every).withColumns({"bi": F.floor(F.col("a") / side), "bj": F.floor(F.col("b") / side)})

    def build(rows: pa.Table) -> pa.Table:
        bi, bj = rows.column("bi")[0].as_py(), rows.column("bj")[0].as_py()
        m = np.zeros((_size(bi, side, width * k), _size(bj, side, width * k)))
        np.add.at(m, (rows.column("a").to_numpy() - bi * side, rows.column("b").to_numpy() - bj * side), rows.column("v").to_numpy())
        return pa.table([pa.array([bi]), pa.array([bj]), pa.array([m.tobytes()], pa.binary())], names=["bi", "bj", "m"])

    return entries.groupBy("bi", "bj").applyInArrow(build, "bi long, bj long, m binary")


def _size(b: int, side: int, whole: int) -> int:
    return min(side, whole - b * side)


def inverse_blocks(blocks: DataFrame, parameters: int, side: int) -> DataFrame:
    """The inverse, block by block (Gauss-Jordan): a round eliminates a block of parameters from all others.

    A round sends out the pivot, of bounded size, and joins each block with the
    one of its row and the one of its column; all other work is local. The
    matrix must be positive definite, as a Hessian with a penalty is.
    """
    spark, rounds = blocks.sparkSession, -(-parameters // side)
    every = spark.range(rounds * rounds).select(F.floor(F.col("id") / rounds).alias("bi"), (F.col("id") % rounds).alias("bj"))
    now = stored(every.join(blocks, ["bi", "bj"], "left"), "blocks")

    def read(m, rows: int, columns: int) -> np.ndarray:
        return np.zeros((rows, columns)) if m is None else np.frombuffer(m).reshape(rows, columns)

    for p in range(rounds):
        n = _size(p, side, parameters)
        pivot = np.linalg.pinv(read(now.filter((F.col("bi") == p) & (F.col("bj") == p)).first()["m"], n, n), hermitian=True)
        shared = spark.sparkContext.broadcast(pivot)
        row, column = now.filter(F.col("bi") == p).select("bj", F.col("m").alias("r")), now.filter(F.col("bj") == p).select("bi", F.col("m").alias("c"))

        def step(batches: Iterator[pa.RecordBatch], p=p, n=n, shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                out = []
                for bi, bj, m, r, c in zip(*(b.column(x).to_pylist() for x in ("bi", "bj", "m", "r", "c"))):
                    rows, columns = _size(bi, side, parameters), _size(bj, side, parameters)
                    across = shared.value @ read(r, n, columns)
                    if bi == p:
                        new = shared.value if bj == p else across
                    elif bj == p:
                        new = -read(c, rows, n) @ shared.value
                    else:
                        new = read(m, rows, columns) - read(c, rows, n) @ across
                    out.append(np.ascontiguousarray(new).tobytes())
                yield pa.record_batch([b.column("bi"), b.column("bj"), pa.array(out, pa.binary())], ["bi", "bj", "m"])

        now = stored(now.join(row, "bj").join(column, "bi").mapInArrow(step, "bi long, bj long, m binary"), "blocks")
    return now


def influence(df: DataFrame, model: SparseModel, block: int = BLOCK) -> DataFrame:
    """id with self_influence, leverage, cook, cook_bar, approximate_loo, as :func:`linear.influence`, of sparse rows.

    A row's quadratic forms are sums over the pairs of blocks that it has
    features in. The Hessian needs a penalty, or full rank but for intercepts.
    """
    k, side, width = model.outputs, block * model.outputs, model.width
    inverse = inverse_blocks(hessian_blocks(df, model, block), width * k, side)
    id_kind = df.schema["id"].dataType.simpleString()
    names = ["id", "self_influence", "leverage", "cook", "cook_bar", "approximate_loo"]
    schema = f"id {id_kind}, " + ", ".join(f"{name} double" for name in names[1:])

    if (width * k) ** 2 <= WHOLE:
        M = np.zeros((width * k, width * k))
        for r in inverse.collect():  # WHOLE entries at most
            rows, columns = _size(r["bi"], side, width * k), _size(r["bj"], side, width * k)
            M[r["bi"] * side : r["bi"] * side + rows, r["bj"] * side : r["bj"] * side + columns] = np.frombuffer(r["m"]).reshape(rows, columns)
        whole = df.sparkSession.sparkContext.broadcast(M.reshape(width, k, width, k))

        def at_once(m, ids, rows, g, p):
            size = np.bincount(rows.row, minlength=rows.n)
            Q = _forms(whole.value, size, rows.place, rows.value, size, rows.place, rows.value)
            yield pa.record_batch([ids, *map(pa.array, row_influence(Q, g, m.variances(p), m.width))], names)

        return _map(df, model, at_once, schema)

    def spread(m, ids, rows, g, p):
        """Each row's features by block."""
        of = rows.place // block
        order = np.lexsort((rows.place, of, rows.row))
        row, of, place, value = rows.row[order], of[order], rows.place[order], rows.value[order]
        new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (of[1:] != of[:-1])])) if len(row) else np.zeros(0, int)
        cuts = pa.array(np.append(new, len(row)), pa.int32())
        lists = lambda a, t: pa.ListArray.from_arrays(cuts, pa.array(a, t))
        yield pa.record_batch([ids.take(pa.array(row[new])), pa.array(of[new]), lists(place - of * block, pa.int32()), lists(value, pa.float64())], ["id", "b", "i", "v"])

    # A block of the inverse goes once to each group of rows that meets it, not to each row.
    parts = stored(_map(df, model, spread, f"id {id_kind}, b long, {ROW}"), "parts")
    other = parts.select("id", F.col("b").alias("bj"), F.col("i").alias("j"), F.col("v").alias("w"))
    met = parts.withColumnRenamed("b", "bi").join(other, "id")
    groups = stored(met.groupBy("bi", "bj").agg(F.ceil(F.count("*") / F.lit(float(MEET))).alias("groups")), "groups")  # a row a block
    met = met.join(F.broadcast(groups), ["bi", "bj"]).withColumn("group", F.pmod(F.xxhash64("id"), F.col("groups")))
    inverse = inverse.join(F.broadcast(groups), ["bi", "bj"]).select("bi", "bj", "m", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)).alias("group"))

    def forms(rows: pa.Table, found: pa.Table) -> pa.Table:
        if not (rows.num_rows and found.num_rows):
            return pa.table([rows.column("id").slice(0, 0), pa.array([], pa.list_(pa.float64()))], names=["id", "q"])
        rows = rows.combine_chunks()
        i, v, j, w = (rows.column(c).combine_chunks() for c in "ivjw")
        M = np.frombuffer(found.column("m")[0].as_py()).reshape(-1, _size(found.column("bj")[0].as_py(), side, width * k))
        M = M.reshape(M.shape[0] // k, k, M.shape[1] // k, k)
        flat = [a.flatten().to_numpy() for a in (i, v, j, w)]
        q = _forms(M, np.diff(i.offsets.to_numpy()), *flat[:2], np.diff(j.offsets.to_numpy()), *flat[2:])
        return pa.table([rows.column("id"), pa.array(list(q.reshape(len(q), -1)), pa.list_(pa.float64()))], names=["id", "q"])

    keys = ["bi", "bj", "group"]
    sums = met.select("id", "i", "v", "j", "w", *keys).groupBy(*keys).cogroup(inverse.groupBy(*keys)).applyInArrow(forms, f"id {id_kind}, q array<double>")
    sums = sums.groupBy("id").agg(*[F.sum(F.get("q", F.lit(c))).alias(f"q{c}") for c in range(k * k)])
    sums = sums.select(F.col("id").alias("_id"), F.array(*[f"q{c}" for c in range(k * k)]).alias("q"))
    none = F.array_repeat(F.lit(0.0), k * k)  # of a row without features
    rows = df.select("id", "i", "v", "y").join(sums, F.col("id") == F.col("_id"), "left").select("id", "i", "v", "y", F.coalesce("q", none).alias("q"))
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                m = shared.value
                p = m.expectation(m.rows(b.column("i"), b.column("v")))
                g, V = m.gradient(p, b.column("y").to_numpy()), m.variances(p)
                Q = np.stack(b.column("q").to_numpy(zero_copy_only=False)).reshape(-1, k, k)
                yield pa.record_batch([b.column("id"), *map(pa.array, row_influence(Q, g, V, m.width))], names)

    return rows.mapInArrow(run, schema)


def row_influence(Q: np.ndarray, g: np.ndarray, V: np.ndarray, dof: int) -> tuple[np.ndarray, ...]:
    """Self-influence, leverage, Cook's distances and approximate leave-one-out of rows, from their forms in the inverse Hessian."""
    own = -np.einsum("nk,nkl,nl->n", g, Q, g)
    w, U = np.linalg.eigh(V)
    root = np.einsum("nij,nj,nkj->nik", U, np.sqrt(np.clip(w, 0, None)), U)
    back = np.einsum("nij,nj,nkj->nik", U, np.where(w > 1e-12, 1 / np.sqrt(np.clip(w, 1e-12, None)), 0), U)
    h, r = root @ Q @ root, np.einsum("nij,nj->ni", back, g)
    eye = np.eye(V.shape[1])[None]
    a = np.linalg.solve(eye - h, h)
    left = np.linalg.solve(eye - h, r[:, :, None])[:, :, 0]
    cook = np.einsum("ni,nij,nj->n", left, h, left) / dof
    bar = np.einsum("ni,nij,nj->n", left, h, r) / dof
    ar = np.einsum("nij,nj->ni", a, r)
    return own, np.trace(h, axis1=1, axis2=2), cook, bar, -0.5 * ((ar**2).sum(axis=1) + 2 * (r * ar).sum(axis=1))


# Detectors ---------------------------------------------------------------------------------------------------


@dataclass
class SparseDetector:
    """D02 to D06 on sparse rows: a column of the influence or gradient probes of a fitted model."""

    fit: object  #: frame -> SparseModel
    column: str
    maximize: bool
    block: int = BLOCK

    def trust_score(self, df: DataFrame) -> DataFrame:
        model = self.fit(df)
        of = gradient_probes(df, model) if self.column in ("grad_norm", "representer", "similarity") else influence(df, model, self.block)
        return of.select("id", (F.col(self.column) * F.lit(1.0 if self.maximize else -1.0)).alias("trust"))


def sparse_detectors(fit, block: int = BLOCK) -> dict[str, SparseDetector]:
    """By the names of the dense ones."""
    of = {"self_influence": ("self_influence", True), "cook_distance": ("cook", False), "approximate_loo": ("approximate_loo", True), "representer": ("representer", False), "agra": ("similarity", True)}
    return {name: SparseDetector(fit, column, up, block) for name, (column, up) in of.items()}
