"""Decision trees grown level by level from histograms (S06, D07, Z07, P40c to P40f).

Features are cut into bins once. A level is one pass: each task adds up its rows
by open node, feature and bin, Spark adds the tasks' sums and picks each node's
split, and one row a node comes back. What is summed is a vector a row: weights
by class, moments of a target, or a gradient and curvature; a split is as good
as the purity of its sides' sums, so classifiers, regressors and boosted trees
grow by the same code. Trees of a bag grow together, in the same passes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trustloom.functions import expr as E
from trustloom.operators.staged import Prefixes, Scores, Split, staged_fit, staged_predict
from trustloom.sources.store import stored

#: Thresholds a feature, at most: features of more values are cut at quantiles.
BINS = 256
#: Sums that a pass holds at most: nodes x bins x values; further nodes get passes of their own.
CELLS = 4_000_000
#: What stands for the values at the ends of a feature.
_END = float(np.finfo(float).max)
#: Gains that agree in so many digits are ties, which the first feature and threshold win.
DIGITS = 9


# What is summed, and how good sums are ------------------------------------------------------------------


@dataclass(frozen=True)
class Criterion:
    """``weight`` and ``purity`` of a list of sums (numbers, arrays or columns alike), ``loss`` less which is pure, and the ``value`` of a leaf."""

    weight: Callable
    purity: Callable
    loss: Callable
    value: Callable


def _over(a, b, otherwise: float = 0.0):
    """a / b on the driver, where b may be 0."""
    return a / b if b else otherwise


#: Sums are the classes' weights.
GINI = Criterion(
    lambda s: sum(s[1:], s[0]),
    lambda s: sum((v * v for v in s[1:]), s[0] * s[0]) / sum(s[1:], s[0]),
    lambda s: sum(s) - _over(sum(v * v for v in s), sum(s)),
    lambda s: [_over(v, sum(s), 1 / len(s)) for v in s],
)
#: Sums are the weight, and the weighted target and its square.
VARIANCE = Criterion(lambda s: s[0], lambda s: s[1] * s[1] / s[0], lambda s: s[2] - _over(s[1] * s[1], s[0]), lambda s: _over(s[1], s[0]))


def newton(penalty: float = 1.0) -> Criterion:
    """Sums are the weight, gradients and curvatures of a loss; a leaf's value is the Newton step."""
    return Criterion(lambda s: s[0], lambda s: s[1] * s[1] / (s[2] + penalty), lambda s: 1.0, lambda s: -s[1] / (s[2] + penalty))


# The tree ------------------------------------------------------------------------------------------------


@dataclass
class Node:
    sums: tuple[float, ...]
    depth: int
    at: int = -1  #: feature of its split, or -1 for a leaf
    bin: int = -1
    threshold: float = float("nan")  #: rows up to it go left; null features go left, NaN right
    left: int = -1
    right: int = -1


@dataclass
class Tree:
    """Nodes, the root first; children come after their parents."""

    criterion: Criterion
    nodes: list[Node]

    def leaves(self) -> int:
        return sum(n.at < 0 for n in self.nodes)

    def arrays(self) -> tuple[np.ndarray, ...]:
        """Feature, bin, threshold, left and right of every node: what tasks need to place rows."""
        return tuple(np.array([getattr(n, c) for n in self.nodes]) for c in ("at", "bin", "threshold", "left", "right"))

    def column(self, x: Column, leaf: Callable[[int], Column], binned: bool = False, k: int = 0) -> Column:
        """``leaf`` of the node that a row ends up in, as a column."""
        n = self.nodes[k]
        if n.at < 0:
            return leaf(k)
        v = F.get(x, F.lit(n.at))
        left, right = (self.column(x, leaf, binned, c) for c in (n.left, n.right))
        return F.when(v <= F.lit(n.bin), left).otherwise(right) if binned else F.when(v.isNull() | (v <= F.lit(n.threshold)), left).otherwise(right)

    def value(self, k: int):
        return self.criterion.value(self.nodes[k].sums)

    def split(self, k: int = 0) -> Split | float:
        """The same tree of numbers, as :class:`Split`; a class tree's number is the share of class 1 less one half."""
        n, v = self.nodes[k], self.value(k)
        v = float(v[1] - 0.5) if isinstance(v, list) else float(v)
        return v if n.at < 0 else Split(n.at, n.threshold, self.split(n.left), self.split(n.right), v)

    def without(self, cut: set[int]) -> Tree:
        """The tree with the nodes ``cut`` as leaves, each with its own value."""
        nodes: list[Node] = []

        def copy(k: int) -> int:
            n, place = self.nodes[k], len(nodes)
            nodes.append(Node(n.sums, n.depth))
            if n.at >= 0 and k not in cut:
                nodes[place].at, nodes[place].bin, nodes[place].threshold = n.at, n.bin, n.threshold
                nodes[place].left, nodes[place].right = copy(n.left), copy(n.right)
            return place

        copy(0)
        return Tree(self.criterion, nodes)

    def pruning_path(self) -> list[tuple[float, Tree]]:
        """(price of a leaf, tree) by weakest links, from the root alone to the whole tree.

        The weakest link is the inner node whose leaves lower the loss least, a
        leaf; all of the least price are cut at once. Prices are a unit of the
        root's weight.
        """
        whole = self.criterion.weight(self.nodes[0].sums) or 1.0
        loss = [self.criterion.loss(n.sums) / whole for n in self.nodes]
        out, cut = [(0.0, self)], set()
        while True:
            inner, below, ahead = [], {}, [0]
            while ahead:
                k = ahead.pop()
                n = self.nodes[k]
                below[k] = (loss[k], 1)  # loss and leaves of what hangs on the node
                if n.at >= 0 and k not in cut:
                    inner.append(k)
                    ahead += [n.left, n.right]
            if not inner:
                return out[::-1]
            for k in sorted(inner, reverse=True):
                (a, m), (b, n) = below[self.nodes[k].left], below[self.nodes[k].right]
                below[k] = (a + b, m + n)
            link = {k: (loss[k] - below[k][0]) / (below[k][1] - 1) for k in inner}
            price = max(out[-1][0], min(link.values()))
            cut |= {k for k in inner if link[k] <= price + 1e-12}
            tree = self.without(cut)
            if price <= 1e-12:  # such links lower nothing
                out[-1] = (0.0, tree)
            else:
                out.append((price, tree))


def place(arrays: tuple[np.ndarray, ...], features: np.ndarray, binned: bool) -> np.ndarray:
    """The node in which each row ends up, by bins or by values."""
    at, bins, values, left, right = arrays
    cut, now = bins if binned else values, np.zeros(len(features), np.int64)
    while True:
        inner = np.flatnonzero(at[now] >= 0)
        if not len(inner):
            return now
        here = now[inner]
        now[inner] = np.where(features[inner, at[here]] <= cut[here], left[here], right[here])


# Bins ------------------------------------------------------------------------------------------------------


def thresholds(df: DataFrame, bins: int = BINS, x: str = "x") -> list[np.ndarray]:
    """Of each feature where it may be cut: between all its values if these are at most ``bins``, else at that many quantiles.

    A task passes a feature's values on as long as they are few, so at most
    ``bins`` values a feature and task are shuffled, and as many reach the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list[np.ndarray | None] = []
        for b in batches:
            if not b.num_rows:
                continue
            X = matrix(b.column(0))
            seen = seen or [np.empty(0)] * X.shape[1]
            for j, had in enumerate(seen):
                if had is not None:  # nulls and NaN count as the ends
                    found = np.union1d(had, np.nan_to_num(X[:, j], nan=_END, posinf=_END, neginf=-_END))
                    seen[j] = found if len(found) <= bins else None
        for j, v in enumerate(seen):
            yield pa.record_batch([pa.array(np.full(1 if v is None else len(v), j), pa.int32()), pa.array([None] if v is None else v, pa.float64())], ["j", "v"])

    found = df.select(x).mapInArrow(run, "j int, v double").distinct()
    few = Window.partitionBy("j")
    found = stored(found, "values")
    count = found.groupBy("j").agg(F.count("*").alias("n"), F.count_if(F.col("v").isNull()).alias("many"))
    sizes = {r["j"]: r["n"] if not r["many"] and r["n"] <= bins else None for r in count.collect()}  # a row a feature
    if not sizes:
        return []
    values = found.filter(F.col("j").isin([j for j, n in sizes.items() if n is not None])).groupBy("j").agg(F.sort_array(F.collect_list("v")).alias("v"))
    of = {r["j"]: np.array(r["v"]) for r in values.collect()}
    out = {j: v[1:] / 2 + v[:-1] / 2 for j, v in of.items()}
    wide = [j for j, n in sizes.items() if n is None]
    if wide:
        shares = [k / bins for k in range(1, bins)]
        row = df.agg(*[F.percentile_approx(F.get(x, F.lit(j)), shares, 20 * bins).alias(f"q{j}") for j in wide]).first()
        out |= {j: np.unique(np.array(row[f"q{j}"], float)) for j in wide}
    return [out[j] for j in sorted(out)]


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column as a matrix; nulls within become minus infinity, the left end."""
    flat = column.flatten()
    X = flat.to_numpy(zero_copy_only=False).astype(float)
    if flat.null_count:
        X[flat.is_null().to_numpy(zero_copy_only=False)] = -np.inf
    return X.reshape(len(column), -1)


def binned(df: DataFrame, edges: list[np.ndarray], sums: Column, *keep: str) -> DataFrame:
    """(b, s, key, and ``keep``) of rows: bins of the features, what is summed, and a hash of the id."""
    shared = df.sparkSession.sparkContext.broadcast(edges)
    rows = df.select("x", sums.alias("s"), F.xxhash64("id").alias("key"), *keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                X = matrix(b.column(0))
                B = np.stack([np.searchsorted(e, X[:, j]) for j, e in enumerate(shared.value)], axis=1) if shared.value else np.zeros((len(X), 0))
                yield pa.record_batch([_lists(B.astype(np.int16), pa.int16()), *b.columns[1:]], ["b", "s", "key", *keep])

    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return rows.mapInArrow(run, ", ".join(["b array<smallint>", "s array<double>", "key long", *[f"{c} {types[c]}" for c in keep]]))


def _lists(M: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(M) + 1) * M.shape[1], pa.int32()), pa.array(np.ascontiguousarray(M).reshape(-1), kind))


# Growing ----------------------------------------------------------------------------------------------------

#: Distribution of how often a bag draws a row: Poisson of mean 1.
_POISSON = np.cumsum([np.exp(-1) / np.prod(np.arange(1, k + 1, dtype=float)) for k in range(12)])


def draws(key: np.ndarray, member: int) -> np.ndarray:
    """How often a bag's member draws each row, from a hash of the row's key and the member."""
    z = key.astype(np.uint64) + np.uint64((member + 1) * 0x9E3779B97F4A7C15 % 2**64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
        z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
    return np.searchsorted(_POISSON, (z >> np.uint64(11)) / 2.0**53).astype(float)


def _histograms(rows: DataFrame, trees: list[Tree], open_: list[tuple[int, int]], width: list[int], sums: int, bag: bool) -> DataFrame:
    """node, j, b, s0 .. : sums of the rows of each open node (tree, place), by feature and bin."""
    offset, total = np.concatenate([[0], np.cumsum(width)]), sum(width)
    shared = rows.sparkSession.sparkContext.broadcast([t.arrays() for t in trees])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        H = np.zeros((sums, len(open_) * total))
        for batch in batches:
            if not batch.num_rows:
                continue
            B, S, key = (matrix(batch.column(0)).astype(np.int64), matrix(batch.column(1)), batch.column(2).to_numpy())
            for m in sorted({m for m, _ in open_}):
                number = np.full(len(shared.value[m][0]), -1)
                for k, (of, at) in enumerate(open_):
                    if of == m:
                        number[at] = k
                node = number[place(shared.value[m], B, True)]
                weight = draws(key, m) if bag else np.ones(len(B))
                here = np.flatnonzero((node >= 0) & (weight > 0))
                for j in range(B.shape[1]):
                    cell = node[here] * total + offset[j] + B[here, j]
                    for s in range(sums):
                        H[s] += np.bincount(cell, S[here, s] * weight[here], H.shape[1])
        some = np.flatnonzero(np.any(H != 0, axis=0))
        node, at = some // total, some % total
        j = np.searchsorted(offset, at, "right") - 1
        yield pa.record_batch([pa.array(node, pa.int32()), pa.array(j, pa.int32()), pa.array(at - offset[j], pa.int32()), *[pa.array(H[s][some]) for s in range(sums)]], ["node", "j", "b", *[f"s{s}" for s in range(sums)]])

    names = [f"s{s}" for s in range(sums)]
    parts = rows.select("b", "s", "key").mapInArrow(run, ", ".join(["node int, j int, b int", *[f"{n} double" for n in names]]))
    return parts.groupBy("node", "j", "b").agg(*[F.sum(n).alias(n) for n in names])


def _choices(found: DataFrame, sums: int, criterion: Criterion, least: float, looked_at: int | None, extra: bool, seed: int, trees: list[int]) -> DataFrame:
    """A row a node: ``all`` sums, and of the best split its feature, bin and left sums, or nulls."""
    names = [f"s{s}" for s in range(sums)]
    whole, up = Window.partitionBy("node", "j"), Window.partitionBy("node", "j").orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
    rows = found.select("node", "j", "b", F.array(*[F.sum(n).over(up) for n in names]).alias("left"), F.array(*[F.sum(n).over(whole) for n in names]).alias("all"))
    of = lambda c: [F.get(c, F.lit(s)) for s in range(sums)]
    left, right = of("left"), [a - b for a, b in zip(of("all"), of("left"))]
    good = (criterion.weight(left) >= least) & (criterion.weight(right) >= least) & (criterion.weight(left) > 0) & (criterion.weight(right) > 1e-12 * criterion.weight(of("all")))
    number = F.get(F.array(*[F.lit(t) for t in trees]), F.col("node")) if looked_at or extra else None
    if looked_at:  # a forest's node looks at some of the features
        order = F.dense_rank().over(Window.partitionBy("node").orderBy(F.xxhash64(F.lit(seed), number, F.get("all", F.lit(0)), "node", "j")))
        rows, good = rows.withColumn("_order", order), good & (F.col("_order") <= looked_at)
    rows = rows.withColumn("good", good)
    if extra:  # extremely random trees: one threshold a feature and node
        rows = rows.withColumn("good", F.col("good") & (F.row_number().over(Window.partitionBy("node", "j").orderBy(F.desc("good"), F.xxhash64(F.lit(seed), number, "node", "j", "b"))) == 1))
    gain = F.when(F.col("good"), F.round(criterion.purity(left) + criterion.purity(right) - criterion.purity(of("all")), DIGITS))
    best = F.max(F.when(F.col("good"), F.struct(gain.alias("gain"), (-F.col("j")).alias("j"), (-F.col("b")).alias("b"), F.col("left"))))
    return rows.groupBy("node").agg(F.first("all").alias("all"), best.alias("best"))


def grow(rows: DataFrame, edges: list[np.ndarray], criterion: Criterion, sums: int = 3, depth: int | None = None, least: float = 0.0, gain: float = -1e-6, members: int = 1, bag: bool = False, share: float = 1.0, extra: bool = False, seed: int = 7) -> list[Tree]:
    """Trees on stored rows of :func:`binned`, one for each member.

    ``sums`` is the length of what is summed; no rows give trees of one leaf. A
    node is split until it is pure, at ``depth``, or has no split with both
    sides of weight ``least`` and a gain over ``gain``; by default a split that
    gains nothing is made too, as it may lead to ones that do.
    """
    width = [len(e) + 1 for e in edges]
    trees = [Tree(criterion, [Node((0.0,) * sums, 0)]) for _ in range(members)]
    open_ = [(m, 0) for m in range(members)]
    room = max(1, CELLS // max(1, sum(width) * sums))
    looked_at = int(np.ceil(share * len(width))) if share < 1 else None
    while open_ and width:
        after: list[tuple[int, int]] = []
        for k in range(0, len(open_), room):
            own = open_[k : k + room]
            found = _histograms(rows, trees, own, width, sums, bag)
            for r in _choices(found, sums, criterion, least, looked_at, extra, seed, [m for m, _ in own]).collect():  # a row a node
                m, at = own[r["node"]]
                tree, best = trees[m], r["best"]
                node = tree.nodes[at]
                node.sums = tuple(r["all"])
                if best is None or best["gain"] <= gain or node.depth == depth or _pure(criterion, node.sums):
                    continue
                node.at, node.bin = -best["j"], -best["b"]
                node.threshold = float(edges[node.at][node.bin])
                left = tuple(best["left"])
                for side, s in (("left", left), ("right", tuple(a - b for a, b in zip(node.sums, left)))):
                    setattr(node, side, len(tree.nodes))
                    tree.nodes.append(Node(s, node.depth + 1))
                    if node.depth + 1 != depth and not _pure(criterion, s):
                        after.append((m, len(tree.nodes) - 1))
        open_ = after
    return trees


def _pure(criterion: Criterion, sums: Sequence[float]) -> bool:
    return criterion.loss(sums) <= 1e-9 * max(1e-12, criterion.weight(sums))


# Estimators --------------------------------------------------------------------------------------------------


def _weight(df: DataFrame) -> Column:
    return F.col("sample_quality").cast("double") if "sample_quality" in df.columns else F.lit(1.0)


def class_sums(df: DataFrame, classes: int) -> Column:
    w = _weight(df)
    return F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda c: F.when(c == F.col("y"), w).otherwise(0.0))


def moments(df: DataFrame) -> Column:
    y, w = F.col("y").cast("double"), _weight(df)
    return F.array(w, w * y, w * y * y)


@dataclass
class TreeClasses(Scores):
    """Trees of class shares, averaged: probabilities and predictions for any number of classes."""

    trees: list[Tree]
    classes: int

    @property
    def outputs(self) -> int:
        return self.classes

    def probabilities(self, x: Column) -> Column:
        parts = [t.column(x, lambda k, t=t: F.array(*[F.lit(float(v)) for v in t.value(k)])) for t in self.trees]
        total = parts[0]
        for p in parts[1:]:
            total = F.zip_with(total, p, lambda a, b: a + b)
        return total if len(parts) == 1 else F.transform(total, lambda v: v / F.lit(float(len(parts))))

    def score(self, source: str, x: Column) -> Column:
        p = self.probabilities(x)
        return E.argmax(p) if source == "predictions" else p

    def parameter_count(self) -> int:
        return sum(t.leaves() for t in self.trees)


@dataclass
class TreeMeans(Scores):
    """Trees of means, averaged: a regressor."""

    trees: list[Tree]

    def predictions(self, x: Column) -> Column:
        return sum((t.column(x, lambda k, t=t: F.lit(float(t.value(k)))) for t in self.trees), F.lit(0.0)) / F.lit(float(len(self.trees)))

    def score(self, source: str, x: Column) -> Column:
        if source != "predictions":
            raise ValueError("a regressor has predictions only")
        return self.predictions(x)

    def parameter_count(self) -> int:
        return sum(t.leaves() for t in self.trees)


@dataclass
class DecisionTree:
    """CART; ``classes`` None makes it a regressor. Its stages are those of the pruning path."""

    classes: int | None = 2
    depth: int | None = None
    least: float = 0.0
    bins: int = BINS
    members: int = 1
    bag: bool = False
    share: float = 1.0
    extra: bool = False
    seed: int = 7

    def grow(self, df: DataFrame) -> list[Tree]:
        edges = thresholds(df, self.bins)
        sums = class_sums(df, self.classes) if self.classes else moments(df)
        rows = stored(binned(df, edges, sums), "binned")
        return grow(rows, edges, GINI if self.classes else VARIANCE, self.classes or 3, self.depth, self.least, members=self.members, bag=self.bag, share=self.share, extra=self.extra, seed=self.seed)

    def model(self, trees: list[Tree]):
        return TreeClasses(trees, self.classes) if self.classes else TreeMeans(trees)

    def fit(self, df: DataFrame):
        return self.model(self.grow(df))


def random_forest(classes: int | None = 2, members: int = 10, depth: int | None = None, **options) -> DecisionTree:
    """A bag of trees whose nodes look at some of the features each."""
    return DecisionTree(classes, depth, members=members, bag=True, **({"share": 0.5} | options))


def extra_trees(classes: int | None = 2, members: int = 10, depth: int | None = None, **options) -> DecisionTree:
    return DecisionTree(classes, depth, members=members, extra=True, **({"share": 0.5} | options))


@staged_fit.register
def _(estimator: DecisionTree, df: DataFrame):
    """From the root alone to the whole tree, by weakest links."""
    if estimator.members != 1:
        raise NotImplementedError("a bag of trees has no pruning path")
    return [estimator.model([t]) for _, t in estimator.grow(df)[0].pruning_path()]


# Boosting ----------------------------------------------------------------------------------------------------


@dataclass
class BoostedTrees(Scores):
    """A base value and the trees' Newton steps at a rate: a margin for two classes, a value for a target."""

    base: float
    rate: float
    trees: list[Tree]
    loss: str = "log_loss"

    def steps(self, x: Column) -> Column:
        """What each tree adds, as an array."""
        return E.let(x, lambda x: F.array(*[t.column(x, lambda k, t=t: F.lit(self.rate * float(t.value(k)))) for t in self.trees]))

    def margin(self, x: Column) -> Column:
        return F.lit(self.base) + E.total(self.steps(x)) if self.trees else F.lit(self.base)

    def predictions(self, x: Column) -> Column:
        return self.margin(x) if self.loss == "squared" else super().predictions(x)

    def score(self, source: str, x: Column) -> Column:
        if self.loss == "squared" and source != "predictions":
            raise ValueError("a regressor has predictions only")
        return super().score(source, x)

    def parameter_count(self) -> int:
        return sum(t.leaves() for t in self.trees)


@staged_predict.register
def _(model: BoostedTrees):
    return Prefixes([BoostedTrees(model.base, model.rate, model.trees[:k], model.loss) for k in range(1, len(model.trees) + 1)], model)


@dataclass
class Boosting:
    """Gradient boosting of trees on histograms, for two classes (log loss) or a target (squared loss); a stage is a prefix.

    The bins are made once. After each round the rows are stored with their new
    margin, so that a round costs the same however many came before.
    """

    rounds: int = 5
    depth: int = 2
    rate: float = 0.3
    loss: str = "log_loss"
    penalty: float = 1.0
    least: float = 0.0
    bins: int = BINS

    def fit(self, df: DataFrame) -> BoostedTrees:
        edges = thresholds(df, self.bins)
        y, w, m = F.col("y").cast("double"), F.col("w"), F.col("m")
        rows = binned(df.withColumn("y", y).withColumn("w", _weight(df)), edges, F.array(F.lit(0.0)), "y", "w").drop("s")
        mean = df.agg(F.sum(_weight(df) * y) / F.sum(_weight(df))).first()[0] or 0.0
        odds = min(max(mean, 1e-6), 1 - 1e-6)
        model = BoostedTrees(float(mean if self.loss == "squared" else np.log(odds / (1 - odds))), self.rate, [], self.loss)
        rows = stored(rows.withColumn("m", F.lit(model.base)), "boosting")
        p = m if self.loss == "squared" else E.logistic(m)
        sums = F.array(w, w * (p - y), w * (F.lit(1.0) if self.loss == "squared" else E.let(p, lambda p: p * (1.0 - p))))
        for k in range(self.rounds):
            tree = grow(rows.select("b", sums.alias("s"), "key"), edges, newton(self.penalty), 3, self.depth, self.least, gain=0.0)[0]
            model.trees.append(tree)
            if k + 1 < self.rounds:
                step = tree.column(F.col("b"), lambda k, t=tree: F.lit(self.rate * float(t.value(k))), True)
                rows = stored(rows.withColumn("m", m + step), "boosting")
        return model


@staged_fit.register
def _(estimator: Boosting, df: DataFrame):
    return staged_predict(estimator.fit(df))
