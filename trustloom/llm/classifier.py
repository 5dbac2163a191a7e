"""Quality classifier: random Fourier features of document statistics, ridge scores, isotonic calibration.

The statistics of every whole text are standardised by their mean and spread
over all documents. Cosines of random projections approximate a Gaussian kernel
on them; the normal equations of a ridge regression are summed by partition and
then over partitions, so the fit takes all labelled rows whatever their number.
One in CUT_ROWS of these isn't fitted to: binned counts of their scores give an
isotonic map from score to probability.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from trustloom.llm.common import stored

#: Random features, the kernel's width in units of the statistics' spread, and the ridge a row.
FEATURES, WIDTH, RIDGE = 320, 3.0, 1e-4
#: Statistics count as at most so many spreads from their mean.
CLIP = 4.0
#: Bins of the ridge score, from LOW to HIGH, that the calibration counts in.
BINS, LOW, HIGH = 2000, -0.5, 1.5
#: One labelled row in so many calibrates instead of fitting.
CUT_ROWS = 5
#: Predicted good from this score on.
CUT = 0.7
#: Characters looked at in one piece.
PIECE = 1 << 20

STATISTICS = (
    "log_chars", "log_words", "log_lines", "upper", "digit", "blank", "mark", "exclamation", "symbol", "bar", "beyond_latin",
    "word_chars", "word_spread", "short_words", "distinct_words", "top_word", "repeated_word", "distinct_lines", "line_chars", "marked_words",
)


def _classes() -> np.ndarray:
    """Of each Latin-1 character: 0 other letter, 1 upper case, 2 digit, 3 blank, 4 mark, 5 exclamation, 6 symbol, 7 bar."""
    out = np.zeros(257, np.uint8)
    for c in map(chr, range(256)):
        kind = 1 if c.isupper() else 0 if c.isalpha() else 2 if c.isdigit() else 3 if c.isspace() else 4 if c in ".,;:?'\"()-" else 5 if c == "!" else 7 if c == "|" else 6
        out[ord(c)] = kind
    out[256] = 8  # all characters beyond
    return out


_CLASSES = _classes()


def statistics_of(text: str | None) -> list[float]:
    """The STATISTICS of a whole text; those of an empty one are zeros."""
    text = text or ""
    n, counts = len(text), np.zeros(9)
    for k in range(0, n, PIECE):
        codes = np.frombuffer(text[k : k + PIECE].encode("utf-32-le", "replace"), np.uint32)
        counts += np.bincount(_CLASSES[np.minimum(codes, 256)], minlength=9)
    words, lines = text.split(), text.split("\n") if n else []
    share = counts / max(n, 1)
    if words:
        k, of = len(words), Counter(words)
        sizes = np.fromiter(map(len, words), np.int64, k)
        word = [sizes.mean(), sizes.std(), (sizes <= 3).mean(), len(of) / k, max(of.values()) / k, sum(map(eq, words, words[1:])) / k]
    else:
        k, word = 0, [0.0] * 6
    full = [x for x in lines if x]
    line = [len(set(full)) / len(full), np.log1p(n / len(full))] if full else [0.0, 0.0]
    marked = counts[[5, 6, 7]].sum() / max(k, 1)
    return [np.log1p(n), np.log1p(k), np.log1p(len(lines)), *share[1:9].tolist(), *map(float, word), *map(float, line), np.log1p(marked)]


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the array column statistics in place of ``text``; an input column of that name is replaced."""
    names = [c for c in docs.columns if c not in ("statistics", text)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([statistics_of(x) for x in batch.column(len(names)).to_pylist()], pa.list_(pa.float64()))
            yield pa.record_batch([*batch.columns[:-1], found], [*names, "statistics"])

    rows = docs.select(*names, F.col(text).cast("string"))
    return rows.mapInArrow(run, StructType([*rows.schema.fields[:-1], StructField("statistics", ArrayType(DoubleType()))]))


@dataclass
class Model:
    mean: np.ndarray
    spread: np.ndarray
    project: np.ndarray  #: statistics x features
    phase: np.ndarray
    weight: np.ndarray  #: of the features, the intercept last
    bounds: list[float] = field(default_factory=list)  #: ridge scores in order, and the probability at each
    values: list[float] = field(default_factory=list)

    def features(self, rows: np.ndarray) -> np.ndarray:
        """Cosines of the projected statistics, and a one."""
        u = np.clip((rows - self.mean) / self.spread, -CLIP, CLIP)
        z = np.cos(u @ self.project + self.phase) * np.sqrt(2 / len(self.phase))
        return np.hstack([z, np.ones((len(z), 1))])

    def raw(self, rows: np.ndarray) -> np.ndarray:
        return self.features(rows) @ self.weight

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """Calibrated: linear between the isotonic map's steps and constant beyond them."""
        return np.clip(np.interp(self.raw(rows), self.bounds, self.values), 0.0, 1.0)


def isotonic(x: np.ndarray, n: np.ndarray, good: np.ndarray) -> tuple[list[float], list[float]]:
    """Pool adjacent violators: mean x and share of good of each step, in order of x."""
    steps: list[list[float]] = []
    for a, k, g in zip(x.tolist(), n.tolist(), good.tolist()):
        steps.append([a * k, k, g])
        while len(steps) > 1 and steps[-2][2] * steps[-1][1] >= steps[-1][2] * steps[-2][1]:
            last = steps.pop()
            steps[-1] = [p + q for p, q in zip(steps[-1], last)]
    return [a / k for a, k, _ in steps], [g / k for _, k, g in steps]


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for b in batches:
        if b.num_rows:
            yield np.stack(b.column(0).to_numpy(zero_copy_only=False)), b.column(1).to_numpy()


def _equations(rows: DataFrame, model: Model) -> np.ndarray:
    """Upper triangle of the Gram matrix of features, intercept and label, summed by partition and then by entry."""
    size = len(model.phase) + 2
    upper = np.triu_indices(size)
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for x, y in _batches(batches):
            z = np.hstack([shared.value.features(x), y[:, None]])
            total += z.T @ z
        yield pa.record_batch([pa.array(np.arange(len(upper[0])), pa.int32()), pa.array(total[upper])], ["k", "v"])

    out = np.zeros((size, size))
    for r in rows.mapInArrow(run, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect():  # a row an entry
        i, j = upper[0][r["k"]], upper[1][r["k"]]
        out[i, j] = out[j, i] = r["v"]
    return out


def _map(rows: DataFrame, model: Model) -> tuple[list[float], list[float]]:
    """The isotonic map, from counts by bin of the ridge score: at most BINS rows reach the driver."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, y in _batches(batches):
            k = ((np.clip(shared.value.raw(x), LOW, HIGH - 1e-9) - LOW) / (HIGH - LOW) * BINS).astype(np.int32)
            yield pa.record_batch([pa.array(k), pa.array(y)], ["k", "y"])

    found = rows.mapInArrow(run, "k int, y double").groupBy("k").agg(F.count("*").alias("n"), F.sum("y").alias("good")).orderBy("k").collect()
    k, n, good = (np.array([r[c] for r in found], float) for c in ("k", "n", "good"))
    return isotonic(LOW + (k + 0.5) * (HIGH - LOW) / BINS, n, good)


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept from training: the CRC-32 of its id as text leaves 2 when divided by 4."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def labelled(rows: DataFrame, labels: DataFrame, doc_id: str = "doc_id", label: str = "quality") -> DataFrame:
    """(statistics, y, _cut) of all labelled rows that aren't held out; ``_cut`` marks those that calibrate.

    An id with several labels is good only if all say so; all rows of an id
    teach. Null ids and labels don't.
    """
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").alias("_id")).agg((F.min(label) > 0).cast("double").alias("y"))
    cut = F.pmod(F.xxhash64(F.lit("cut"), "_id"), F.lit(CUT_ROWS)) == 0
    return rows.join(known, rows[doc_id] == known["_id"]).select("statistics", "y", cut.alias("_cut"))


def train(rows: DataFrame, labels: DataFrame, doc_id: str = "doc_id", label: str = "quality", seed: int = 0) -> Model:
    """Fit on ``rows`` (:func:`with_statistics`, stored by the caller) and ``labels``.

    Without labels of both kinds every score is the share of good labels, or one
    half without any.
    """
    d, at = len(STATISTICS), [F.get("statistics", F.lit(k)) for k in range(len(STATISTICS))]
    row = rows.agg(*[F.avg(a) for a in at], *[F.stddev_pop(a) for a in at]).first()
    moments = np.array([v or 0.0 for v in row], float)
    rng = np.random.default_rng(seed)
    model = Model(moments[:d], np.maximum(moments[d:], 1e-6), rng.standard_normal((d, FEATURES)) / WIDTH, rng.uniform(0, 2 * np.pi, FEATURES), np.zeros(FEATURES + 1))
    known = stored(labelled(rows, labels, doc_id, label), "labelled")
    fit, cut = known.filter("not _cut").select("statistics", "y"), known.filter("_cut").select("statistics", "y")
    count = {r["_cut"]: (r["n"], r["good"]) for r in known.groupBy("_cut").agg(F.count("*").alias("n"), F.sum("y").alias("good")).collect()}
    both = lambda c: c in count and 0 < count[c][1] < count[c][0]
    n, good = (sum(v[k] for v in count.values()) for k in (0, 1))
    if not 0 < good < n:
        model.bounds, model.values = [0.0], [good / n if n else 0.5]
        return model
    if not (both(False) and both(True)):  # too few rows of a label: all of them serve both ends
        fit = cut = known.select("statistics", "y")
    S = _equations(fit, model)
    penalty = np.full(FEATURES + 1, RIDGE * S[-2, -2])
    penalty[-1] = 0
    model.weight = np.linalg.solve(S[:-1, :-1] + np.diag(penalty), S[:-1, -1])
    model.bounds, model.values = _map(cut, model)
    return model


def score(rows: DataFrame, model: Model) -> DataFrame:
    """``rows`` of :func:`with_statistics` with score (0 to 1) and predicted (1 from CUT on) in place of statistics.

    Null and empty texts have the score of an empty text. Rows that repeat get
    equal scores, a row each; input columns of these names are replaced, others
    pass through, and an empty table gives no rows.
    """
    names = [c for c in rows.columns if c not in ("statistics", "score", "predicted")]
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                s = shared.value.scores(np.stack(b.column(len(names)).to_numpy(zero_copy_only=False)))
                yield pa.record_batch([*b.columns[:-1], pa.array(s), pa.array((s >= CUT).astype(np.int32))], [*names, "score", "predicted"])

    out = rows.select(*names, "statistics")
    return out.mapInArrow(run, StructType([*out.schema.fields[:-1], StructField("score", DoubleType()), StructField("predicted", IntegerType())]))
