"""A grid over a splitter's settings on one trust table: every threshold costs one more column of sums, not a run.

Trust is computed once for a detector and a frame, and kept for later grids
under a fingerprint of both. The final model is naive Bayes, whose counts of the
rows that any threshold keeps are sums over buckets of trust; so all thresholds
and folds are fitted by one aggregation and scored by another.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trustloom.operators.decide import quantiles
from trustloom.operators.trees import matrix
from trustloom.sources.store import stored

_TRUST: dict[str, DataFrame] = {}


def fingerprint(df: DataFrame, detector) -> str:
    """Of the detector's settings and the rows' contents, whatever their order: one pass over the rows."""
    row = df.select(F.xxhash64("id", "x", "y").alias("h")).agg(F.count("*"), F.sum(F.pmod("h", F.lit(1 << 40))), F.bit_xor("h")).first()
    return hashlib.sha256(repr((df.sparkSession.sparkContext.applicationId, repr(detector), tuple(row))).encode()).hexdigest()


def trust_of(df: DataFrame, detector, memory: dict[str, DataFrame] | None = None) -> DataFrame:
    """(id, trust) of the detector, stored; asked again for the same rows and settings it isn't run again."""
    kept = _TRUST if memory is None else memory
    key = fingerprint(df, detector)
    if key not in kept:
        kept[key] = stored(detector.trust_score(df).select("id", "trust"), "trust")
    return kept[key]


def quantile_grid(df: DataFrame, detector, shares: Sequence[float], classes: int, k: int = 5, smoothing: float = 1.0, memory: dict[str, DataFrame] | None = None) -> DataFrame:
    """quantile, threshold, accuracy, kept: of naive Bayes on the rows over each quantile of trust, on held-out folds.

    ``df`` holds (id, x, y) with 0/1 features, and fold, 0 to k - 1. The model of
    a fold is fitted on the kept rows of the other folds and scored on all rows
    of its own, as labelled. Quantiles are of the whole table's trust.
    """
    rows = stored(df.join(trust_of(df, detector, memory), "id").select("x", "y", "fold", "trust"), "grid")
    cuts = [quantiles(rows, "trust", q).get(None) for q in shares]
    table = df.sparkSession
    if any(c is None for c in cuts):
        return table.createDataFrame([], "quantile double, threshold double, accuracy double, kept long")
    order = np.argsort(cuts, kind="stable")
    ranked = np.array(cuts, float)[order]
    # How many thresholds a row passes: it is in the sums of these.
    passed = sum((F.col("trust") >= F.lit(float(c))).cast("int") for c in ranked)
    d = len(rows.select("x").first()["x"])
    rows = stored(rows.withColumn("b", passed).drop("trust"), "buckets")
    sums = rows.groupBy("b", "fold", "y").agg(F.count("*").alias("n"), *[F.sum(F.get("x", F.lit(j))).alias(f"c{j}") for j in range(d)]).collect()  # thresholds x folds x classes
    counts = np.zeros((len(cuts) + 1, k, classes, d + 1))
    for r in sums:
        counts[r["b"], r["fold"], r["y"]] = [r["n"], *[r[f"c{j}"] for j in range(d)]]
    over = counts[::-1].cumsum(axis=0)[::-1][1:]  # of rows that pass at least so many
    train = over.sum(axis=1, keepdims=True) - over
    n, c = train[..., 0], train[..., 1:]
    theta = (c + smoothing) / (n + 2 * smoothing)[..., None]
    prior = np.log((n + smoothing) / (n.sum(axis=2, keepdims=True) + classes * smoothing))
    coef, bias = np.log(theta) - np.log(1 - theta), prior + np.log(1 - theta).sum(axis=-1)
    shared = df.sparkSession.sparkContext.broadcast((coef, bias))

    def run(batches):
        coef, bias = shared.value
        hits = np.zeros(len(cuts), np.int64)
        for b in batches:
            if b.num_rows:
                X, y, fold = matrix(b.column(0)), b.column(1).to_numpy(), b.column(2).to_numpy()
                for t in range(len(cuts)):
                    z = np.einsum("nd,ncd->nc", X, coef[t][fold]) + bias[t][fold]
                    hits[t] += int((z.argmax(axis=1) == y).sum())
        yield pa.record_batch([pa.array(np.arange(len(cuts)), pa.int32()), pa.array(hits)], ["t", "hits"])

    hits = {r["t"]: r["hits"] for r in rows.select("x", "y", "fold").mapInArrow(run, "t int, hits long").groupBy("t").agg(F.sum("hits").alias("hits")).collect()}  # a row a threshold
    whole = counts[..., 0].sum()
    out = [(float(shares[i]), float(ranked[t]), float(hits[t] / whole), int(over[t, ..., 0].sum())) for t, i in enumerate(order.tolist())]
    return table.createDataFrame(out, "quantile double, threshold double, accuracy double, kept long")
