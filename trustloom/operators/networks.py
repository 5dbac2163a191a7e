"""Multilayer perceptrons in numpy inside tasks: features, Jacobians, kernels, Fisher sums."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trustloom.operators.linear import LinearModel, _partial_sums
from trustloom.operators.trees import matrix
from trustloom.sources.store import ranged, stored

#: Places of a kernel's second side that are met at once.
BLOCK = 1024
#: Numbers of the kernel that a task holds at once, if a row of it isn't longer.
HELD = 2_000_000
#: Rows of a task that are put together by place at once.
BUNCH = 100_000


class Mlp:
    """Layers of (weights d x h, biases h), a hidden activation, and raw outputs."""

    def __init__(self, layers: list[tuple[np.ndarray, np.ndarray]], activation: str = "logistic") -> None:
        self.layers, self.activation = layers, activation

    @classmethod
    def init(cls, sizes: list[int], seed: int = 0, activation: str = "tanh") -> "Mlp":
        """weights as at the start of training: uniform within the fan's bound."""
        rng = np.random.default_rng(seed)
        out = []
        for a, b in zip(sizes, sizes[1:]):
            bound = np.sqrt((2.0 if activation == "logistic" else 6.0) / (a + b))
            out.append((rng.uniform(-bound, bound, (a, b)), rng.uniform(-bound, bound, b)))
        return cls(out, activation)

    @classmethod
    def of_spark(cls, weights: np.ndarray, sizes: list[int]) -> "Mlp":
        """From a fitted perceptron of pyspark.ml: per layer a column-major (out x in) matrix, then biases."""
        out, at = [], 0
        for a, b in zip(sizes, sizes[1:]):
            w = weights[at : at + a * b].reshape((b, a), order="F").T
            out.append((w, weights[at + a * b : at + a * b + b]))
            at += a * b + b
        return cls(out, "logistic")

    @property
    def num_params(self) -> int:
        return sum(w.size + b.size for w, b in self.layers)

    def _act(self, z):
        return {"logistic": lambda v: 1 / (1 + np.exp(-v)), "tanh": np.tanh, "relu": lambda v: np.maximum(v, 0), "identity": lambda v: v}[self.activation](z)

    def _slope(self, a):
        return {"logistic": a * (1 - a), "tanh": 1 - a * a, "relu": (a > 0).astype(float), "identity": np.ones_like(a)}[self.activation]

    def forward(self, X: np.ndarray) -> list[np.ndarray]:
        """activations of each layer; the last is raw."""
        out = [X]
        for k, (w, b) in enumerate(self.layers):
            z = out[-1] @ w + b
            out.append(z if k == len(self.layers) - 1 else self._act(z))
        return out

    def hidden(self, X: np.ndarray) -> np.ndarray:
        """the last hidden layer."""
        return self.forward(X)[-2]

    def jacobian(self, X: np.ndarray) -> np.ndarray:
        """n x outputs x parameters, by one reverse pass from each output; per layer weights, then biases."""
        acts = self.forward(X)
        n, k = acts[-1].shape
        out = np.empty((n, k, self.num_params))
        for o in range(k):
            delta = np.zeros((n, k))
            delta[:, o] = 1
            parts = []
            for layer in range(len(self.layers) - 1, -1, -1):
                parts.append((np.einsum("ni,nj->nij", acts[layer], delta).reshape(n, -1), delta))
                if layer:
                    delta = (delta @ self.layers[layer][0].T) * self._slope(acts[layer])
            out[:, o] = np.concatenate([np.hstack(p) for p in parts[::-1]], axis=1)
        return out

    def kernel(self, X: np.ndarray, Y: np.ndarray) -> np.ndarray:
        """sum over outputs of J(X) J(Y)'."""
        return self.jacobian(X).reshape(len(X), -1) @ self.jacobian(Y).reshape(len(Y), -1).T

    def linearised(self, regul: float | None = None) -> LinearModel:
        """The last layer as a linear model over the hidden features."""
        w, b = self.layers[-1]
        return LinearModel(w.T.tolist(), b.tolist(), "log_loss", regul)


def _mapped(df: DataFrame, work, name: str, keep: tuple[str, ...] = ()) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                out = b[["id", *keep]].copy()
                out[name] = list(work(np.array(b["x"].tolist(), float)))
                yield out

    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return df.select("id", "x", *keep).mapInPandas(run, ", ".join([f"id {kinds['id']}", *[f"{k} {kinds[k]}" for k in keep], f"{name} array<double>"]))


def neural_tangent_features(df: DataFrame, mlp: Mlp) -> DataFrame:
    """id and all outputs' derivatives by all parameters."""
    return _mapped(df, lambda X: mlp.jacobian(X).reshape(len(X), -1), "features")


def neural_random_features(df: DataFrame, mlp: Mlp, keep: tuple[str, ...] = ()) -> DataFrame:
    """id and the last hidden layer."""
    return _mapped(df, mlp.hidden, "features", keep)


def kernel_rows(df: DataFrame, mlp: Mlp, landmarks: np.ndarray) -> DataFrame:
    """id and the kernel between each row and a given set of landmark rows."""
    return _mapped(df, lambda X: mlp.kernel(X, landmarks), "kernel")


def _rounded(K: np.ndarray, digits: int) -> np.ndarray:
    """What Spark's ``round`` gives: half up, by the decimals that a double is written with."""
    with np.errstate(over="ignore", invalid="ignore"):
        z = K * 10.0**digits
        out = np.rint(z) / 10.0**digits + 0.0
        near = np.isfinite(K) & ((np.abs(np.abs(z - np.trunc(z)) - 0.5) < 1e-3) | (np.abs(z) > 2.0**40))
    out[near] = [float(Decimal(repr(v)).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP)) + 0.0 if abs(v) < 1e16 else v for v in K[near].tolist()]
    out[~np.isfinite(K)] = K[~np.isfinite(K)]
    return out


def _bunches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= BUNCH:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


def kernel_by_place(df: DataFrame, mlp: Mlp, chosen: str = "true", digits: int | None = None) -> DataFrame:
    """ids of equal rows, and the kernel between them and the rows that ``chosen`` selects, in the order of their ids.

    Rows are stored in ranges of x, so a task has few places (equal rows are
    one), and a place is met with the chosen side's places once a task. All get
    that side's places and, for each of its rows, the number of its place: less
    than a row of the result, which is as long as the side. Nothing of the kernel
    is shuffled. ``digits`` rounds it before it is spread over equal rows.
    """
    rows = ranged(stored(df.select("id", "x", F.expr(chosen).alias("_chosen")), "rows"), "x", "id")
    side = rows.filter("_chosen")
    places = stored(side.select("x").distinct().withColumn("place", F.monotonically_increasing_id()), "places")
    known = places.orderBy("place").toArrow()
    at = side.join(places, "x").orderBy("id").select("place").toArrow()
    numbers = np.searchsorted(known["place"].to_numpy(), at["place"].to_numpy()).astype(np.int32)
    shared = df.sparkSession.sparkContext.broadcast((mlp, matrix(known["x"].combine_chunks()) if len(known) else np.zeros((0, 0)), numbers))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mlp, places, at = shared.value
        step = max(1, HELD // max(1, len(at)))
        for own in _bunches(batches):
            X, same = np.unique(matrix(own["x"].combine_chunks()), axis=0, return_inverse=True)
            ids = own["id"].combine_chunks().take(pa.array(np.argsort(same.reshape(-1), kind="stable")))
            ends = np.concatenate([[0], np.cumsum(np.bincount(same.reshape(-1), minlength=len(X)))])
            for k in range(0, len(X), step):
                part, of = X[k : k + step], ends[k : k + step + 1]
                K = np.hstack([np.zeros((len(part), 0)), *[mlp.kernel(part, places[c : c + BLOCK]) for c in range(0, len(places), BLOCK)]])
                K = (K if digits is None else _rounded(K, digits))[:, at].reshape(-1)
                lists = [(of - of[0], ids.slice(of[0], of[-1] - of[0])), (np.arange(len(part) + 1) * len(at), K)]
                yield pa.record_batch([pa.ListArray.from_arrays(pa.array(e, pa.int32()), v) for e, v in lists], ["ids", "kernel"])

    return rows.select("id", "x").mapInArrow(run, f"ids array<{df.schema['id'].dataType.simpleString()}>, kernel array<double>")


def kernel(df: DataFrame, mlp: Mlp, chosen: str = "true", digits: int | None = None) -> DataFrame:
    """F04 among rows: id and the kernel between each row and the rows that ``chosen`` selects, in the order of their ids."""
    # Generated code holds all rows of an explode at once; with a lambda in it they come one by one.
    return kernel_by_place(df, mlp, chosen, digits).select(F.explode(F.transform("ids", lambda i: i)).alias("id"), "kernel")


def loglikelihood(df: DataFrame, mlp: Mlp) -> DataFrame:
    """id and the log probability of each row's label under the network's softmax."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                z = mlp.forward(np.array(b["x"].tolist(), float))[-1]
                top = z.max(axis=1)
                yield pd.DataFrame({"id": b["id"], "value": z[np.arange(len(b)), b["y"]] - top - np.log(np.exp(z - top[:, None]).sum(axis=1))})

    return df.select("id", "x", "y").mapInPandas(run, f"id {df.schema['id'].dataType.simpleString()}, value double")


def fisher(df: DataFrame, mlp: Mlp, regul: float = 0.0, by_layer: bool = False) -> np.ndarray | list[np.ndarray]:
    """Sum of J' V J over rows of a softmax network, biases penalised too; or the blocks of each layer."""
    p = mlp.num_params

    def work(b: pd.DataFrame) -> np.ndarray:
        X = np.array(b["x"].tolist(), float)
        J, z = mlp.jacobian(X), mlp.forward(X)[-1]
        e = np.exp(z - z.max(axis=1, keepdims=True))
        q = e / e.sum(axis=1, keepdims=True)
        V = np.einsum("nk,kl->nkl", q, np.eye(q.shape[1])) - np.einsum("nk,nl->nkl", q, q)
        return np.einsum("nkp,nkl,nlq->pq", J, V, J, optimize=True).reshape(-1)

    full = _partial_sums(df, ["x"], work, p * p).reshape(p, p) + regul * np.eye(p)
    if not by_layer:
        return full
    out, at = [], 0
    for w, b in mlp.layers:
        n = w.size + b.size
        out.append(full[at : at + n, at : at + n])
        at += n
    return out
