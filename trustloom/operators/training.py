"""Perceptrons trained here, data-parallel, with their epochs as stages. (S05, Z05; D13 to D18 over a network)

The parameters sit on the driver and go out with each step; tasks back-propagate
Arrow batches in numpy and one aggregation adds up their gradients. Mini-batches
are dealt by a hash of the id and stored apart, so a step reads its own rows
alone. A trained network scores, and gives its gradients, as column expressions.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trustloom.functions import expr as E
from trustloom.operators.linear import LinearModel, _partial_sums
from trustloom.operators.networks import Mlp, neural_random_features
from trustloom.operators.staged import Scores, staged_fit
from trustloom.sources.store import shared_dir


class Network(Scores):
    """A perceptron with its loss: "log_loss" over one raw output (two classes) or a softmax, or "squared"."""

    def __init__(self, mlp: Mlp, loss: str = "log_loss", regul: float = 0.0) -> None:
        self.mlp, self.loss, self.regul = mlp, loss, regul

    @property
    def outputs(self) -> int:
        return len(self.mlp.layers[-1][1])

    def parameter_count(self) -> int:
        return sum(int(np.count_nonzero(w)) + int(np.count_nonzero(b)) for w, b in self.mlp.layers)

    # Columns -----------------------------------------------------------------------------------------

    def _act(self, z: Column) -> Column:
        each = {"logistic": E.logistic, "tanh": F.tanh, "relu": lambda v: F.greatest(v, F.lit(0.0)), "identity": lambda v: v}[self.mlp.activation]
        return F.transform(z, each)

    def _slope(self, a: Column) -> Column:
        each = {"logistic": lambda v: v * (1.0 - v), "tanh": lambda v: 1.0 - v * v, "relu": lambda v: (v > 0).cast("double"), "identity": lambda v: F.lit(1.0)}[self.mlp.activation]
        return F.transform(a, each)

    def _through(self, x: Column, of: Callable[[list[Column]], Column]) -> Column:
        """``of`` the activations of all layers, each evaluated once; the last is raw."""

        def layer(k: int, acts: list[Column]) -> Column:
            if k == len(self.mlp.layers):
                return of(acts)
            w, b = self.mlp.layers[k]
            z = E.linear(acts[-1], E.matrix(w.T), E.doubles(b))
            return E.let(z if k == len(self.mlp.layers) - 1 else self._act(z), lambda a: layer(k + 1, [*acts, a]))

        return layer(0, [x])

    def decision(self, x: Column) -> Column:
        return self._through(x, lambda acts: acts[-1])

    def margin(self, x: Column) -> Column:
        return F.get(self.decision(x), F.lit(0))

    def logits(self, x: Column) -> Column:
        return super().logits(x) if self.outputs == 1 else self.decision(x)

    def probabilities(self, x: Column) -> Column:
        return super().probabilities(x) if self.outputs == 1 else E.softmax(self.decision(x))

    def predictions(self, x: Column) -> Column:
        if self.loss == "squared":
            return self.margin(x)
        return super().predictions(x) if self.outputs == 1 else E.argmax(self.decision(x))

    def _residual(self, z: Column, y: Column) -> Column:
        """The loss's derivatives by the raw outputs."""
        if self.loss == "squared":
            return F.transform(z, lambda v: v - y)
        if self.outputs == 1:
            return F.transform(z, lambda v: E.logistic(v) - y)
        return F.zip_with(E.softmax(z), E.one_hot(y, self.outputs), lambda p, t: p - t)

    def _backward(self, acts: list[Column], y: Column, of: Callable[[list[Column]], Column]) -> Column:
        """``of`` the loss's derivatives by each layer's raw values, first layer first."""

        def layer(k: int, deltas: list[Column]) -> Column:
            if k == 0:
                return of(deltas)
            back = F.transform(E.matrix(self.mlp.layers[k][0]), lambda w: E.dot(deltas[0], w))
            return E.let(F.zip_with(back, self._slope(acts[k]), lambda u, v: u * v), lambda d: layer(k - 1, [d, *deltas]))

        return E.let(self._residual(acts[-1], y), lambda d: layer(len(self.mlp.layers) - 1, [d]))

    def grad_norm(self, x: Column, y: Column) -> Column:
        """P50: the squared norm of a row's gradient by all parameters: of a layer, that of its input (and 1) times that of its derivatives."""

        def norms(acts: list[Column], deltas: list[Column]) -> Column:
            out = F.lit(0.0)
            for a, d in zip(acts, deltas):
                out = out + (E.norm2(a) + 1.0) * E.norm2(d)
            return out

        return self._through(x, lambda acts: self._backward(acts, y, lambda deltas: norms(acts, deltas)))

    def grad_x(self, x: Column, y: Column) -> Column:
        """The loss's derivatives by the features."""
        first = E.matrix(self.mlp.layers[0][0])
        return self._through(x, lambda acts: self._backward(acts, y, lambda deltas: F.transform(first, lambda w: E.dot(deltas[0], w))))

    # Batches -----------------------------------------------------------------------------------------

    def gradient(self, X: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The summed gradient by all parameters (per layer weights, then biases), the summed loss and the rows, flat."""
        acts = self.mlp.forward(X)
        z = acts[-1]
        if self.loss == "squared":
            delta, loss = z - y[:, None], 0.5 * ((z[:, 0] - y) ** 2).sum()
        elif self.outputs == 1:
            s = np.where(y > 0, z[:, 0], -z[:, 0])
            delta, loss = 0.5 * (1 + np.tanh(z / 2)) - y[:, None], np.logaddexp(0, -s).sum()
        else:
            top = z - z.max(axis=1, keepdims=True)
            logp = top - np.log(np.exp(top).sum(axis=1, keepdims=True))
            rows, k = np.arange(len(z)), y.astype(int)
            delta, loss = np.exp(logp), -logp[rows, k].sum()
            delta[rows, k] -= 1
        parts: list[np.ndarray] = []
        for k in range(len(self.mlp.layers) - 1, -1, -1):
            parts = [(acts[k].T @ delta).reshape(-1), delta.sum(axis=0), *parts]
            if k:
                delta = (delta @ self.mlp.layers[k][0].T) * self.mlp._slope(acts[k])
        return np.concatenate([*parts, [loss, len(z)]])

    def moved(self, step: np.ndarray) -> "Network":
        """The network with a flat ``step`` added to its parameters."""
        out, at = [], 0
        for w, b in self.mlp.layers:
            out.append((w + step[at : at + w.size].reshape(w.shape), b + step[at + w.size : at + w.size + b.size]))
            at += w.size + b.size
        return Network(Mlp(out, self.mlp.activation), self.loss, self.regul)

    def penalties(self) -> np.ndarray:
        """The penalty's gradient: of the weights, not of the biases."""
        return np.concatenate([p for w, b in self.mlp.layers for p in (self.regul * w.reshape(-1), np.zeros_like(b))])


@dataclass
class NetworkTraining:
    """A perceptron by gradient steps with momentum; a stage is an epoch.

    ``classes`` is 2 for one logistic output, more for a softmax, and None for a
    regression. An epoch takes ``batches`` steps, one a mini-batch, in an order
    drawn anew from ``seed`` for each epoch; one batch means full-batch steps.
    ``start`` is a network to go on from. Rows without features or label teach
    nothing; without any rows all stages are the start. A batch is whatever share
    of the rows its hash gives it, so it grows with the table and is spread over
    all tasks.
    """

    hidden: Sequence[int] = (8,)
    epochs: int = 5
    rate: float = 0.5
    batches: int = 1
    momentum: float = 0.0
    classes: int | None = 2
    regul: float = 0.0
    activation: str = "tanh"
    seed: int = 0
    start: Network | None = None

    def __post_init__(self) -> None:
        if self.epochs < 1 or self.batches < 1:
            raise ValueError("epochs and batches are positive")

    def stages(self, df: DataFrame) -> list[Network]:
        rows = df.filter("x is not null and y is not null")
        rows = rows.select("x", "y", F.pmod(F.xxhash64("id"), F.lit(self.batches)).cast("int").alias("batch"))
        rows = _by_batch(rows)
        first = rows.select("x").first()
        net = self.start
        if net is None:
            out = 1 if self.classes in (None, 2) else self.classes
            mlp = Mlp.init([len(first["x"]) if first else 1, *self.hidden, out], self.seed, self.activation)
            net = Network(mlp, "squared" if self.classes is None else "log_loss", self.regul)
        rng, speed, found = np.random.default_rng(self.seed), np.zeros(net.mlp.num_params), []
        for _ in range(self.epochs):
            for batch in rng.permutation(self.batches) if first else ():
                net, speed = self._step(rows.filter(F.col("batch") == int(batch)), net, speed)
            found.append(net)
        return found

    def _step(self, rows: DataFrame, net: Network, speed: np.ndarray) -> tuple[Network, np.ndarray]:
        def work(b: pd.DataFrame) -> np.ndarray:
            return net.gradient(np.array(b["x"].tolist(), float), b["y"].to_numpy(float))

        sums = _partial_sums(rows, ["x", "y"], work, net.mlp.num_params + 2)
        if not sums[-1]:  # a batch that the hash gave no row
            return net, speed
        speed = self.momentum * speed - self.rate * (sums[:-2] / sums[-1] + net.penalties())
        return net.moved(speed), speed

    def fit(self, df: DataFrame) -> Network:
        return self.stages(df)[-1]


def _by_batch(rows: DataFrame) -> DataFrame:
    """Stored with a folder a batch, so that a step reads its own alone."""
    path = f"{shared_dir(rows.sparkSession)}/batches"
    rows.write.partitionBy("batch").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


@staged_fit.register
def _(estimator: NetworkTraining, df: DataFrame):
    return estimator.stages(df)


def linearised(net: Network, df: DataFrame) -> tuple[LinearModel, DataFrame]:
    """The last layer as a linear model, and the rows with the last hidden layer as features; regressions too."""
    w, b = net.mlp.layers[-1]
    model = LinearModel(w.T.tolist(), b.tolist(), net.loss, net.regul or None, net.loss != "squared")
    return model, neural_random_features(df, net.mlp, ("y",)).withColumnRenamed("features", "x")
