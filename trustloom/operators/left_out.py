"""Leave-one-out of any model that learns row by row into a state that can be merged.

No state is ever taken apart, so a model needs no inverse update: rows are dealt
into parts of about ``ROWS`` rows, each part sums up itself, states of all rows
but a part's are had from merges in two rounds of about the root of the parts,
and within a part a binary tree of held-out halves takes the state down to each
row: a node's left half has also learnt the right half, and the other way round.
A row is learnt log(ROWS) + 2 times in place of n times.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trustloom.functions import expr as E
from trustloom.functions.probes import Probe
from trustloom.operators.paths import fit_logistic_newton
from trustloom.sources.store import stored

#: Rows of a part, about: what one task holds at a time.
ROWS = 2000


class Learner:
    """A model by its state: a tuple of arrays, bounded by the model and not by the rows. ``None`` has seen no row."""

    def learn(self, X: np.ndarray, y: np.ndarray):
        """The state of some rows."""
        raise NotImplementedError

    def merge(self, a, b):
        """The state of the rows of both; by default arrays that add up."""
        return tuple(p + q for p, q in zip(a, b))

    def scores(self, state, X: np.ndarray) -> np.ndarray:
        """n x outputs raw scores."""
        raise NotImplementedError

    def column(self, source: str, z: Column) -> Column:
        """A probe's source from the raw scores."""
        if source in ("scores", "logits"):
            return z
        return E.softmax(z) if source == "probabilities" else E.argmax(z)

    def ready(self, df: DataFrame) -> "Learner":
        """What must be known of all rows before any state is made."""
        return self


@dataclass
class LeftOutRidge(Learner):
    """A ridge regression with an intercept that isn't penalised: the Gram matrix of (x, 1, y)."""

    alpha: float = 1.0

    def learn(self, X, y):
        A = np.hstack([X, np.ones((len(X), 1)), y[:, None]])
        return (A.T @ A,)

    def scores(self, state, X):
        G = state[0]
        d = len(G) - 2
        w = np.linalg.pinv(G[:-1, :-1] + self.alpha * np.diag(np.append(np.ones(d), 0.0)), hermitian=True) @ G[:-1, -1]
        return X @ w[:d, None] + w[d]

    def column(self, source, z):
        return F.get(z, F.lit(0)) if source == "predictions" else z


@dataclass
class LeftOutGaussian(Learner):
    """Gaussian naive Bayes: count, mean and squared deviations of each class and feature, merged without cancellation.

    Variances are raised by ``floor``; a class that no other row has scores far below all others.
    """

    classes: int
    floor: float = 1e-3

    def learn(self, X, y):
        n, mean, dev = np.zeros(self.classes), np.zeros((self.classes, X.shape[1])), np.zeros((self.classes, X.shape[1]))
        for c in np.unique(y).astype(int):
            own = X[y == c]
            n[c], mean[c] = len(own), own.mean(axis=0)
            dev[c] = ((own - mean[c]) ** 2).sum(axis=0)
        return n, mean, dev

    def merge(self, a, b):
        n = a[0] + b[0]
        share = (b[0] / np.maximum(n, 1))[:, None]
        apart = b[1] - a[1]
        return n, a[1] + apart * share, a[2] + b[2] + apart**2 * share * a[0][:, None]

    def scores(self, state, X):
        n, mean, dev = state
        var = dev / np.maximum(n, 1)[:, None] + self.floor
        each = -0.5 * (np.log(2 * np.pi * var)[None] + (X[:, None] - mean[None]) ** 2 / var[None]).sum(axis=2)
        return np.where(n > 0, each + np.log(np.maximum(n, 1)), -1e300)


@dataclass
class LeftOutLogistic(Learner):
    """A two-class logistic with penalty regul / 2 |w|^2: each optimum from the derivatives of the summed loss at the whole fit.

    The optimum without a row lies about 1 / n away from the whole one; first to
    third derivatives add up, and a few Newton steps on their expansion find it.
    What is left out is of fourth order. The state has p^3 numbers, so p, with
    the intercept, is at most 64.
    """

    regul: float = 1.0
    at: np.ndarray | None = None

    def ready(self, df):
        model = fit_logistic_newton(df, self.regul)
        if len(model.coef[0]) > 63:
            raise ValueError("at most 63 features: the state holds third derivatives")
        return LeftOutLogistic(self.regul, np.array([*model.coef[0], model.intercept[0]]))

    def learn(self, X, y):
        A = np.hstack([X, np.ones((len(X), 1))])
        p = 0.5 * (1 + np.tanh(A @ self.at / 2))
        v = p * (1 - p)
        return A.T @ (p - y), A.T @ (A * v[:, None]), np.einsum("n,ni,nj,nk->ijk", v * (1 - 2 * p), A, A, A, optimize=True)

    def scores(self, state, X):
        g, H, third = state
        R, u = self.regul * np.diag(np.append(np.ones(len(g) - 1), 0.0)), np.zeros(len(g))
        for _ in range(20):
            Tu = third @ u
            move = np.linalg.pinv(H + R + Tu, hermitian=True) @ (g + H @ u + 0.5 * Tu @ u + R @ (self.at + u))
            u = u - move
            if np.abs(move).max() < 1e-12:
                break
        w = self.at + u
        return X @ w[:-1, None] + w[-1]

    def column(self, source, z):
        m = F.get(z, F.lit(0))
        if source == "probabilities":
            return E.let(E.logistic(m), lambda p: F.array(1.0 - p, p))
        return F.array(-m, m) if source in ("scores", "logits") else (m > 0).cast("int")


def _merged(learner: Learner, states: list):
    out = None
    for s in states:
        out = s if out is None else out if s is None else learner.merge(out, s)
    return out


def _all_but_each(learner: Learner, states: list, rest=None) -> list:
    """For each state the merge of ``rest`` and all others: prefixes merged with suffixes."""
    left, right = [rest], [None]
    for s in states[:-1]:
        left.append(_merged(learner, [left[-1], s]))
    for s in states[:0:-1]:
        right.append(_merged(learner, [right[-1], s]))
    return [_merged(learner, [a, b]) for a, b in zip(left, right[::-1])]


def left_out_scores(df: DataFrame, learner: Learner, rows: int = ROWS) -> DataFrame:
    """id, y, z: each row's raw scores under the model of all other rows.

    Rows without features or label are left aside; a lone row, which no other
    teaches, gets null. Rows are told apart by their place, so repeated rows
    count as often as they stand there.
    """
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    data = df.filter("x is not null and y is not null").select("id", "x", "y")
    parts = max(1, -(-data.count() // rows))
    data = stored(data.withColumn("part", F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.lit(parts)).cast("int")), "parts")
    learner = learner.ready(data)
    size = max(1, int(np.sqrt(parts)))

    def learnt(b: pd.DataFrame):
        return learner.learn(np.array(b["x"].tolist(), float), b["y"].to_numpy(float))

    def of_part(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"bunch": [key[0] // size], "part": [key[0]], "state": [pickle.dumps(learnt(b))]})

    def of_bunch(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"bunch": [key[0]], "state": [pickle.dumps(_merged(learner, list(map(pickle.loads, b["state"]))))]})

    def but_bunch(b: pd.DataFrame) -> pd.DataFrame:
        rest = _all_but_each(learner, list(map(pickle.loads, b["state"])))
        return pd.DataFrame({"bunch": b["bunch"], "rest": [pickle.dumps(s) for s in rest]})

    def but_part(b: pd.DataFrame) -> pd.DataFrame:
        rest = _all_but_each(learner, list(map(pickle.loads, b["state"])), pickle.loads(b["rest"].iloc[0]))
        return pd.DataFrame({"part": b["part"], "rest": [pickle.dumps(s) for s in rest]})

    def but_rows(b: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        X, y = np.array(b["x"].tolist(), float), b["y"].to_numpy(float)
        z: list = [None] * len(b)
        todo = [(0, len(b), pickle.loads(others["rest"].iloc[0]))] if len(b) else []
        while todo:
            low, high, state = todo.pop()
            if high - low == 1:
                z[low] = None if state is None else learner.scores(state, X[low:high])[0].tolist()
                continue
            mid = (low + high) // 2
            todo.append((low, mid, _merged(learner, [state, learner.learn(X[mid:high], y[mid:high])])))
            todo.append((mid, high, _merged(learner, [state, learner.learn(X[low:mid], y[low:mid])])))
        return pd.DataFrame({"id": b["id"], "y": b["y"], "z": z})

    states = stored(data.groupBy("part").applyInPandas(of_part, "bunch int, part int, state binary"), "states")
    bunches = states.groupBy("bunch").applyInPandas(of_bunch, "bunch int, state binary")
    rest = bunches.withColumn("whole", F.lit(0)).groupBy("whole").applyInPandas(but_bunch, "bunch int, rest binary")  # about the root of the parts
    others = states.join(rest, "bunch").groupBy("bunch").applyInPandas(but_part, "part int, rest binary")
    return data.groupBy("part").cogroup(others.groupBy("part")).applyInPandas(but_rows, f"id {kinds['id']}, y {kinds['y']}, z array<double>")


@dataclass
class LeftOutEnsemble:
    """E03 over any learner: a member for each row, trained on all others and probed on it alone."""

    learner: Learner
    rows: int = ROWS

    def probe(self, df: DataFrame, probe: Probe, **context) -> DataFrame:
        z = left_out_scores(df, self.learner, self.rows)
        score = F.array(probe.column(self.learner.column(probe.source, F.col("z")), F.col("y"), **context).cast("double"))
        return z.select("id", F.col("id").alias("member"), F.lit(True).alias("oob"), F.lit(1.0).alias("weight"), score.alias("score"))
