"""Linear models by aggregates, their algebra, and the probes on gradients and influence.

Parameters are a few numbers on the driver; rows never leave the executors. The
Gram and Hessian matrices are sums: each partition adds up its share in numpy,
and one aggregation by matrix entry adds the shares.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trustloom.functions import expr as E


@dataclass
class LinearModel:
    """coef: a row of d weights for each of K outputs; intercept: K numbers or None."""

    coef: list[list[float]]
    intercept: list[float] | None = None
    loss: str = "log_loss"  #: or squared
    regul: float | None = None
    classifier: bool = True
    extra: dict = field(default_factory=dict)

    @property
    def outputs(self) -> int:
        return len(self.coef)

    @property
    def in_dim(self) -> tuple[int, int]:
        """(d + intercept, K); no reference class is dropped."""
        return len(self.coef[0]) + (self.intercept is not None), self.outputs

    @property
    def dof(self) -> int:
        return self.in_dim[0] * self.in_dim[1]

    def decision(self, x: Column) -> Column:
        """K raw scores."""
        return E.linear(x, E.matrix(self.coef), E.doubles(self.intercept or [0.0] * self.outputs))

    def link(self, x: Column) -> Column:
        """The model's expectation: identity, logistic, or softmax."""
        z = self.decision(x)
        if self.loss == "squared":
            return z
        return F.array(E.logistic(F.get(z, F.lit(0)))) if self.outputs == 1 else E.softmax(z)

    def probabilities(self, x: Column) -> Column:
        p = self.link(x)
        return F.array(1.0 - F.get(p, F.lit(0)), F.get(p, F.lit(0))) if self.outputs == 1 else p

    def logits(self, x: Column) -> Column:
        z = self.decision(x)
        return F.array(-F.get(z, F.lit(0)), F.get(z, F.lit(0))) if self.outputs == 1 else z

    def predictions(self, x: Column) -> Column:
        return E.argmax(self.logits(x)) if self.classifier else F.get(self.decision(x), F.lit(0))

    def score(self, source: str, x: Column) -> Column:
        """The score column of a probe's source."""
        if source == "probabilities":
            return self.probabilities(x)
        if source in ("logits", "scores"):
            return self.logits(x)
        if source == "predictions":
            return self.predictions(x)
        raise ValueError(f"a linear model has no {source}")

    def grad_y(self, x: Column, y: Column) -> Column:
        """P - y, K numbers."""
        p = self.link(x)
        if self.outputs == 1:
            return F.array(F.get(p, F.lit(0)) - y)
        return F.transform(p, lambda v, i: v - F.when(i == y, 1.0).otherwise(0.0))

    def grad_x(self, x: Column, y: Column) -> Column:
        """Gradient of the loss with respect to the features."""
        g, columns = self.grad_y(x, y), np.array(self.coef).T.tolist()
        return F.transform(E.matrix(columns), lambda w: E.dot(g, w))

    def grad_p(self, x: Column, y: Column) -> Column:
        """Gradient with respect to the parameters, feature-major, intercepts last."""
        g = self.grad_y(x, y)
        return F.concat(E.outer(x, g), g) if self.intercept is not None else E.outer(x, g)

    def variance(self, x: Column) -> Column:
        """L07 for one output: p (1 - p), or 1 for squared loss."""
        p = F.get(self.link(x), F.lit(0))
        return F.lit(1.0) if self.loss == "squared" else p * (1.0 - p)

    def objective(self, df: DataFrame) -> DataFrame:
        """Summed loss with the penalty, a row."""
        x, y = F.col("x"), F.col("y")
        if self.loss == "squared":
            row = 0.5 * F.pow(y - F.get(self.decision(x), F.lit(0)), F.lit(2.0))
        else:
            z = self.logits(x)
            if self.outputs == 1:
                z = F.array(F.lit(0.0), F.get(self.decision(x), F.lit(0)))
            row = E.logsumexp(z) - F.get(z, y)
        penalty = 0.5 * (self.regul or 0.0) * float(np.square(self.coef).sum())
        return df.agg((F.sum(row) + F.lit(penalty)).alias("objective"))

    def parameter_count(self) -> int:
        """Non-zero weights and intercepts."""
        return int(np.count_nonzero(self.coef)) + (int(np.count_nonzero(self.intercept)) if self.intercept is not None else 0)

    def param_norm(self) -> float:
        """Frobenius norm of the weights."""
        return float(np.linalg.norm(self.coef))

    # Numpy forms for several outputs, batch by batch ------------------------------------------

    def batch(self, X: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(expectation n x K, gradient n x K, features with the intercept's one)."""
        z = X @ np.array(self.coef).T + np.array(self.intercept or [0.0] * self.outputs)
        if self.loss == "squared":
            p = z
        elif self.outputs == 1:
            p = 1 / (1 + np.exp(-z))
        else:
            e = np.exp(z - z.max(axis=1, keepdims=True))
            p = e / e.sum(axis=1, keepdims=True)
        target = y.reshape(-1, 1) if self.outputs == 1 else np.eye(self.outputs)[y.astype(int)] if self.classifier else np.repeat(y.reshape(-1, 1), self.outputs, axis=1)
        Xt = np.hstack([X, np.ones((len(X), 1))]) if self.intercept is not None else X
        return p, p - target, Xt

    def variances(self, p: np.ndarray) -> np.ndarray:
        """N x K x K variances of the link."""
        n, k = p.shape
        if self.loss == "squared":
            return np.repeat(np.eye(k)[None], n, axis=0)
        if k == 1:
            return (p * (1 - p))[:, :, None]
        return np.einsum("nk,kl->nkl", p, np.eye(k)) - np.einsum("nk,nl->nkl", p, p)

    def jacobians(self, Xt: np.ndarray, V: np.ndarray) -> np.ndarray:
        """N x P x K derivatives of the link's outputs by the parameters."""
        n, d = Xt.shape
        return np.einsum("nd,nkl->ndkl", Xt, V).reshape(n, d * V.shape[1], V.shape[2])


def _partial_sums(df: DataFrame, columns: list[str], work, size: int) -> np.ndarray:
    """Sum over partitions of the flat array that ``work`` makes of each batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(size)
        for b in batches:
            if len(b):
                total += work(b)
        yield pd.DataFrame({"k": np.arange(size), "v": total})

    out = np.zeros(size)
    for r in df.select(*columns).mapInPandas(run, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect():  # one row an entry
        out[r["k"]] = r["v"]
    return out


def hessian(df: DataFrame, model: LinearModel) -> np.ndarray:
    """Sum of V x x' blocks, with the penalty on the weights alone."""
    d, k = model.in_dim
    p = d * k

    def work(b: pd.DataFrame) -> np.ndarray:
        X = np.array(b["x"].tolist(), float)
        e, _, Xt = model.batch(X, b["y"].to_numpy())
        return np.einsum("nkl,ni,nj->ikjl", model.variances(e), Xt, Xt).reshape(-1)

    h = _partial_sums(df, ["x", "y"], work, p * p).reshape(p, p)
    weights = len(model.coef[0]) * k
    h[np.arange(weights), np.arange(weights)] += model.regul or 0.0
    return h


def influence(df: DataFrame, model: LinearModel) -> DataFrame:
    """id with self_influence, leverage, cook, cook_bar, approximate_loo for any number of outputs.

    The Hessian of a softmax without penalty is singular, since no class is
    dropped: the pseudo-inverse is taken. (P53 to P56, L10)
    """
    inv = np.linalg.pinv(hessian(df, model), hermitian=True)
    dof, k = model.in_dim[0], model.outputs
    m = len(inv) // k
    flat = inv.reshape(m, k, m, k).transpose(0, 2, 1, 3).reshape(m, m * k * k)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            X = np.array(b["x"].tolist(), float)
            p, g, Xt = model.batch(X, b["y"].to_numpy())
            V = model.variances(p)
            # The weights of output k are every outputs-th parameter: forms of a row in the inverse, feature by feature.
            Q = np.einsum("nfk,nf->nk", (Xt @ flat).reshape(len(b), -1, model.outputs**2), Xt).reshape(len(b), model.outputs, model.outputs)
            own = -np.einsum("nk,nkl,nl->n", g, Q, g)
            w, U = np.linalg.eigh(V)
            root = np.einsum("nij,nj,nkj->nik", U, np.sqrt(np.clip(w, 0, None)), U)
            h = root @ Q @ root
            iroot = np.einsum("nij,nj,nkj->nik", U, np.where(w > 1e-12, 1 / np.sqrt(np.clip(w, 1e-12, None)), 0), U)
            r = np.einsum("nij,nj->ni", iroot, g)
            eye = np.eye(model.outputs)[None]
            a = np.linalg.solve(eye - h, h)
            left = np.linalg.solve(eye - h, r[:, :, None])[:, :, 0]
            cook = np.einsum("ni,nij,nj->n", left, h, left) / dof
            bar = np.einsum("ni,nij,nj->n", left, h, r) / dof
            # In this order: r'aa'r and r'a'r, as sums over pairs.
            loo = -0.5 * ((np.einsum("ni,nij->nj", r, a) ** 2).sum(axis=1) + 2 * np.einsum("nj,nj->n", np.einsum("nji,nj->ni", a, r), r))
            yield pd.DataFrame({"id": b["id"], "self_influence": own, "leverage": np.trace(h, axis1=1, axis2=2), "cook": cook, "cook_bar": bar, "approximate_loo": loo})

    return df.select("id", "x", "y").mapInPandas(run, "id long, self_influence double, leverage double, cook double, cook_bar double, approximate_loo double")


def hat_blocks(df: DataFrame, model: LinearModel) -> DataFrame:
    """Id and block, the C x C block of the hat matrix of each row: root(V) J H^-1 J' root(V)."""
    inv = np.linalg.pinv(hessian(df, model), hermitian=True)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                p, _, Xt = model.batch(np.array(b["x"].tolist(), float), np.zeros(len(b)))
                w, U = np.linalg.eigh(model.variances(p))
                root = np.einsum("nij,nj,nkj->nik", U, np.sqrt(np.clip(w, 0, None)), U)
                J = model.jacobians(Xt, np.repeat(np.eye(model.outputs)[None], len(b), axis=0))
                h = np.einsum("nik,npk,pq,nql,nlj->nij", root, J, inv, J, root, optimize=True)
                yield pd.DataFrame({"id": b["id"], "block": [list(map(list, x)) for x in h]})

    return df.select("id", "x").mapInPandas(run, "id long, block array<array<double>>")


def influence_one(df: DataFrame, model: LinearModel) -> DataFrame:
    """The same for one output, as column expressions over the inverse Hessian's literals."""
    inv = np.linalg.inv(hessian(df, model))
    x, y = F.col("x"), F.col("y")
    xt = F.concat(x, F.array(F.lit(1.0))) if model.intercept is not None else x
    q = E.dot(F.transform(E.matrix(inv.tolist()), lambda w: E.dot(xt, w)), xt)
    e = F.get(model.grad_y(x, y), F.lit(0))
    out = df.select("id", q.alias("q"), e.alias("e"), model.variance(x).alias("v"))
    out = out.select("id", "q", "e", (F.col("v") * F.col("q")).alias("h"), (F.col("e") * F.col("e") / F.col("v")).alias("r2"))
    h, r2, dof = F.col("h"), F.col("r2"), model.in_dim[0]
    a = h / (1.0 - h)
    return out.select(
        "id",
        (-F.col("e") * F.col("e") * F.col("q")).alias("self_influence"),
        h.alias("leverage"),
        (r2 * h / F.pow(1.0 - h, F.lit(2.0)) / dof).alias("cook"),
        (r2 * h / (1.0 - h) / dof).alias("cook_bar"),
        (-0.5 * r2 * (a * a + 2.0 * a)).alias("approximate_loo"),
    )


def grad_norm(model: LinearModel, x: Column, y: Column) -> Column:
    """P50: squared norm of the loss's gradient, without the intercept's part."""
    return E.norm2(model.grad_y(x, y)) * E.norm2(x)


def representer(model: LinearModel, x: Column, y: Column) -> Column:
    """|gradient at the observed class| times the row's squared norm."""
    g = model.grad_y(x, y)
    if model.loss == "squared":
        at = F.aggregate(g, F.lit(0.0), lambda a, v: a + F.abs(v))
    else:
        at = F.abs(F.get(g, F.lit(0) if model.outputs == 1 else y))
    return at * E.norm2(x)


def grad_similarity(df: DataFrame, model: LinearModel) -> DataFrame:
    """Id and the cosine between each row's gradient and the mean gradient."""
    rows = df.select("id", E.outer(F.col("x"), model.grad_y(F.col("x"), F.col("y"))).alias("g"))
    n = len(model.coef[0]) * model.outputs
    mean = rows.agg(F.array(*[F.avg(F.get("g", F.lit(k))) for k in range(n)]).alias("m"))
    out = rows.crossJoin(F.broadcast(mean))
    scale = F.sqrt(E.norm2(F.col("g")) * E.norm2(F.col("m")))
    return out.select("id", F.when(scale > 0, E.dot(F.col("g"), F.col("m")) / scale).otherwise(0.0).alias("value"))


# Fits ------------------------------------------------------------------------------------------


def fit_ridge(df: DataFrame, alpha: float = 1.0, intercept: bool = True, classifier: bool = False) -> LinearModel:
    """Normal equations from one pass of sums; classes become -1 and 1."""
    d = len(df.select("x").first()["x"])
    m = d + 1 + 1

    def work(b: pd.DataFrame) -> np.ndarray:
        y = b["y"].to_numpy(float)
        A = np.hstack([np.array(b["x"].tolist(), float), np.ones((len(b), 1)), (2 * y - 1 if classifier else y)[:, None]])
        return (A.T @ A).reshape(-1)

    S = _partial_sums(df, ["x", "y"], work, m * m).reshape(m, m)
    k = d + intercept
    A, b = S[:k, :k].copy(), S[:k, -1]
    A[np.arange(d), np.arange(d)] += alpha
    w = np.linalg.solve(A, b)
    return LinearModel([w[:d].tolist()], [float(w[d])] if intercept else None, "squared", alpha, classifier)


def fit_logistic_stages(df: DataFrame, epochs: int = 5, rate: float = 1.0, classes: int = 2, intercept: bool = True, regul: float = 0.0) -> list[LinearModel]:
    """Full-batch gradient descent; a stage is one step at a constant rate.

    One aggregation a stage; the frame should be stored or cached by the caller.
    """
    d = len(df.select("x").first()["x"])
    k = 1 if classes == 2 else classes
    model = LinearModel([[0.0] * d for _ in range(k)], [0.0] * k if intercept else None, "log_loss", regul or None)
    out = []
    for _ in range(epochs):
        g = model.grad_y(F.col("x"), F.col("y"))
        rows = df.select("x", g.alias("g"))
        sums = [F.avg(F.get("g", F.lit(c)) * (F.get("x", F.lit(j)) if j < d else F.lit(1.0))) for c in range(k) for j in range(d + intercept)]
        means = np.array(rows.agg(*sums).first(), float).reshape(k, d + intercept)
        w = np.array(model.coef) - rate * (means[:, :d] + regul * np.array(model.coef))
        b = (np.array(model.intercept) - rate * means[:, d]).tolist() if intercept else None
        model = LinearModel(w.tolist(), b, "log_loss", regul or None)
        out.append(model)
    return out


def fit_one_vs_rest(df: DataFrame, classes: int, fit: Callable[[DataFrame], LinearModel]) -> LinearModel:
    """A model of two classes for each class against the others; its scores side by side, by their logistics."""
    models = [fit(df.withColumn("y", (F.col("y") == c).cast("int"))) for c in range(classes)]
    return LinearModel([m.coef[0] for m in models], [m.intercept[0] if m.intercept else 0.0 for m in models], models[0].loss, models[0].regul)


def self_training(df: DataFrame, fit: Callable[[DataFrame], LinearModel], threshold: float = 0.75, rounds: int = 10) -> LinearModel:
    """Fit on labelled rows, label the rows of label -1 whose probability reaches ``threshold``, and fit again.

    Ends after ``rounds`` fits or when no row gets a label. Labels are columns
    of the models so far, so that no rows are moved.
    """
    model, label, known = fit(df.filter("y >= 0")), F.col("y"), None
    for _ in range(rounds - 1):
        p = model.probabilities(F.col("x"))
        label = F.when(label >= 0, label).when(F.array_max(p) >= threshold, E.argmax(p)).otherwise(F.lit(-1))
        rows = E.held(df.select("id", "x", "y"), y=label)
        n = rows.filter("y >= 0").count()
        if n == known:
            break
        known, model = n, fit(rows.filter("y >= 0"))
    return model


def fit_naive_bayes(df: DataFrame, classes: int, by: str | None = None, within: str | None = None, smoothing: float = 1.0) -> dict:
    """Bernoulli naive Bayes on 0/1 features, as linear models by member: 0, or the fold, or (repeat, fold).

    With ``by`` (a fold column) a model for each fold, trained on the other
    folds, of the same repeat where ``within`` names that column: one aggregation
    gives the counts of all, and a fold's are left out of its repeat's sums. A
    column sample_quality weighs the rows.
    """
    weight = F.col("sample_quality").cast("double") if "sample_quality" in df.columns else F.lit(1.0)
    d = len(df.select("x").first()["x"])
    keys = ["y", *[k for k in (within, by) if k]]
    rows = df.groupBy(*keys).agg(F.sum(weight).alias("n"), *[F.sum(weight * F.get("x", F.lit(j))).alias(f"c{j}") for j in range(d)]).collect()  # classes x folds rows
    members = sorted({(r[within], r[by]) if within else r[by] for r in rows}) if by else [0]
    out = {}
    for m in members:
        n, c = np.zeros(classes), np.zeros((classes, d))
        for r in rows:
            if by is None or (r[within] == m[0] and r[by] != m[1] if within else r[by] != m):
                n[r["y"]] += r["n"]
                c[r["y"]] += [r[f"c{j}"] for j in range(d)]
        theta = (c + smoothing) / (n + 2 * smoothing)[:, None]
        prior = np.log((n + smoothing) / (n.sum() + classes * smoothing))
        on, off = np.log(theta), np.log(1 - theta)
        out[m] = LinearModel((on - off).tolist(), (prior + off.sum(axis=1)).tolist())
    return out
