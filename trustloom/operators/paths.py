"""Penalties chosen by validation: ridge by folds or by leaving each row out, logistic by folds (RidgeCV, LogisticRegressionCV).

All folds and all penalties are had from the same passes: a ridge from one pass
of Grams by fold, each taken apart once for all its penalties; a logistic from
Newton steps on every fold and penalty at once.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from trustloom.operators.ensembles import folds
from trustloom.operators.linear import LinearModel, _partial_sums
from trustloom.sources.store import stored

Deal = Callable[[DataFrame], DataFrame]


def _frame(b: pd.DataFrame, classifier: bool) -> np.ndarray:
    """Features, a one and the target of a batch, side by side."""
    y = b["y"].to_numpy(float)
    return np.hstack([np.array(b["x"].tolist(), float), np.ones((len(b), 1)), (2 * y - 1 if classifier else y)[:, None]])


class _Parts:
    """A Gram of (x, 1, y) taken apart: centred features in their own axes, so that a penalty costs a division."""

    def __init__(self, S: np.ndarray, intercept: bool) -> None:
        self.n = S[-2, -2]
        self.mean, self.target = (S[:-2, -2] / self.n, S[-1, -2] / self.n) if intercept and self.n else (np.zeros(len(S) - 2), 0.0)
        A = S[:-2, :-2] - (self.n * np.outer(self.mean, self.mean) if intercept else 0)
        self.rhs = S[:-2, -1] - (self.n * self.mean * self.target if intercept else 0)
        self.value, self.axes = np.linalg.eigh(A)
        self.intercept = intercept

    def fit(self, alpha: float) -> np.ndarray:
        """Weights and the intercept."""
        w = self.axes @ ((self.axes.T @ self.rhs) / (np.maximum(self.value, 0) + alpha))
        return np.append(w, self.target - self.mean @ w)


def _model(w: np.ndarray, alpha: float, intercept: bool, classifier: bool) -> LinearModel:
    return LinearModel([w[:-1].tolist()], [float(w[-1])] if intercept else None, "squared", alpha, classifier)


def ridge_by_folds(df: DataFrame, alphas: Sequence[float], k: int = 5, intercept: bool = True, classifier: bool = False, deal: Deal | None = None) -> tuple[LinearModel, dict[float, float]]:
    """The ridge of the penalty with the least mean squared error on held-out folds, fitted on all rows; and each penalty's error.

    ``deal`` adds the column fold (0 to k - 1), by a hash of the id by default.
    One pass over the rows, whatever the folds and penalties. Of penalties that
    do equally well the larger one is taken.
    """
    rows = (deal or (lambda d: folds(d, k, stratify=None)))(df)
    first = df.select("x").first()
    d = len(first["x"]) if first else 0
    m = d + 2

    def work(b: pd.DataFrame) -> np.ndarray:
        A, fold = _frame(b, classifier), b["fold"].to_numpy()
        return np.stack([A[fold == f].T @ A[fold == f] for f in range(k)]).reshape(-1)

    S = _partial_sums(rows, ["x", "y", "fold"], work, k * m * m).reshape(k, m, m)
    whole, errors = S.sum(axis=0), dict.fromkeys(map(float, alphas), 0.0)
    for held in S:
        parts = _Parts(whole - held, intercept)
        for a in errors:
            v = np.append(parts.fit(a), -1.0)  # the residual of a row is its product with this
            errors[a] += float(v @ held @ v) / max(whole[-2, -2], 1)
    errors = {a: float(e) for a, e in errors.items()}
    best = min(errors, key=lambda a: (round(errors[a], 12), -a))
    return _model(_Parts(whole, intercept).fit(best), best, intercept, classifier), errors


def ridge_by_leave_one_out(df: DataFrame, alphas: Sequence[float], intercept: bool = True, classifier: bool = False) -> tuple[LinearModel, dict[float, float]]:
    """The same by leaving out each row, exactly: a residual over one less the row's leverage. Two passes for all penalties."""
    first = df.select("x").first()
    m = (len(first["x"]) if first else 0) + 2
    whole = _partial_sums(df, ["x", "y"], lambda b: ((A := _frame(b, classifier)).T @ A).reshape(-1), m * m).reshape(m, m)
    parts, alphas = _Parts(whole, intercept), [float(a) for a in alphas]
    fits = {a: parts.fit(a) for a in alphas}

    def work(b: pd.DataFrame) -> np.ndarray:
        A = _frame(b, classifier)
        along = ((A[:, :-2] - parts.mean) @ parts.axes) ** 2
        out = []
        for a in alphas:
            h = (1 / parts.n if intercept else 0) + along @ (1 / (np.maximum(parts.value, 0) + a))
            out.append((((A[:, -1] - A[:, :-1] @ fits[a]) / (1 - h)) ** 2).sum())
        return np.array(out)

    sums = _partial_sums(df, ["x", "y"], work, len(alphas)) / max(parts.n, 1)
    errors = dict(zip(alphas, map(float, sums)))
    best = min(errors, key=lambda a: (round(errors[a], 12), -a))
    return _model(fits[best], best, intercept, classifier), errors


def fit_logistic_newton(df: DataFrame, regul: float = 1.0, steps: int = 30, tolerance: float = 1e-9) -> LinearModel:
    """A two-class logistic with penalty regul / 2 |w|^2 on summed losses, to convergence."""
    return _newton(stored(df.selectExpr("x", "y", "0 as fold"), "rows"), [float(regul)], 0, steps, tolerance)[0][0]


def _newton(rows: DataFrame, reguls: list[float], k: int, steps: int, tolerance: float) -> list[list[LinearModel]]:
    """Models by fold left out (the last one leaves out none) and penalty: every pass steps all that haven't converged."""
    first = rows.select("x").first()
    d = len(first["x"]) if first else 0
    p, F_ = d + 1, k + 1
    w = np.zeros((F_, len(reguls), p))
    penalty = np.array(reguls)[None, :, None] * np.append(np.ones(d), 0.0)
    for _ in range(steps if first else 0):

        def work(b: pd.DataFrame, w=w) -> np.ndarray:
            X, y, fold = np.hstack([np.array(b["x"].tolist(), float), np.ones((len(b), 1))]), b["y"].to_numpy(float), b["fold"].to_numpy()
            out = np.zeros((F_, len(reguls), p + p * p))
            for f in range(F_):
                Xf, yf = (X[fold != f], y[fold != f]) if f < k else (X, y)
                for a in range(len(reguls)):
                    q = 1 / (1 + np.exp(-np.clip(Xf @ w[f, a], -500, 500)))
                    out[f, a, :p] = Xf.T @ (q - yf)
                    out[f, a, p:] = (Xf.T @ (Xf * (q * (1 - q))[:, None])).reshape(-1)
            return out.reshape(-1)

        sums = _partial_sums(rows, ["x", "y", "fold"], work, F_ * len(reguls) * (p + p * p)).reshape(F_, len(reguls), p + p * p)
        g = sums[..., :p] + penalty * w
        H = sums[..., p:].reshape(F_, len(reguls), p, p) + np.einsum("fap,pq->fapq", np.broadcast_to(penalty, w.shape), np.eye(p))
        move = np.einsum("fapq,faq->fap", np.linalg.pinv(H, hermitian=True), g)
        # A step of over 5 in the logit's units is cut: far from the optimum the curvature says little.
        move /= np.maximum(1, np.abs(move).max(axis=2, keepdims=True) / 5)
        w = w - move
        if np.abs(move).max() < tolerance:
            break
    return [[LinearModel([w[f, a, :d].tolist()], [float(w[f, a, d])], "log_loss", r) for a, r in enumerate(reguls)] for f in range(F_)]


def logistic_by_folds(df: DataFrame, reguls: Sequence[float], k: int = 5, steps: int = 30, tolerance: float = 1e-9, deal: Deal | None = None) -> tuple[LinearModel, dict[float, float]]:
    """The two-class logistic of the penalty with the least mean log loss on held-out folds; and each penalty's loss."""
    rows, reguls = stored((deal or (lambda d: folds(d, k)))(df).select("x", "y", "fold"), "folds"), [float(r) for r in reguls]
    models = _newton(rows, reguls, k, steps, tolerance)

    def work(b: pd.DataFrame) -> np.ndarray:
        X, y, fold = np.array(b["x"].tolist(), float), b["y"].to_numpy(float), b["fold"].to_numpy()
        out = np.zeros(len(reguls) + 1)
        for f in range(k):
            own = fold == f
            for a in range(len(reguls)):
                z = X[own] @ np.array(models[f][a].coef[0]) + models[f][a].intercept[0]
                out[a] += np.logaddexp(0, np.where(y[own] > 0, -z, z)).sum()
        out[-1] = len(b)
        return out

    sums = _partial_sums(rows, ["x", "y", "fold"], work, len(reguls) + 1)
    losses = {r: float(v / max(sums[-1], 1)) for r, v in zip(reguls, sums)}
    best = min(losses, key=lambda r: (round(losses[r], 12), -r))
    return models[k][reguls.index(best)], losses
