"""Queries on networks trained here, and SQL that back-propagates through two hidden units step by step."""

from __future__ import annotations

from pyspark.sql import functions as F

from trustloom.functions import probes as P
from trustloom.operators import detectors as T
from trustloom.operators import ensembles as N
from trustloom.operators import linear as L
from trustloom.operators.networks import Mlp
from trustloom.operators.training import Network, NetworkTraining
from trustloom.plans import base as B
from trustloom.plans import catalogue as C
from trustloom.plans.learners import linearize
from trustloom.sources.store import stored

query = C.query
EPOCHS, RATE = 3, 0.5


def _start(inputs: int, loss: str) -> Network:
    return Network(Mlp.init([inputs, 2, 1], seed=3), loss)


def _training(inputs: int, loss: str) -> NetworkTraining:
    return NetworkTraining(epochs=EPOCHS, rate=RATE, classes=2 if loss == "log_loss" else None, start=_start(inputs, loss))


def _sql(inputs: int, loss: str) -> str:
    """w0 .. w<epochs>: the parameters after each step; st: of all rows and stages the hidden units, output, residual and derivatives."""
    (w, b), (v, c) = _start(inputs, loss).mlp.layers
    names = [f"a{i}{j}" for i in range(inputs) for j in (1, 2)] + ["b1", "b2", "v1", "v2", "c"]
    first = [*w.reshape(-1), *b, *v.reshape(-1), *c]
    hidden = [f"tanh({' + '.join(f'x{i} * a{i}{j}' for i in range(inputs))} + b{j}) as h{j}" for j in (1, 2)]
    p = "1 / (1 + exp(-z))" if loss == "log_loss" else "z"
    means = [f"x{i} * d{j}" for i in range(inputs) for j in (1, 2)] + ["d1", "d2", "h1 * g", "h2 * g", "g"]

    def through(source: str) -> str:
        inner = f"select *, {', '.join(hidden)} from rows, {source}"
        return f"select *, g * v1 * (1 - h1 * h1) as d1, g * v2 * (1 - h2 * h2) as d2 from (select *, {p} - y as g from (select *, h1 * v1 + h2 * v2 + c as z from ({inner})))"

    rows = f"{C.BIN}, rows as (select id, x[1] as x0, x[2] as x1, y from b)" if inputs == 2 else f"{C.PART}, rows as (select id, x as x0, y from r)"
    out = f"{rows}, w0 as (select {', '.join(f'{float(f)!r}::double as {n}' for f, n in zip(first, names))})"
    for k in range(1, EPOCHS + 1):
        moved = ", ".join(f"any_value({n}) - {RATE} * avg({m}) as {n}" for n, m in zip(names, means))
        out += f", w{k} as materialized (select {moved} from ({through(f'w{k - 1}')}))"
    stages = " union all ".join(f"select {k - 1} as member, * from w{k}" for k in range(1, EPOCHS + 1))
    return f"{out}, ws as ({stages}), st as ({through('ws')})"


def _flat(net: Network) -> list[float]:
    return [float(v) for w, b in net.mlp.layers for v in (*w.reshape(-1), *b)]


def _stages(spark, rows, training):
    return spark.createDataFrame([(k, _flat(net)) for k, net in enumerate(training.stages(rows))], "member int, parameters array<double>")


_TWO = ["a01", "a02", "a11", "a12", "b1", "b2", "v1", "v2", "c"]
_ONE = ["a01", "a02", "b1", "b2", "v1", "v2", "c"]
_CLASS, _LINE = _training(2, "log_loss"), _training(1, "squared")
_list = lambda names: f"[{', '.join(f'round({n}, 6) + 0.0' for n in names)}]"

query("S05b_network_stages", f"with {_sql(2, 'log_loss')} select member::integer as member, {_list(_TWO)} as parameters from ws")(lambda s, d: _stages(s, B.binary(s, d), _CLASS))
query("S05c_network_regression_stages", f"with {_sql(1, 'squared')} select member::integer as member, {_list(_ONE)} as parameters from ws")(lambda s, d: _stages(s, B.parts(s, d), _LINE))
query("D13d_area_under_margin_network", f"with {_sql(2, 'log_loss')} select id, round(sum({C._MB}), 6) + 0.0 as trust from st group by id")(
    lambda s, d: T.area_under_margin(_CLASS).trust_score(stored(B.binary(s, d), "labelled"))
)
query("D14b_tracin_network", f"with {_sql(2, 'log_loss')} select id, round(-sum((x0 * x0 + x1 * x1 + 1) * (d1 * d1 + d2 * d2) + (h1 * h1 + h2 * h2 + 1) * g * g), 6) + 0.0 as trust from st group by id")(
    lambda s, d: T.tracin(_CLASS).trust_score(stored(B.binary(s, d), "labelled"))
)
query("D15b_forget_scores_network", f"with {_sql(2, 'log_loss')} select id, round(-sum((pr > ac)::integer), 6) + 0.0 as trust from (select id, {C._ACC} as ac, coalesce(lag({C._ACC}) over (partition by id order by member), -1) as pr from st) group by id")(
    lambda s, d: T.forget_scores(_CLASS).trust_score(stored(B.binary(s, d), "labelled"))
)
query("D18b_volg_network", f"with {_sql(2, 'log_loss')} select id, round(-(var_pop(a01 * d1 + a02 * d2) + var_pop(a11 * d1 + a12 * d2)) / 2, 6) + 0.0 as trust from st group by id")(
    lambda s, d: T.volg(_CLASS).trust_score(stored(B.binary(s, d), "labelled"))
)
query("E04b_progressive_regression", f"with {_sql(1, 'squared')} select id, round(-sum((y - z) * (y - z)), 6) + 0.0 as trust from st group by id")(
    lambda s, d: T.ModelProbingDetector(N.ProgressiveEnsemble(_LINE), P.l2(), "sum").trust_score(stored(B.parts(s, d), "labelled"))
)


def _linear(spark, sf):
    rows = stored(B.parts(spark, sf), "labelled")
    model, hidden = linearize(_LINE.fit(rows), rows)
    return hidden.select("id", L.representer(model, F.col("x"), F.col("y")).alias("representer"))


query("Z05b_network_linearised_regression", f"with {_sql(1, 'squared')} select id, round(abs(g) * (h1 * h1 + h2 * h2), 6) + 0.0 as representer from st where member = {EPOCHS - 1}")(_linear)
