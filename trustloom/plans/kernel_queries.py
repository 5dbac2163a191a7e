"""Queries on kernel maps and the one-class machine, and SQL from their formulas."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from trustloom.operators import kernels as R
from trustloom.operators.truth import KernelLogistic, truth_grid
from trustloom.plans import base as B
from trustloom.plans import catalogue as C
from trustloom.sources.store import stored

query = C.query

#: A literal map of three frequencies, and two literal landmarks.
FREQUENCIES, PHASES = [[2.0, -1.0], [0.5, 3.0], [-1.5, 1.0]], [0.3, 1.1, 2.7]
LANDMARKS, GAMMA = [[0.1, 0.5], [0.3, 0.2]], 2.0
NU, STEPS = 0.1, 3

_COS = ", ".join(f"{math.sqrt(2 / 3)!r} * cos({C._dot('x', w)} + {b!r})" for w, b in zip(FREQUENCIES, PHASES))
_Z = f"{C.BIN}, z as (select id, [{_COS}]::double[] as z from b)"
query("F10_random_fourier", f"with {_Z} select id, list_transform(z, lambda v: round(v, 6) + 0.0) as value from z")(
    lambda s, d: B.binary(s, d).select("id", R.fourier_map(FREQUENCIES, PHASES)(F.col("x")).alias("value"))
)

_K = math.exp(-GAMMA * sum((a - b) ** 2 for a, b in zip(*LANDMARKS)))
_SAME, _OTHER = ((1 / math.sqrt(1 + _K) + sign / math.sqrt(1 - _K)) / 2 for sign in (1, -1))
_near = lambda p: f"exp(-{GAMMA} * ((x[1] - {p[0]}) * (x[1] - {p[0]}) + (x[2] - {p[1]}) * (x[2] - {p[1]})))"
query(
    "F11_nystroem",
    f"with {C.BIN}, k as (select id, {_near(LANDMARKS[0])} as k1, {_near(LANDMARKS[1])} as k2 from b) select id, [round({_SAME!r} * k1 + {_OTHER!r} * k2, 6) + 0.0, round({_OTHER!r} * k1 + {_SAME!r} * k2, 6) + 0.0] as value from k",
)(lambda s, d: B.binary(s, d).select("id", R.nystroem_map(LANDMARKS, GAMMA)(F.col("x")).alias("value")))


def _one_class_sql() -> str:
    """w<n>: the weights after step n, by conditional gradients."""
    out = f"{_Z}, w0 as (select {', '.join(f'avg(z[{j}]) as a{j}' for j in (1, 2, 3))} from z)"
    dot = "(z[1] * a1 + z[2] * a2 + z[3] * a3)"
    for t in range(STEPS):
        step = 2 / (t + 3)
        out += f""",
q{t} as (select quantile_disc({dot}, {NU}) as q from z, w{t}),
w{t + 1} as materialized (select {', '.join(f'any_value(a{j}) + {step!r} * (avg(z[{j}]) - any_value(a{j})) as a{j}' for j in (1, 2, 3))} from z, w{t}, q{t} where {dot} <= q)"""
    return out + f", s as (select id, {dot} as s from z, w{STEPS})"


def _one_class(spark, sf):
    rows = stored(B.binary(spark, sf), "labelled")
    machine = R.OneClassSvm(NU, lambda df: R.fourier_map(FREQUENCIES, PHASES), STEPS).fit(rows)
    return rows.select("id", machine.score(F.col("x")).alias("value"))


query("P06c_one_class", f"with {_one_class_sql()}, o as (select quantile_cont(s, {NU}) as o from s) select id, round(s - o, 6) + 0.0 as value from s, o")(_one_class)

#: The grid of a ground truth, and the one landmark, in standardised features, of the map behind its logistic.
BINS, LOW, HIGH, CENTRE, WIDTH, NEWTON = (10, 8), (0.0, 0.0), (1.0, 1.0), [0.5, -0.25], 0.5, 15


def _truth_sql() -> str:
    """n<k>: weight and intercept after Newton step k; p(y | x) at the middle of each cell that has rows."""
    near = lambda a, b: f"exp(-{WIDTH} * (pow(({a} - m1) / s1 - {CENTRE[0]}, 2) + pow(({b} - m2) / s2 - {CENTRE[1]}, 2)))"
    out = f"""with {C.BIN}, s as (select {', '.join(f'avg(x[{i}]) as m{i}, stddev_pop(x[{i}]) as s{i}' for i in (1, 2))} from b),
k as (select y, {near('x[1]', 'x[2]')} as k from b, s), n0 as (select 0.0::double as w, 0.0::double as c)"""
    for t in range(NEWTON):
        out += f""",
g{t} as materialized (select any_value(w) as w, any_value(c) as c, sum(k * (q - y)) + any_value(w) as gw, sum(q - y) as gc, sum(k * k * q * (1 - q)) + 1 as hw, sum(k * q * (1 - q)) as hk, sum(q * (1 - q)) as hc
  from (select k, y, w, c, 1 / (1 + exp(-(k * w + c))) as q from k, n{t})),
n{t + 1} as materialized (select w - dw / greatest(1, greatest(abs(dw), abs(dc)) / 5) as w, c - dc / greatest(1, greatest(abs(dw), abs(dc)) / 5) as c
  from (select w, c, (hc * gw - hk * gc) / (hw * hc - hk * hk) as dw, (hw * gc - hk * gw) / (hw * hc - hk * hk) as dc from g{t}))"""
    middle = [f"({name} + 0.5) * {(HIGH[i] - LOW[i]) / BINS[i]!r}" for i, name in enumerate("ij")]
    return out + f""",
e as (select floor(x[1] * {BINS[0]}.0)::integer as i, floor(x[2] * {BINS[1]}.0)::integer as j from b),
h as (select i, j, count(*)::double as n from e where i between 0 and {BINS[0] - 1} and j between 0 and {BINS[1] - 1} group by i, j)
select i, j, round(n / (sum(n) over ()), 6) as p_x, round(1 / (1 + exp(-({near(*middle)} * w + c))), 6) as p_y from h, s, n{NEWTON}"""


def _truth(spark, sf):
    rows = stored(B.binary(spark, sf), "labelled")
    model = KernelLogistic(lambda df: R.nystroem_map([CENTRE], WIDTH)).fit(rows)
    return truth_grid(rows, model, BINS, LOW, HIGH)


query("G06b_kernel_truth", _truth_sql())(_truth)
