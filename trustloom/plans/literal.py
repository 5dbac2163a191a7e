"""Queries on literal trees, stumps and networks, with SQL written from the formulas.

Fits of trees and networks can't be repeated in SQL, but what is made of a fitted
one can: the models here are given, and the tests compare fitted ones with their
libraries. Gradient steps, AdaBoost and calibration are unrolled.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from trustloom.functions import probes as P
from trustloom.operators import aggregates as A
from trustloom.operators import decide as D
from trustloom.operators import detectors as T
from trustloom.operators import ensembles as N
from trustloom.operators import linear as L
from trustloom.operators import networks
from trustloom.operators import outliers as O
from trustloom.operators import staged as S
from trustloom.plans import base as B
from trustloom.plans import catalogue as C
from trustloom.plans import learners as K

query = C.query

# Literal models ----------------------------------------------------------------------------------

#: Trees on the stop-word indicators, for English or not.
TREES = [S.Split(0, 0.5, S.Split(3, 0.5, -0.25, -0.75, -0.25), 0.875, -0.25), S.Split(1, 0.5, 0.375, S.Split(2, 0.5, -0.5, -0.625)), S.Split(5, 0.5, 0.25, -0.5)]
WEIGHTS = [1.0, 0.5, 0.25]
BOOSTED = S.TreeSum(TREES, WEIGHTS)
STUMPS = S.StumpSum([(0, 0.9), (3, -0.7), (5, -0.4), (1, -0.3)])
#: Directions of seven features.
ALONG = [[0.6, 0.0, 0.0, 0.8, 0.0, 0.0, 0.0], [0.0, 0.6, 0.0, 0.0, 0.0, -0.8, 0.0]]
SIZES = [7, 3, 4]


def _weights(rows: int, columns: int, a: int, b: int):
    return np.array([[((i * a + j * b) % 11 - 5) / 10 for j in range(columns)] for i in range(rows)])


NET = networks.Mlp([(_weights(7, 3, 7, 3), _weights(1, 3, 1, 4)[0]), (_weights(3, 4, 5, 2), _weights(1, 4, 1, 3)[0])], "tanh")

# SQL pieces --------------------------------------------------------------------------------------

TWO = f"{C.LANG}, t as (select id, x, (y = 1)::integer as y from m)"
_TREE_SQL = [
    "(case when x[1] <= 0.5 then (case when x[4] <= 0.5 then -0.25 else -0.75 end) else 0.875 end)",
    "(case when x[2] <= 0.5 then 0.375 else (case when x[3] <= 0.5 then -0.5 else -0.625 end) end)",
    "(case when x[6] <= 0.5 then 0.25 else -0.5 end)",
]
_PREFIX = [" + ".join(f"2.0 * {w} * {t}" for w, t in zip(WEIGHTS[:k], _TREE_SQL)) for k in (1, 2, 3)]
STAGED = f"{TWO}, tm as ({' union all '.join(f'select id, x, y, {k}::integer as member, ({e})::double as z from t' for k, e in enumerate(_PREFIX))}), tp as (select *, 1 / (1 + exp(-z)) as p from tm)"
_STAGE = "id, member, false as oob, 1.0::double as weight"


def two(spark, sf):
    """English or not: what two-class models need."""
    return B.languages(spark, sf).select("id", "x", (F.col("y") == 1).cast("int").alias("y"))


def _boosted(steps: int = 1):
    return N.ProgressiveEnsemble(lambda df: BOOSTED, steps, "predict")


def _stream(probe, steps: int = 1):
    return lambda s, d: _boosted(steps).probe(two(s, d), probe)


# Stages ------------------------------------------------------------------------------------------

_PIPE = C._gd_sql().replace("b as (", "b0 as (", 1).replace(", w0 as", ", s0 as (select avg(x[1]) as m1, avg(x[2]) as m2, coalesce(nullif(stddev_pop(x[1]), 0), 1) as d1, coalesce(nullif(stddev_pop(x[2]), 0), 1) as d2 from b0), b as (select id, [(x[1] - m1) / d1, (x[2] - m2) / d2] as x, y from b0, s0), w0 as", 1)
query("S01_pipeline_stages", f"with {_PIPE} select id, round(sum({C._MB}), 6) + 0.0 as trust from st group by id")(lambda s, d: T.area_under_margin(S.Pipeline([S.standardised], S.GradientDescent(C.EPOCHS))).trust_score(C._kept(s, d)))
query("S02_boosting_aum", f"with {STAGED} select id, round(sum(case when y = 1 then 2 * z else -2 * z end), 6) + 0.0 as trust from tp group by id")(lambda s, d: T.ModelProbingDetector(_boosted(), P.margin(), "sum").trust_score(two(s, d)))
query("S03_boosting_confidence", f"with {STAGED} select id, round(avg(case when y = 1 then p else 1 - p end), 6) as trust from tp where member % 2 = 0 group by id")(lambda s, d: T.ModelProbingDetector(_boosted(2), P.confidence("probabilities"), "mean").trust_score(two(s, d)))
query("S10_staged_margin", f"with {STAGED} select {_STAGE}, [round(case when y = 1 then 2 * z else -2 * z end, 6) + 0.0] as score from tp")(_stream(P.margin()))
query("S11_staged_logits", f"with {STAGED} select {_STAGE}, [round(-z, 6) + 0.0, round(z, 6) + 0.0] as score from tp")(_stream(lambda m, x, y: m.logits(x)))
query("S12_staged_probabilities", f"with {STAGED} select {_STAGE}, [round(1 - p, 6), round(p, 6)] as score from tp")(_stream(lambda m, x, y: m.probabilities(x)))
query("S13_staged_predictions_forget", f"with {STAGED} select id, round(sum((pr > ac)::integer), 6) + 0.0 as value from (select id, ((z > 0)::integer = y)::integer as ac, coalesce(lag(((z > 0)::integer = y)::integer) over (partition by id order by member), -1) as pr from tp) group by id")(
    lambda s, d: A.FORGET.run(_boosted().probe(two(s, d), P.accuracy()))
)
_PART = [STUMPS.stumps[:k] for k in range(1, 5)]
_DIFF = lambda stumps, u: " + ".join(f"2.0 * {a!r} * {u[j]!r}" for j, a in stumps)
query(
    "S14_staged_finite_differences",
    f"with {TWO} " + " union all ".join(f"select id, {k}::integer as member, false as oob, 1.0::double as weight, [{', '.join(f'round(((case when y = 1 then 1 else -1 end) * ({_DIFF(part, u)}))::double, 6) + 0.0' for u in ALONG)}] as score from t" for k, part in enumerate(_PART)),
)(lambda s, d: N.ProgressiveEnsemble(lambda df: STUMPS, 1, "predict").probe(two(s, d), T.finite_difference_probe(P.confidence("logits"), ALONG)))

ROUNDS = 3


def _adaboost_sql(rounds: int = ROUNDS) -> str:
    """k<n>: feature and weight of round n; f: id, y, member, the sum so far."""
    out, score = f"{TWO}, j as (select unnest(range(1, 8)) as j)", "0.0"
    frm = "t"
    for n in range(1, rounds + 1):
        out += f""",
e{n} as materialized (select j, sum(w * s * (2 * x[j] - 1)) / sum(w) as r from (select x, 2.0 * y - 1 as s, exp(-(2.0 * y - 1) * ({score})) as w from {frm}), j group by j),
k{n} as materialized (select j as j{n}, 0.5 * ln((1 + r) / (1 - r)) as a{n} from (select j, greatest(least(r, 1 - 1e-9), -1 + 1e-9) as r from e{n} order by abs(round(r, 12)) desc, j limit 1))"""
        frm += f", k{n}"
        score += f" + a{n} * (2.0 * x[j{n}] - 1)"
    parts = score.split(" + ")[1:]
    return out + ", f as (" + " union all ".join(f"select id, y, {n} as member, {' + '.join(parts[: n + 1])} as z from {frm}" for n in range(rounds)) + ")"


query("S04_adaboost_aum", f"with {_adaboost_sql()} select id, round(sum(case when y = 1 then 2 * z else -2 * z end), 6) + 0.0 as trust from f group by id")(lambda s, d: T.area_under_margin(S.BoostedStumps(ROUNDS)).trust_score(two(s, d)))
query("S04b_adaboost_predict_staging", f"with {_adaboost_sql()} select id, round(sum(case when y = 1 then 2 * z else -2 * z end), 6) + 0.0 as trust from f group by id")(lambda s, d: T.area_under_margin(S.BoostedStumps(ROUNDS), staging="predict").trust_score(two(s, d)))
_DEPTHS = ["-0.25", "(case when x[1] <= 0.5 then -0.25 else 0.875 end)", _TREE_SQL[0]]
query(
    "S06_tree_depth_forget",
    f"with {TWO}, g as ({' union all '.join(f'select id, {k} as member, (({e} > 0)::integer = y)::integer as ac from t' for k, e in enumerate(_DEPTHS))}) select id, round(sum((pr > ac)::integer), 6) + 0.0 as value from (select id, ac, coalesce(lag(ac) over (partition by id order by member), -1) as pr from g) group by id",
)(lambda s, d: A.FORGET.run(N.ProgressiveEnsemble(lambda df: [S.TreeSum([S.pruned(TREES[0], k)], [1.0]) for k in range(3)]).probe(two(s, d), P.accuracy())))

# Complexity and features -------------------------------------------------------------------------

_LEAF = [
    "(case when x[1] <= 0.5 then (case when x[4] <= 0.5 then 0 else 1 end) else 2 end)",
    "(case when x[2] <= 0.5 then 0 else (case when x[3] <= 0.5 then 1 else 2 end) end)",
    "(case when x[6] <= 0.5 then 0 else 1 end)",
]
_HOT = ", ".join(f"({e} = {k})::integer::double" for e, n in zip(_LEAF, (3, 3, 2)) for k in range(n))
query("F01_tree_projections", f"with {TWO} select id, [{_HOT}] as x from t")(lambda s, d: K.leaf_features(BOOSTED, two(s, d)).select("id", "x"))

_W1, _B1 = NET.layers[0]
_W2, _B2 = NET.layers[1]
_HID = ", ".join("tanh(" + " + ".join(f"x[{i + 1}] * {float(_W1[i, j])!r}" for i in range(7)) + f" + {float(_B1[j])!r})" for j in range(3))
NETSQL = f"{C.LANG}, h as (select id, x, y, [{_HID}] as h from m), o as (select *, [{', '.join(' + '.join(f'h[{j + 1}] * {float(_W2[j, k])!r}' for j in range(3)) + f' + {float(_B2[k])!r}' for k in range(4))}] as o from h)"


def _jacobian_sql(k: int) -> list[str]:
    """Derivatives of output k by the weights and biases, layer by layer."""
    slope = lambda j: f"(1 - h[{j + 1}] * h[{j + 1}]) * {float(_W2[j, k])!r}"
    first = [f"x[{i + 1}] * {slope(j)}" for i in range(7) for j in range(3)] + [slope(j) for j in range(3)]
    return first + [f"h[{j + 1}]" if o == k else "0.0" for j in range(3) for o in range(4)] + ["1.0" if o == k else "0.0" for o in range(4)]


_JAC = [_jacobian_sql(k) for k in range(4)]
_FLAT = ", ".join(e for k in range(4) for e in _JAC[k])
query("F02_neural_tangent_features", f"with {NETSQL} select id, list_transform([{_FLAT}]::double[], lambda v: round(v, 6) + 0.0) as features from h")(lambda s, d: networks.neural_tangent_features(B.languages(s, d), NET))
query("F03_neural_random_features", f"with {NETSQL} select id, list_transform(h, lambda v: round(v, 6) + 0.0) as features from h")(lambda s, d: networks.neural_random_features(B.languages(s, d), NET))
query("F04_neural_tangent_kernel", f"with {NETSQL}, j as (select id, [{_FLAT}]::double[] as f from h) select a.id, list(round(list_dot_product(a.f, b.f), 6) + 0.0 order by b.id) as kernel from j as a, j as b group by a.id", rounds=False)(
    lambda s, d: networks.kernel(B.languages(s, d), NET, digits=6)
)
query("F08_loglikelihood", f"with {NETSQL} select id, round(o[y + 1] - list_max(o) - ln(list_sum(list_transform(o, lambda v: exp(v - list_max(o))))), 6) + 0.0 as value from o")(lambda s, d: networks.loglikelihood(B.languages(s, d), NET))
_VJ = " + ".join(f"{a} * p[{k + 1}] * ((case when {k} = {l} then 1 else 0 end) - p[{l + 1}]) * {b}" for k, a in enumerate(["j[{q} + {k0}]".replace("{k0}", str(k * 40)) for k in range(4)]) for l, b in enumerate([f"j[{{q}} + {l * 40}]" for l in range(4)]))
query(
    "Z06_mlp_fisher",
    f"""with {NETSQL}, j as (select id, [{_FLAT}]::double[] as j, list_transform(o, lambda v: exp(v - list_max(o)) / list_sum(list_transform(o, lambda u: exp(u - list_max(o))))) as p from o),
q as (select unnest(range(1, 41)) as q) select (q - 1)::integer as parameter, round(sum({_VJ.replace('{q}', 'q')}) + 0.1, 6) as value from j, q group by q""",
)(lambda s, d: (lambda h: s.createDataFrame([(i, float(h[i, i])) for i in range(len(h))], "parameter int, value double"))(networks.fisher(B.languages(s, d), NET, 0.1)))

# Outliers: isolation trees on two features, leaves are path lengths ---------------------------------

ISOLATION = O.Isolation([S.Split(0, 0.3, S.Split(1, 0.5, 3.5, 2.0), 1.0), S.Split(1, 0.25, 2.0, S.Split(0, 0.15, 3.0, 2.5))], 64)
_PATHS = "((case when x[1] <= 0.3 then (case when x[2] <= 0.5 then 3.5 else 2.0 end) else 1.0 end) + (case when x[2] <= 0.25 then 2.0 else (case when x[1] <= 0.15 then 3.0 else 2.5 end) end))"
query("P06b_isolation_forest", f"with {C.BIN} {C._v(f'-pow(2.0, -{_PATHS} / (2 * (2 * (ln(63.0) + 0.5772156649015329) - 126 / 64.0)))', 'b')}")(lambda s, d: B.binary(s, d).select("id", ISOLATION.score(F.col("x")).alias("value")))

# Linearised gradient descent: the inverse of the three-by-three Hessian in the open ----------------

_Z03 = f"""with {C._gd_sql()}, u as (select id, y, p, [x[1], x[2], 1.0] as t from st where member = {C.EPOCHS - 1}),
e as (select sum(p * (1 - p) * t[1] * t[1]) + 0.5 as a, sum(p * (1 - p) * t[1] * t[2]) as b, sum(p * (1 - p) * t[1]) as c, sum(p * (1 - p) * t[2] * t[2]) + 0.5 as d, sum(p * (1 - p) * t[2]) as e, sum(p * (1 - p)) as f from u),
i as (select *, d * f - e * e as a1, c * e - b * f as b1, b * e - c * d as c1, a * f - c * c as d1, b * c - a * e as e1, a * d - b * b as f1 from e),
v as (select i.*, a * a1 + b * b1 + c * c1 as det from i)
select id, round(-(p - y) * (p - y) * (a1 * t[1] * t[1] + d1 * t[2] * t[2] + f1 + 2 * (b1 * t[1] * t[2] + c1 * t[1] + e1 * t[2])) / det, 6) + 0.0 as trust from u, v"""


def _penalised(df):
    m = S.GradientDescent(C.EPOCHS).fit(df)
    return L.LinearModel(m.coef, m.intercept, m.loss, 0.5)


query("Z03_sgd_linearised", _Z03)(lambda s, d: T.self_influence(_penalised).trust_score(C._kept(s, d)))
_TWO_OUT = L.LinearModel([[0.2], [0.1]], [0.9, 0.8], "squared", 1.0, False)
query("L10_hat_matrix", f"with {C._RIDGE} select id, [[round(q, 6), 0.0], [0.0, round(q, 6)]]::double[][] as block from i")(lambda s, d: L.hat_blocks(B.parts(s, d), _TWO_OUT).select("id", F.transform("block", lambda r: F.transform(r, lambda v: F.round(v, 6) + 0.0)).alias("block")))

# Calibration: logistic maps of each class's probability, two gradient steps ------------------------

_CAL_STEPS = 2


def _calibration_sql() -> str:
    out = f"{C.SCORED}, hd as (select *, id % 4 = 0 as held from p)"
    for c in range(4):
        out += f", c{c}_0 as (select 0.0::double as a, 0.0::double as b)"
        for k in range(1, _CAL_STEPS + 1):
            out += f", c{c}_{k} as materialized (select any_value(a) - avg(g * v) as a, any_value(b) - avg(g) as b from (select a, b, p[{c + 1}] as v, 1 / (1 + exp(-(a * p[{c + 1}] + b))) - (y = {c})::integer as g from hd, c{c}_{k - 1} where held))"
    last = ", ".join(f"1 / (1 + exp(-(c{c}_{_CAL_STEPS}.a * p[{c + 1}] + c{c}_{_CAL_STEPS}.b)))" for c in range(4))
    return out + f", cq as (select id, y, [{last}] as q from hd, {', '.join(f'c{c}_{_CAL_STEPS}' for c in range(4))} where not held), cp as (select id, y, list_transform(q, lambda v: v / list_sum(q)) as p from cq)"


query("E06_calibrated_margin", f"with {_calibration_sql()} select id, round(p[y + 1] - list_max(list_filter(p, lambda v, i: i <> y + 1)), 6) + 0.0 as value from cp")(
    lambda s, d: A.TOTAL.run(N.CalibratedEnsemble(N.NoEnsemble(lambda df: B.MULTI), 4, F.pmod(F.col("id"), F.lit(4)) == 0, _CAL_STEPS).probe(B.languages(s, d), P.margin("probabilities")))
)

# A handler from end to end: folds, quantile, and naive Bayes on the rows that are left -------------

_H00 = f"""with {C._nb_sql(5, 1)}, tr as (select id, y, avg(p[y + 1]) filter (where oob) as trust from np group by id, y), qq as (select quantile_cont(trust, 0.05) as q from tr),
kp as (select m.id, m.x, m.y from m join tr using (id), qq where trust >= q),
kn as (select c, count(*) filter (where y = c)::double as n, count(*)::double as t from kp, c group by c),
ks as (select c, j, coalesce(sum(x[j]) filter (where y = c), 0) as s from kp, c, j group by c, j),
kz as (select id, c, any_value(ln((n + 1) / (t + 4))) + sum(case when x[j] > 0 then ln((s + 1) / (n + 2)) else ln(1 - (s + 1) / (n + 2)) end) as z from m, kn join ks using (c) group by id, c)
select id, (list_position(list(round(z, 9) order by c), max(round(z, 9))) - 1)::integer as prediction from kz group by id"""


@query("H00_handle_classifier", _H00)
def _handle(spark, sf):
    rows = B.languages(spark, sf)
    h = D.HandleClassifier(T.confident_learning(4, 5, 1), D.QuantileSplitter(0.05), lambda df, k: L.fit_naive_bayes(df, k)[0]).run(rows)
    return h.predict(rows).select("id", F.col("prediction").cast("int").alias("prediction"))
