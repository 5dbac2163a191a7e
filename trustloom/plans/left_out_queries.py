"""Leave-one-out queries, and SQL that takes each row's share out of the sums."""

from __future__ import annotations

from trustloom.functions import probes as P
from trustloom.operators import aggregates as A
from trustloom.operators import detectors as T
from trustloom.operators.left_out import LeftOutEnsemble, LeftOutGaussian, LeftOutLogistic, LeftOutRidge
from trustloom.plans import base as B
from trustloom.plans import catalogue as C

query = C.query


def _detector(learner, probe) -> T.ModelProbingDetector:
    return T.ModelProbingDetector(LeftOutEnsemble(learner), probe, A.oob("sum"))


query(
    "E03c_leave_one_out_ridge",
    f"""with {C.PART}, s as (select count(*)::double as n, avg(x) as mx, avg(y) as my, sum(x * x) - count(*) * avg(x) * avg(x) + 1.0 as q, sum(x * y) - count(*) * avg(x) * avg(y) as c from r)
select id, round(-abs((y - my - c / q * (x - mx)) / (1 - 1 / n - (x - mx) * (x - mx) / q)), 6) + 0.0 as trust from r, s""",
)(lambda s, d: _detector(LeftOutRidge(1.0), P.l1()).trust_score(B.parts(s, d)))


def _gaussian() -> str:
    """Count, sum and sum of squares of each class and feature, without the row where it is of the class."""
    each = "-0.5 * (ln(2 * pi() * v{0}) + pow(x[{0}] - m{0}, 2) / v{0})"
    moments = ", ".join(f"(s{i} - o * x[{i}]) / (n - o) as m{i}, (q{i} - o * x[{i}] * x[{i}]) / (n - o) - pow((s{i} - o * x[{i}]) / (n - o), 2) + 0.001 as v{i}" for i in (1, 2))
    return f"""with {C.BIN}, s as (select y as c, count(*)::double as n, {', '.join(f'sum(x[{i}]) as s{i}, sum(x[{i}] * x[{i}]) as q{i}' for i in (1, 2))} from b group by y),
l as (select id, x, y, c, (y = c)::integer as o, * exclude (c) from b, s),
m as (select id, x, y, c, n - o as n, {moments} from l),
z as (select id, y, c, ln(n) + {each.format(1)} + {each.format(2)} as z from m),
t as (select id, y, max(case when c = y then z end) as own, ln(sum(exp(z - top))) + any_value(top) as whole from (select *, max(z) over (partition by id) as top from z) group by id, y)
select id, round(ln(greatest(2.220446049250313e-16, least(1 - 2.220446049250313e-16, exp(own - whole)))), 6) + 0.0 as trust from t"""


query("E03d_leave_one_out_gaussian", _gaussian())(lambda s, d: _detector(LeftOutGaussian(2), P.cross_entropy()).trust_score(B.binary(s, d)))
query("E03e_leave_one_out_logistic")(lambda s, d: _detector(LeftOutLogistic(1.0), P.cross_entropy()).trust_score(B.binary(s, d)))
