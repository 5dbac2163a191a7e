"""Queries by operator id, and DuckDB SQL written from the formulas for those that SQL expresses.

The SQL shares constants with the queries but none of their expressions: common
table expressions build the same base frames, and each query ends in its own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trustloom.functions import expr as E
from trustloom.functions import probes as P
from trustloom.operators import aggregates as A
from trustloom.operators import decide as D
from trustloom.operators import detectors as T
from trustloom.operators import ensembles as N
from trustloom.operators import linear as L
from trustloom.plans import base as B
from trustloom.plans import learners as K
from trustloom.sources import toy
from trustloom.sources.store import stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, rounds: bool = True):
    """Register a query; its doubles are rounded, unless it rounds them itself."""

    def add(f):
        QUERIES[name] = lambda spark, sf_dir: B.rounded(f(spark, sf_dir)) if rounds else f(spark, sf_dir)
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


# SQL pieces --------------------------------------------------------------------------------------


def _arr(v) -> str:
    return "[" + ", ".join(repr(float(a)) for a in v) + "]::double[]"


def _dot(x: str, w) -> str:
    return "(" + " + ".join(f"{x}[{k + 1}] * {float(a)!r}" for k, a in enumerate(w)) + ")"


_X = ", ".join(f"(case when contains(lower(text), ' {w} ') then 1.0 else 0.0 end)::double" for w in B.STOP)
LANG = f"""
m0 as (select doc_id as id, [{_X}] as x, list_position(['de','en','es','fr'], lang) - 1 as y0, (doc_id * 7919 + 13) % 50 = 0 as flipped from documents),
m as (select id, x, (case when flipped then (y0 + 1) % 4 else y0 end)::integer as y, flipped from m0)"""
SCORED = f"""{LANG},
z as (select *, [{', '.join(f'{_dot("x", w)} + {b!r}' for w, b in zip(B.COEF, B.INTERCEPT))}] as z from m),
p as (select *, list_transform(z, lambda v: exp(v - list_max(z)) / list_sum(list_transform(z, lambda u: exp(u - list_max(z))))) as p from z)"""
BIN = """
b as (select doc_id as id, [n_chars / 10000.0::double, (doc_id % 97) / 97.0::double]::double[] as x, quality::integer as y from labels join documents using (doc_id))"""
BINP = f"""{BIN},
bp as (select *, {_dot("x", B.BINARY.coef[0])} + {B.BINARY.intercept[0]!r} as z from b),
bq as (select *, 1 / (1 + exp(-z)) as p from bp)"""
PART = """
r as (select p_partkey as id, p_size / 50.0::double as x, p_retailprice / 1000.0::double as y from part)"""
EVENTS = """
e0 as (select user_id as id, row_number() over (partition by user_id order by ts, event_id)::integer as member, event_id % 3 = 0 as oob, (1.0 + event_id % 4)::double as w, value as s, value * value / 100.0 as s2 from events)"""


def _v(expr: str, frm: str = "p", name: str = "value") -> str:
    return f"select id, round({expr}, 6) + 0.0 as {name} from {frm}"


def scored(spark, sf):
    """Rows with z and p: scored once, and then shared by all probes."""
    rows = B.languages(spark, sf)
    rows = rows.withColumn("z", B.MULTI.decision(F.col("x")))
    return rows.withColumn("p", E.softmax(F.col("z")))


def _row(name: str, column, sql: str, source: str = "p"):
    query(name, f"with {SCORED} {sql}")(lambda spark, sf: scored(spark, sf).select("id", column(F.col(source), F.col("y")).alias("value")))


# Score sources and row probes --------------------------------------------------------------------

query("P01_probabilities", f"with {SCORED} select id, list_transform(p, lambda v: round(v, 6)) as value from p")(lambda s, d: scored(s, d).select("id", F.col("p").alias("value")))
query("P02_logits", f"with {BINP} select id, [round(-z, 6) + 0.0, round(z, 6) + 0.0] as value from bq")(lambda s, d: B.binary(s, d).select("id", B.BINARY.logits(F.col("x")).alias("value")))
query("P03_scores", f"with {SCORED} select id, list_transform(z, lambda v: round(v, 6) + 0.0) as value from z")(lambda s, d: B.languages(s, d).select("id", B.MULTI.score("scores", F.col("x")).alias("value")))
query("P04_predictions", f"with {SCORED} select id, (list_position(z, list_max(z)) - 1)::integer as value from z")(lambda s, d: B.languages(s, d).select("id", B.MULTI.predictions(F.col("x")).alias("value")))
query("P05_precomputed", f"with {SCORED} {_v('z[1] - z[2]', 'z')}")(lambda s, d: scored(s, d).select("id", (F.get("z", F.lit(0)) - F.get("z", F.lit(1))).alias("value")))
_row("P10_confidence", lambda s, y: P.confidence().column(s, y), _v("p[y + 1]"))
_row("P11_top_k", lambda s, y: P.top_k(2).column(s, y), _v("list_reverse_sort(p)[2]"))
_row("P12_accuracy", lambda s, y: P.accuracy().column(E.argmax(s), y), _v("(list_position(z, list_max(z)) - 1 = y)::integer::double", "z"), "z")
_row("P13_margin", lambda s, y: P.margin().column(s, y), "select id, round(z[y + 1] - list_max(list_filter(z, lambda v, i: i <> y + 1)), 6) + 0.0 as value from z", "z")
_row("P14_unsupervised_margin", lambda s, y: P.unsupervised_margin().column(s, y), _v("list_reverse_sort(z)[1] - list_reverse_sort(z)[2]", "z"), "z")
_row("P15_cross_entropy", lambda s, y: P.cross_entropy().column(s, y), _v("-ln(greatest(2.220446049250313e-16, least(1 - 2.220446049250313e-16, p[y + 1])))"))
_row("P16_cross_entropy_logits", lambda s, y: P.cross_entropy_with_logits().column(s, y), _v("list_max(z) + ln(list_sum(list_transform(z, lambda v: exp(v - list_max(z))))) - z[y + 1]", "z"), "z")


@query("P17_entropy", f"with {SCORED}, k as (select count(distinct y) as k from m) select id, round(-list_sum(list_transform(p, lambda v: v * ln(v))) / ln(k), 6) + 0.0 as value from p, k")
def _entropy(spark, sf):
    rows = scored(spark, sf)
    k = rows.agg(F.count_distinct("y").alias("n_labels"))
    return rows.crossJoin(F.broadcast(k)).select("id", P.entropy().column(F.col("p"), F.col("y"), n_labels=F.col("n_labels")).alias("value"))


_row("P18_unsupervised", lambda s, y: P.unsupervised(P.margin()).column(s, y), _v("list_reverse_sort(p)[1] - list_reverse_sort(p)[2]"))
_row("P21_one_hot", lambda s, y: E.one_hot(y, 4), "select id, [(y = 0)::integer::double, (y = 1)::integer::double, (y = 2)::integer::double, (y = 3)::integer::double] as value from p")
_row("P22_named_probe", lambda s, y: P.check_probe("confidence").column(s, y), _v("z[y + 1]", "z"), "z")
RESID = "abs(y - (0.9 + 0.2 * x))"
_LINE = L.LinearModel([[0.2]], [0.9], "squared", 1.0, False)
query("P19_l1", f"with {PART} {_v(RESID, 'r')}")(lambda s, d: B.parts(s, d).select("id", P.l1().column(_LINE.predictions(F.col("x")), F.col("y")).alias("value")))
query("P20_l2", f"with {PART} {_v(f'{RESID} * {RESID}', 'r')}")(lambda s, d: B.parts(s, d).select("id", P.l2().column(_LINE.predictions(F.col("x")), F.col("y")).alias("value")))

# Modifiers -------------------------------------------------------------------------------------

query(
    "P30_adjust",
    f"""with {SCORED}, g as (select y, avg(p[y + 1]) as m from p group by y), a as (select list(m order by y) as m from g)
select id, list_transform(list_transform(p, lambda v, i: v - m[i] + list_max(m)), lambda v: round(v / list_sum(list_transform(p, lambda u, i: u - m[i] + list_max(m))), 6) + 0.0) as value from p, a""",
)(lambda s, d: P.adjusted(scored(s, d).select("id", "y", "p")).select("id", F.col("p").alias("value")))


@query(
    "P31_peer",
    f"""with {SCORED}, n as (select count(*) as n from p), o as (select *, row_number() over (order by id) - 1 as r from p)
select o.id, round(o.z[o.y + 1] - j.z[k.y + 1], 6) + 0.0 as value from o, n, o as j, o as k where j.r = (o.r * (7919 % n) + 13 % n) % n and k.r = (o.r * (104729 % n) + 71 % n) % n""",
)
def _peer(spark, sf):
    rows = P.with_peers(B.languages(spark, sf))
    c = P.confidence()
    own, peer = (c.column(B.MULTI.decision(F.col(x)), F.col(y)) for x, y in (("x", "y"), ("peer_x", "peer_y")))
    return rows.select("id", (own - peer).alias("value"))


@query(
    "P32_core",
    f"with {SCORED}, q as (select list(n / t order by y) as q from (select y, count(*)::double as n, sum(count(*)) over () as t from m group by y)) select id, round(p[y + 1] - (p[1] * q[1] + p[2] * q[2] + p[3] * q[3] + p[4] * q[4]), 6) + 0.0 as value from p, q",
)
def _core(spark, sf):
    rows = scored(spark, sf)
    return rows.select("id", P.core(P.confidence(), F.col("p"), F.col("y"), P.label_shares(rows, classes=4)).alias("value"))


DIRS = [[0.6, 0.8], [-0.8, 0.6], [1.0, 0.0]]
_CE = "ln(1 + exp(case when y = 1 then -({z}) else {z} end))"
_fd = lambda u: f"round(({_CE.format(z=_shift(u))} - {_CE.format(z=_shift([0, 0]))}) / 0.1, 6) + 0.0"


def _shift(u) -> str:
    w, b = B.BINARY.coef[0], B.BINARY.intercept[0]
    return f"({w[0]!r} * (x[1] + 0.1 * {float(u[0])!r}) + {w[1]!r} * (x[2] + 0.1 * {float(u[1])!r}) + {b!r})"


query("P33_finite_differences", f"with {BIN} select id, [{', '.join(_fd(u) for u in DIRS)}] as value from b")(
    lambda s, d: B.binary(s, d).select("id", P.finite_differences(lambda v: P.cross_entropy().column(B.BINARY.probabilities(v), F.col("y")), F.col("x"), DIRS, 0.1).alias("value"))
)
_COLS = list(map(list, zip(*B.COEF)))
query("P34_sensitivity", f"with {SCORED}, g as (select id, list_transform(p, lambda v, i: v - (i = y + 1)::integer) as g from p) select id, [{', '.join(f'round({_dot("g", c)}, 6) + 0.0' for c in _COLS)}] as value from g")(
    lambda s, d: B.languages(s, d).select("id", B.MULTI.grad_x(F.col("x"), F.col("y")).alias("value"))
)

# Linear algebra and influence ------------------------------------------------------------------

_G = f"{SCORED}, g as (select *, list_transform(p, lambda v, i: v - (i = y + 1)::integer) as g from p)"
query("L01_decision_function", f"with {SCORED} select id, list_transform(z, lambda v: round(v, 6) + 0.0) as value from z")(lambda s, d: B.languages(s, d).select("id", B.MULTI.decision(F.col("x")).alias("value")))
query("L02_predict_proba", f"with {BINP} select id, [round(p, 6)] as value from bq")(lambda s, d: B.binary(s, d).select("id", B.BINARY.link(F.col("x")).alias("value")))
query("L03_objective", f"with {BINP} select round(sum(-ln(case when y = 1 then p else 1 - p end)) + 0.5 * {B.BINARY.coef[0][0] ** 2 + B.BINARY.coef[0][1] ** 2!r}, 6) as objective from bq")(lambda s, d: B.BINARY.objective(B.binary(s, d)))
query("L04_grad_y", f"with {_G} select id, list_transform(g, lambda v: round(v, 6) + 0.0) as value from g")(lambda s, d: B.languages(s, d).select("id", B.MULTI.grad_y(F.col("x"), F.col("y")).alias("value")))
query("L05_grad_p", f"with {BINP} select id, [round(x[1] * (p - y), 6) + 0.0, round(x[2] * (p - y), 6) + 0.0, round(p - y, 6) + 0.0] as value from bq")(lambda s, d: B.binary(s, d).select("id", B.BINARY.grad_p(F.col("x"), F.col("y")).alias("value")))
query("L06_grad_x", f"with {BINP} select id, [round({B.BINARY.coef[0][0]!r} * (p - y), 6) + 0.0, round({B.BINARY.coef[0][1]!r} * (p - y), 6) + 0.0] as value from bq")(lambda s, d: B.binary(s, d).select("id", B.BINARY.grad_x(F.col("x"), F.col("y")).alias("value")))
query("L07_variance", f"with {BINP} {_v('p * (1 - p)', 'bq')}")(lambda s, d: B.binary(s, d).select("id", B.BINARY.variance(F.col("x")).alias("value")))
query("L08_jacobian", f"with {BINP} select id, [round(x[1] * p * (1 - p), 6), round(x[2] * p * (1 - p), 6), round(p * (1 - p), 6)] as value from bq")(
    lambda s, d: B.binary(s, d).select("id", F.transform(F.concat(F.col("x"), F.array(F.lit(1.0))), lambda v: v * B.BINARY.variance(F.col("x"))).alias("value"))
)


@query(
    "L09_hessian",
    f"""with {BINP}, v as (select *, p * (1 - p) as v, [x[1], x[2], 1.0] as t from bq), c as (select unnest(range(3)) as i), k as (select c.i, o.i as j from c, c as o)
select i::integer as i, j::integer as j, round(sum(v * t[i + 1] * t[j + 1]) + (case when i = j and i < 2 then 1.0 else 0.0 end), 6) + 0.0 as value from v, k group by i, j""",
)
def _hessian(spark, sf):
    h = L.hessian(B.binary(spark, sf), B.BINARY)
    return spark.createDataFrame([(i, j, float(h[i, j])) for i in range(3) for j in range(3)], "i int, j int, value double")


query("L11_shape", f"with {LANG} select (max(len(x)) + 1)::integer as in_dim, count(distinct y)::integer as out_dim, ((max(len(x)) + 1) * count(distinct y))::integer as dof from m")(lambda s, d: (lambda m: s.createDataFrame([(*m.in_dim, m.dof)], "in_dim int, out_dim int, dof int"))(L.fit_naive_bayes(B.languages(s, d), 4)[0]))
query("L12_flat_outer", f"with {BINP} select id, [round(x[1] * z, 6) + 0.0, round(x[1] * p, 6) + 0.0, round(x[2] * z, 6) + 0.0, round(x[2] * p, 6) + 0.0] as value from bq")(
    lambda s, d: B.binary(s, d).select("id", E.outer(F.col("x"), F.array(F.get(B.BINARY.decision(F.col("x")), F.lit(0)), F.get(B.BINARY.link(F.col("x")), F.lit(0)))).alias("value"))
)
query("P50_grad_norm2", f"with {_G} {_v('list_sum(list_transform(g, lambda v: v * v)) * list_sum(list_transform(x, lambda v: v * v))', 'g')}")(lambda s, d: B.languages(s, d).select("id", L.grad_norm(B.MULTI, F.col("x"), F.col("y")).alias("value")))
_SIM = f"""{BIN}, s as (select id, x, y, 1 / (1 + exp(-({_dot("x", B.BINARY_FLAT.coef[0])}))) - y as g from b), mm as (select avg(g * x[1]) as a, avg(g * x[2]) as c from s)"""
_SIMV = "g * (x[1] * a + x[2] * c) / sqrt((x[1] * x[1] + x[2] * x[2]) * g * g * (a * a + c * c))"
query("P51_grad_similarity", f"with {_SIM} {_v(_SIMV, 's, mm')}")(lambda s, d: L.grad_similarity(B.binary(s, d), B.BINARY_FLAT))
query("P52_representer", f"with {_G} {_v('abs(g[y + 1]) * list_sum(list_transform(x, lambda v: v * v))', 'g')}")(lambda s, d: B.languages(s, d).select("id", L.representer(B.MULTI, F.col("x"), F.col("y")).alias("value")))
query("P57_norm2", f"with {BIN} {_v('x[1] * x[1] + x[2] * x[2]', 'b')}")(lambda s, d: B.binary(s, d).select("id", E.norm2(F.col("x")).alias("value")))

# Ridge on one feature with intercept: the inverse of [[sxx + 1, sx], [sx, n]] in the open.
_RIDGE = f"""{PART}, t as (select sum(x * x) + 1 as a, sum(x) as b, count(*)::double as n, sum(x * y) as c, sum(y) as e from r),
f as (select *, a * n - b * b as det, (n * c - b * e) / (a * n - b * b) as w, (a * e - b * c) / (a * n - b * b) as w0 from t),
i as (select id, x, y, w, w0, (n * x * x - 2 * b * x + a) / det as q, w * x + w0 - y as e from r, f)"""
_ALOO = "-0.5 * e * e * ((q / (1 - q)) * (q / (1 - q)) + 2 * q / (1 - q))"
_INFL = {
    "P53_self_influence": ("self_influence", "-e * e * q"),
    "P54_cook_distance": ("cook", "e * e * q / ((1 - q) * (1 - q)) / 2"),
    "P54b_cook_distance_bar": ("cook_bar", "e * e * q / (1 - q) / 2"),
    "P55_approximate_loo": ("approximate_loo", _ALOO),
    "P56_leverage": ("leverage", "q"),
}
for _name, (_col, _sql) in _INFL.items():
    query(_name, f"with {_RIDGE} {_v(_sql, 'i')}")(lambda s, d, c=_col: L.influence_one(B.parts(s, d), L.fit_ridge(B.parts(s, d))).select("id", F.col(c).alias("value")))
query("Z02_ridge", f"with {_RIDGE} select round(w, 6) as w, round(w0, 6) as w0 from f")(lambda s, d: s.createDataFrame([(lambda m: (m.coef[0][0], m.intercept[0]))(L.fit_ridge(B.parts(s, d)))], "w double, w0 double"))

# Aggregates ------------------------------------------------------------------------------------


def _agg(name: str, aggregate, sql: str):
    query(name, f"with {EVENTS} {sql}")(lambda s, d: A.check_aggregate(aggregate).run(B.event_stream(s, d)))


_agg("A01_sum", "sum", "select id, round(sum(w * s), 6) + 0.0 as value from e0 group by id")
_agg("A02_count", "count", "select id, round(sum(w), 6) as value from e0 group by id")
_agg("A03_mean", "mean", "select id, round(sum(w * s) / sum(w), 6) + 0.0 as value from e0 group by id")
_agg("A04_var", "var", "select id, round(sum(w * (s - m) * (s - m)) / sum(w), 6) + 0.0 as value from e0 join (select id, sum(w * s) / sum(w) as m from e0 group by id) using (id) group by id")
_agg("A05_forget", A.FORGET, "select id, round(sum(case when pr > s then w else 0 end), 6) as value from (select *, lag(s) over (partition by id order by member) as pr from e0) group by id")
_agg("A06_oob_mean", A.oob("mean"), "select id, round(sum(w * s) filter (where oob) / sum(w) filter (where oob), 6) + 0.0 as value from e0 group by id")
_agg("A07_itb_mean", A.itb("mean"), "select id, round(sum(w * s) filter (where not oob) / sum(w) filter (where not oob), 6) + 0.0 as value from e0 group by id")
_agg("A08_from_axis", A.from_axis(F.avg, A.VAR), "select id, round((v1 + v2) / 2, 6) + 0.0 as value from (select id, sum(w * (s - m1) * (s - m1)) / sum(w) as v1, sum(w * (s2 - m2) * (s2 - m2)) / sum(w) as v2 from e0 join (select id, sum(w * s) / sum(w) as m1, sum(w * s2) / sum(w) as m2 from e0 group by id) using (id) group by id)")
query("A09_signed_sum", f"with {EVENTS} select id, round(-sum(w * s), 6) + 0.0 as value from e0 group by id")(lambda s, d: A.TOTAL.run(B.event_stream(s, d)).select("id", (F.col("value") * A.sign(A.TOTAL, False)).alias("value")))
@query(
    "A10_minimize",
    f"""with {EVENTS} select id, round(-sum(w * (s - m) * (s - m)) / sum(w), 6) + 0.0 as var, round(-sum(case when pr > s then w else 0 end), 6) + 0.0 as forget, round(sum(w * s), 6) + 0.0 as total
from (select *, lag(s) over (partition by id order by member) as pr from e0) join (select id, sum(w * s) / sum(w) as m from e0 group by id) using (id) group by id""",
)
def _signed(spark, sf):
    """Aggregates by their own directions where they have one, else by a probe's that is maximised."""
    rows = stored(B.event_stream(spark, sf), "stream")
    of = lambda a, name: a.run(rows).select("id", (F.col("value") * A.sign(a, True)).alias(name))
    return of(A.VAR, "var").join(of(A.FORGET, "forget"), "id").join(of(A.TOTAL, "total"), "id")


query("A11_named_aggregate", f"with {EVENTS} select id, round(sum(w), 6) as value from e0 group by id")(lambda s, d: A.check_aggregate("count").run(B.event_stream(s, d)))
query("A12_stacked", f"with {EVENTS} select id, list(round(s, 6) order by member) as values from e0 group by id")(lambda s, d: A.stacked(B.event_stream(s, d)))

# Naive Bayes with folds in SQL -------------------------------------------------------------------

_HASH = "(((id % 2147483647) * {a} + {b}) % 2147483647)"


def _fold_sql(k: int, repeat: int = 0) -> str:
    h = _HASH.format(a=(N.FACTOR + N.STRIDE * repeat) % N.PRIME, b=13 + repeat)
    buckets = "(select greatest(1, count(*) // 50000) from documents)"
    return f"(row_number() over (partition by y, {h} * {buckets} // 2147483647 order by {h}, id) % {k})::integer"


def _nb_sql(k: int, repeats: int = 1) -> str:
    """Rows with z and p for every member of every repeat: member, oob, id, y."""
    rep = " union all ".join(f"select *, {r} as rep, {_fold_sql(k, r)} as fold from m" for r in range(repeats))
    return f"""{LANG}, fo as ({rep}), c as (select unnest(range(4)) as c), j as (select unnest(range(1, 8)) as j),
mem as (select distinct rep, fold as member from fo),
cn as (select rep, member, c, count(*) filter (where y = c and fold <> member)::double as n, count(*) filter (where fold <> member)::double as t from fo join mem using (rep), c group by rep, member, c),
cj as (select rep, member, c, j, coalesce(sum(x[j]) filter (where y = c and fold <> member), 0) as s from fo join mem using (rep), c, j group by rep, member, c, j),
th as (select rep, member, c, j, (s + 1) / (n + 2) as th, ln((n + 1) / (t + 4)) as prior from cj join cn using (rep, member, c)),
zz as (select rep, member, id, y, fold = member as oob, c, any_value(prior) + sum(case when x[j] > 0 then ln(th) else ln(1 - th) end) as z from fo join th using (rep) group by rep, member, id, y, fold, c),
nb as (select rep, member, id, y, oob, list(z order by c) as z from zz group by rep, member, id, y, oob),
np as (select *, list_transform(z, lambda v: exp(v - list_max(z)) / list_sum(list_transform(z, lambda u: exp(u - list_max(z))))) as p from nb)"""


query("E02_independent", f"with {_nb_sql(3)} select id, member, oob, 1.0::double as weight, [round(z[y + 1] - list_max(list_filter(z, lambda v, i: i <> y + 1)), 6) + 0.0] as score from np")(lambda s, d: N.IndependentEnsemble(4, 3).probe(B.languages(s, d), P.margin()))
query("D11_consensus_consistency", f"with {_nb_sql(5, 2)} select id, round(avg((list_position(z, list_max(z)) - 1 = y)::integer) filter (where oob), 6) as trust from np group by id")(lambda s, d: T.consensus_consistency(4, 5, 2).trust_score(B.languages(s, d)))
query("D12_confident_learning", f"with {_nb_sql(5, 2)} select id, round(avg(p[y + 1]) filter (where oob), 6) as trust from np group by id")(lambda s, d: T.confident_learning(4, 5, 2).trust_score(B.languages(s, d)))

# All-rows naive Bayes: one member that sees everything (fold -1 never occurs).
_NB1 = _nb_sql(1).replace("fold <> member", "true")
_FIT = lambda df: L.fit_naive_bayes(df, 4)[0]
query("E01_no_ensemble", f"with {_NB1} select id, 0::integer as member, false as oob, 1.0::double as weight, [round(p[y + 1], 6)] as score from np")(lambda s, d: N.NoEnsemble(_FIT).probe(B.languages(s, d), P.confidence("probabilities")))
query("D00_model_probing", f"with {_NB1} select id, round(z[y + 1] - list_max(list_filter(z, lambda v, i: i <> y + 1)), 6) + 0.0 as trust from np")(lambda s, d: T.ModelProbingDetector(N.NoEnsemble(_FIT), "margin", "sum").trust_score(B.languages(s, d)))
query("D09_classifier", f"with {_NB1} select id, (list_position(z, list_max(z)) - 1 = y)::integer::double as trust from np")(lambda s, d: T.classifier(_FIT).trust_score(B.languages(s, d)))
query("D19_small_loss", f"with {_NB1} select id, round(ln(greatest(2.220446049250313e-16, least(1 - 2.220446049250313e-16, p[y + 1]))), 6) + 0.0 as trust from np")(lambda s, d: T.small_loss(_FIT).trust_score(B.languages(s, d)))
query("D10_regressor", f"with {_RIDGE} select id, round(-abs(e), 6) + 0.0 as trust from i")(lambda s, d: T.regressor(lambda df: L.fit_ridge(df)).trust_score(B.parts(s, d)))
query("D19b_small_loss_regression", f"with {_RIDGE} select id, round(-e * e, 6) + 0.0 as trust from i")(lambda s, d: T.small_loss(lambda df: L.fit_ridge(df), True).trust_score(B.parts(s, d)))
query("D02_self_influence", f"with {_RIDGE} select id, round(-e * e * q, 6) + 0.0 as trust from i")(lambda s, d: T.self_influence(lambda df: L.fit_ridge(df)).trust_score(B.parts(s, d)))
query("D03_cook_distance", f"with {_RIDGE} select id, round(-e * e * q / ((1 - q) * (1 - q)) / 2, 6) + 0.0 as trust from i")(lambda s, d: T.cook_distance(lambda df: L.fit_ridge(df)).trust_score(B.parts(s, d)))
query("D04_approximate_loo", f"with {_RIDGE} select id, round({_ALOO}, 6) + 0.0 as trust from i")(lambda s, d: T.approximate_loo(lambda df: L.fit_ridge(df)).trust_score(B.parts(s, d)))
query("D05_representer", f"with {_G} select id, round(-abs(g[y + 1]) * list_sum(list_transform(x, lambda v: v * v)), 6) + 0.0 as trust from g")(lambda s, d: T.representer(lambda df: B.MULTI).trust_score(B.languages(s, d)))
query("D06_agra", f"with {_SIM} {_v(_SIMV, 's, mm', 'trust')}")(lambda s, d: T.Agra(lambda df: B.BINARY_FLAT).trust_score(B.binary(s, d)))

_LOO = f"""{LANG}, c as (select unnest(range(4)) as c), j as (select unnest(range(1, 8)) as j),
n as (select c, count(*) filter (where y = c)::double as n, count(*)::double as t from m, c group by c), s as (select c, j, coalesce(sum(x[j]) filter (where y = c), 0) as s from m, c, j group by c, j),
zz as (select id, y, c, any_value(ln((n - (y = c)::integer + 1) / (t - 1 + 4))) + sum(case when x[j] > 0 then ln((s - (y = c)::integer * x[j] + 1) / (n - (y = c)::integer + 2)) else ln(1 - (s - (y = c)::integer * x[j] + 1) / (n - (y = c)::integer + 2)) end) as z from m, n join s using (c) group by id, y, c),
lo as (select id, y, list(z order by c) as z from zz group by id, y)"""
query("E03_leave_one_out", f"with {_LOO} select id, round(z[y + 1] - list_max(list_filter(z, lambda v, i: i <> y + 1)), 6) + 0.0 as trust from lo")(lambda s, d: T.leave_one_out(4, "margin").trust_score(B.languages(s, d)))
_STUMP = f"""{LANG}, c as (select unnest(range(4)) as c), j as (select unnest(range(1, 8)) as j),
t as (select c, j, count(*) filter (where y = c and x[j] > 0.5) as a, count(*) filter (where y = c and x[j] < 0.5) as b from m, c, j group by c, j),
w as (select id, j, c, a - (y = c and x[j] > 0.5)::integer as a, b - (y = c and x[j] < 0.5)::integer as b from m, t),
l as (select id, j, list(a order by c) as a, list(b order by c) as b from w group by id, j)"""
query("D07_decision_tree_complexity", f"with {_STUMP} select id, max(case when list_position(a, list_max(a)) <> list_position(b, list_max(b)) and list_max(a) > 0 and list_max(b) > 0 then 2.0 else 1.0 end)::double as trust from l group by id")(lambda s, d: T.StumpComplexity(4).trust_score(B.languages(s, d)))
_OUT = f"""{BIN}, g as (select y, count(*)::double as n, avg(x[1]) as a, avg(x[2]) as c, greatest(var_pop(x[1]), 1e-6) as va, greatest(var_pop(x[2]), 1e-6) as vc, sum(count(*)) over () as t from b group by y)"""
_OUTV = "-0.5 * ((x[1] - a) * (x[1] - a) / va + ln(va) + (x[2] - c) * (x[2] - c) / vc + ln(vc) + 2 * ln(2 * 3.141592653589793)) * n / t"
query("E05_outlier_ensemble", f"with {_OUT} select id, 0::integer as member, false as oob, 1.0::double as weight, [round({_OUTV}, 6) + 0.0] as score from b join g using (y)")(lambda s, d: N.OutlierEnsemble().probe(B.binary(s, d)))
query("P06_outliers", f"with {_OUT} select id, round(({_OUTV}) * t / n, 6) + 0.0 as value from b join g using (y)")(lambda s, d: N.OutlierEnsemble().probe(B.binary(s, d)).join(_shares(B.binary(s, d)), "id").select("id", (F.get("score", F.lit(0)) / F.col("share")).alias("value")))
query("D01_outlier_detector", f"with {_OUT} {_v(_OUTV, 'b join g using (y)', 'trust')}")(lambda s, d: T.outlier_detector().trust_score(B.binary(s, d)))


def _shares(df):
    n = df.groupBy("y").agg(F.count("*").alias("n"))
    total = df.agg(F.count("*").alias("t"))
    return df.join(F.broadcast(n.crossJoin(total)), "y").select("id", (F.col("n") / F.col("t")).alias("share"))


# Stages of gradient descent, unrolled in SQL ------------------------------------------------------

EPOCHS = 5


def _gd_sql(epochs: int = EPOCHS) -> str:
    """w1 .. w<epochs>: the parameters after each step; st: id, x, y, member, z for all stages."""
    out = f"{BIN}, w0 as (select 0.0::double as a, 0.0::double as c, 0.0::double as i)"
    for k in range(1, epochs + 1):
        out += f""",
w{k} as materialized (select any_value(a) - avg(g * x[1]) as a, any_value(c) - avg(g * x[2]) as c, any_value(i) - avg(g) as i from (select x, a, c, i, 1 / (1 + exp(-(a * x[1] + c * x[2] + i))) - y as g from b, w{k - 1}))"""
    out += ", ws as (" + " union all ".join(f"select {k - 1} as member, * from w{k}" for k in range(1, epochs + 1)) + ")"
    return out + ", st as (select id, x, y, member, a, c, a * x[1] + c * x[2] + i as z, 1 / (1 + exp(-(a * x[1] + c * x[2] + i))) as p from b, ws)"


_MB = "(case when y = 1 then 2 * z else -2 * z end)"
_ACC = "((z > 0)::integer = y)::integer"
_STAGES = lambda df: L.fit_logistic_stages(df, EPOCHS)


def _kept(spark, sf):
    """The labelled rows, stored: each stage reads them again."""
    return stored(B.binary(spark, sf), "labelled")


query("E04_progressive", f"with {_gd_sql()} select id, member::integer as member, false as oob, 1.0::double as weight, [round({_MB}, 6) + 0.0] as score from st where member % 2 = 0")(lambda s, d: N.ProgressiveEnsemble(_STAGES, 2).probe(_kept(s, d), P.margin()))
query("S05_staged_fit_gradient", f"with {_gd_sql()} select member::integer as member, round(a, 6) + 0.0 as w1, round(c, 6) + 0.0 as w2, round(i, 6) + 0.0 as w0 from ws")(
    lambda s, d: s.createDataFrame([(k, *m.coef[0], m.intercept[0]) for k, m in enumerate(_STAGES(_kept(s, d)))], "member int, w1 double, w2 double, w0 double")
)
query("D13_area_under_margin", f"with {_gd_sql()} select id, round(sum({_MB}), 6) + 0.0 as trust from st group by id")(lambda s, d: T.area_under_margin(_STAGES).trust_score(_kept(s, d)))
query("D14_tracin", f"with {_gd_sql()} select id, round(-sum((p - y) * (p - y) * (x[1] * x[1] + x[2] * x[2])), 6) + 0.0 as trust from st group by id")(lambda s, d: T.tracin(_STAGES).trust_score(_kept(s, d)))
query("D15_forget_scores", f"with {_gd_sql()} select id, round(-sum((pr > ac)::integer), 6) + 0.0 as trust from (select id, {_ACC} as ac, coalesce(lag({_ACC}) over (partition by id order by member), -1) as pr from st) group by id")(lambda s, d: T.forget_scores(_STAGES).trust_score(_kept(s, d)))
_vog = lambda f: f"with {_gd_sql()}, q as (select id, member, unnest([{', '.join(f(u) for u in DIRS)}]) as s, unnest(range({len(DIRS)})) as pos from st) select id, round(-avg(v), 6) + 0.0 as trust from (select id, pos, var_pop(s) as v from q group by id, pos) group by id"
_sg = "(case when y = 1 then 1 else -1 end)"
query("D16_finite_diff_vog", _vog(lambda u: f"{_sg} * (a * {u[0]!r} + c * {u[1]!r})"))(lambda s, d: T.finite_diff_vog(_STAGES, DIRS).trust_score(_kept(s, d)))
query("D17_finite_diff_volg", _vog(lambda u: f"(ln(1 + exp(-{_sg} * (z + 0.1 * (a * {u[0]!r} + c * {u[1]!r})))) - ln(1 + exp(-{_sg} * z))) / 0.1"))(lambda s, d: T.finite_diff_volg(_STAGES, DIRS).trust_score(_kept(s, d)))
query("D18_volg", f"with {_gd_sql()} select id, round(-(var_pop((p - y) * a) + var_pop((p - y) * c)) / 2, 6) + 0.0 as trust from st group by id")(lambda s, d: T.volg(_STAGES).trust_score(_kept(s, d)))
# Complexity of fitted models
query("P40_parameter_count", f"with {_gd_sql()} select ((a <> 0)::integer + (c <> 0)::integer + (i <> 0)::integer)::integer as value from ws where member = {EPOCHS - 1}")(lambda s, d: s.createDataFrame([(K.parameter_count(_STAGES(_kept(s, d))[-1]),)], "value int"))
query("P40b_linear_parameter_count", f"with {_RIDGE} select ((w <> 0)::integer + (w0 <> 0)::integer)::integer as value from f")(lambda s, d: s.createDataFrame([(K.parameter_count(L.fit_ridge(B.parts(s, d))),)], "value int"))
query("P41_param_norm", f"with {_RIDGE} select round(sqrt(w * w), 6) as value from f")(lambda s, d: s.createDataFrame([(L.fit_ridge(B.parts(s, d)).param_norm(),)], "value double"))
_W = B.BINARY.coef[0]
query("D08_finite_diff_complexity", f"with {BIN} select id, round(-({' + '.join(f'abs(2 * ({_W[0]!r} * {u[0]!r} + {_W[1]!r} * {u[1]!r}))' for u in DIRS)}) / 3, 6) as trust from b")(lambda s, d: T.finite_diff_complexity(lambda df: B.BINARY, DIRS).trust_score(B.binary(s, d)))

# Splitters and handlers --------------------------------------------------------------------------

_TR = f"{SCORED}, tr as (select id, y, p[y + 1] as trust, z[y + 1] as other from p)"


def trusted(spark, sf):
    rows = scored(spark, sf)
    return rows.select("id", "y", F.get("p", F.col("y")).alias("trust"), F.get("z", F.col("y")).alias("other"))


def _flag(df):
    return df.select("id", "trusted")


query("T01_threshold", f"with {_TR} select id, trust >= 0.2 and other >= 0.2 as trusted from tr")(lambda s, d: _flag(D.ThresholdSplitter(0.2).split(trusted(s, d), "trust", "other")))
query("T02_quantile", f"with {_TR}, q as (select quantile_cont(trust, {1 - 0.7 ** 0.5!r}) as a, quantile_cont(other, {1 - 0.7 ** 0.5!r}) as c from tr) select id, trust >= a and other >= c as trusted from tr, q")(lambda s, d: _flag(D.QuantileSplitter(0.3).split(trusted(s, d), "trust", "other")))
query("T04_per_class", f"with {_TR}, q as (select y, quantile_cont(trust, 0.3) as a from tr group by y) select id, trust >= a as trusted from tr join q using (y)")(lambda s, d: _flag(D.PerClassSplitter(D.QuantileSplitter(0.3)).split(trusted(s, d), "trust")))


def _em_sql(steps: int) -> str:
    out = f"{_TR}, lim as (select min(trust) as lo, max(trust) - min(trust) as w from tr), v as (select id, (trust - lo) / w as s from tr, lim), g0 as (select 0.25::double as m0, 0.75::double as m1, 0.0625::double as v0, 0.0625::double as v1, 0.5::double as a0, 0.5::double as a1)"
    resp = "1 / (1 + exp((ln(a0) - 0.5 * ln(v0) - (s - m0) * (s - m0) / (2 * v0)) - (ln(a1) - 0.5 * ln(v1) - (s - m1) * (s - m1) / (2 * v1))))"
    for k in range(1, steps + 1):
        out += f""", g{k} as materialized (select u0 / n0 as m0, u1 / n1 as m1, greatest(q0 / n0 - (u0 / n0) * (u0 / n0), 0.001) as v0, greatest(q1 / n1 - (u1 / n1) * (u1 / n1), 0.001) as v1, n0 / (n0 + n1) as a0, n1 / (n0 + n1) as a1
from (select sum(1 - r) as n0, sum(r) as n1, sum((1 - r) * s) as u0, sum(r * s) as u1, sum((1 - r) * s * s) as q0, sum(r * s * s) as q1 from (select s, {resp} as r from v, g{k - 1})))"""
    return out + f" select id, ({resp} >= 0.5) = (m1 >= m0) as trusted from v, g{steps}"


query("T03_gmm", f"with {_em_sql(4)}")(lambda s, d: _flag(D.GmmSplitter(4).split(trusted(s, d))))


def _mixture_sql(steps: int) -> str:
    """Two Gaussians over two columns, unrolled: m means, v and c the covariance, a the weights."""
    out = f"{_TR}, lim as (select min(trust) as l1, max(trust) - min(trust) as w1, min(other) as l2, max(other) - min(other) as w2 from tr), v as (select id, (trust - l1) / w1 as s, (other - l2) / w2 as u from tr, lim), "
    out += "g0 as (select " + ", ".join(f"{m}::double as m{k}, {m}::double as n{k}, 0.0625::double as v{k}, 0.0::double as c{k}, 0.0625::double as u{k}, 0.5::double as a{k}" for k, m in ((0, 0.25), (1, 0.75))) + ")"

    def log(k: int) -> str:
        det = f"(v{k} * u{k} - c{k} * c{k})"
        return f"(ln(a{k}) - 0.5 * ln({det}) - 0.5 * ((s - m{k}) * (s - m{k}) * u{k} - 2 * (s - m{k}) * (u - n{k}) * c{k} + (u - n{k}) * (u - n{k}) * v{k}) / {det})"

    high = f"1 / (1 + exp({log(0)} - {log(1)}))"
    for t in range(1, steps + 1):
        sums = ", ".join(f"sum({r}) as w{k}, sum({r} * s) / sum({r}) as m{k}, sum({r} * u) / sum({r}) as n{k}, sum({r} * s * s) / sum({r}) as q{k}, sum({r} * s * u) / sum({r}) as x{k}, sum({r} * u * u) / sum({r}) as y{k}" for k, r in ((0, "(1 - r)"), (1, "r")))
        new = ", ".join(f"m{k}, n{k}, q{k} - m{k} * m{k} + 0.001 as v{k}, x{k} - m{k} * n{k} as c{k}, y{k} - n{k} * n{k} + 0.001 as u{k}, w{k} / (w0 + w1) as a{k}" for k in (0, 1))
        out += f", g{t} as materialized (select {new} from (select {sums} from (select s, u, {high} as r from v, g{t - 1})))"
    return out + f" select id, ({high} >= 0.5) = (m1 + n1 >= m0 + n0) as trusted from v, g{steps}"


query("T03b_mixture_of_two_scores", f"with {_mixture_sql(3)}")(lambda s, d: _flag(D.MixtureSplitter(3).split(trusted(s, d), "trust", "other")))
query("H01_filter", f"with {_TR} select id, y from tr where trust >= 0.3")(lambda s, d: D.filter_untrusted(D.ThresholdSplitter(0.3).split(trusted(s, d), "trust")).select("id", "y"))
query("H02_semi_supervised", f"with {_TR} select id, (case when trust >= 0.3 then y else -1 end)::integer as y from tr")(lambda s, d: D.unlabel_untrusted(D.ThresholdSplitter(0.3).split(trusted(s, d), "trust")).select("id", "y"))
query("H03_biquality", f"with {_TR} select id, y, (trust >= 0.3)::integer as sample_quality from tr")(lambda s, d: D.weight_untrusted(D.ThresholdSplitter(0.3).split(trusted(s, d), "trust")).select("id", "y", "sample_quality"))


query("T05_suspects", f"with {_TR} select id, round(trust, 6) as trust from tr order by trust, id limit 50")(lambda s, d: trusted(s, d).orderBy("trust", "id").limit(50).select("id", "trust"))

# Weak labels ---------------------------------------------------------------------------------------

RULES = {0: ["der", "und", "die der"], 1: ["the", "of the"], 2: ["el", "los"], 3: ["le", "des", "de la"]}
_TOK = """tk as (select doc_id as id, list_filter(regexp_split_to_array(trim(lower(translate(coalesce(text, ''), ':,.?!"', ''))), '\\s+'), lambda t: t <> '') as t from documents),
t2 as (select id, t || list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]) as t from tk)"""
_VOTES = ", ".join(f"(case when list_contains(t, '{k}') then {c} else -1 end)::integer" for c, ks in RULES.items() for k in ks)
_VT = f"{_TOK}, vt as (select id, [{_VOTES}] as votes from t2), cc as (select id, votes, [{', '.join(f'len(list_filter(votes, lambda v: v = {c}))' for c in RULES)}] as n from vt)"


def votes(spark, sf):
    return B.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), D.keyword_votes(F.coalesce("text", F.lit("")), RULES).alias("votes"))


def _weak(method):
    return lambda s, d: D.WeakLabelEncoder(method).fit_transform(votes(s, d)).select("id", F.col("weak").alias("value"))


query("W04_keyword_votes", f"with {_VT} select id, votes from vt")(votes)
query("W01_majority", f"with {_VT} select id, (case when list_max(n) > 0 then list_position(n, list_max(n)) - 1 else -1 end)::integer as value from cc")(_weak("majority"))
query("W02_soft", f"with {_VT} select id, list_transform(n, lambda v: case when list_sum(n) > 0 then round(v / list_sum(n)::double, 6) end) as value from cc")(_weak("soft"))
_NAMED = {"german": ["der", "und"], "english": ["the"], "spanish": ["el"]}
_SV = f"{_TOK}, sv as (select id, [{', '.join(f'''case when list_contains(t, '{k}') then '{c}' else '-1' end''' for c, ks in _NAMED.items() for k in ks)}] as v from t2), sc as (select id, [len(list_filter(v, lambda a: a = 'english')), len(list_filter(v, lambda a: a = 'german')), len(list_filter(v, lambda a: a = 'spanish'))] as n from sv)"


@query("W03_encode_decode", f"with {_SV} select id, case when list_max(n) > 0 then ['english','german','spanish'][list_position(n, list_max(n))] end as name from sc")
def _names(spark, sf):
    rows = B.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), D.keyword_votes(F.coalesce("text", F.lit("")), _NAMED).alias("votes"))
    e = D.WeakLabelEncoder("majority")
    return e.inverse(e.fit_transform(rows)).select("id", "name")


_FIRST = {"spanish": ["los"], "german": ["und"]}
_LEX = {"english": ["the"], "french": ["le", "des"]}
query(
    "W05_priority_votes",
    f"""with {_TOK}, h as (select id, list_contains(t, 'los') as a, list_contains(t, 'und') as b, list_contains(t, 'the') as c, list_contains(t, 'le') as d, list_contains(t, 'des') as e from t2)
select id, [case when a then 'spanish' else '-1' end, case when b and not a then 'german' else '-1' end, case when c and not (a or b) then 'english' else '-1' end, case when d and not (a or b) then 'french' else '-1' end, case when e and not (a or b) then 'french' else '-1' end] as votes from h""",
)(lambda s, d: B.table(s, d, "documents").select(F.col("doc_id").alias("id"), D.priority_votes(F.coalesce("text", F.lit("")), _FIRST, _LEX).alias("votes")))

# Generators ------------------------------------------------------------------------------------------

# As many points as the table has documents: c holds their number and that of each shape.
_xy = "round({a}, 6) + 0.0 as x1, round({b}, 6) + 0.0 as x2, ({y})::integer as y"


def _gen(parts: int, sql: str, rows: str | None = None) -> str:
    return f"with c as (select count(*) as n, count(*) // {parts} as m, round(count(*) / 3.0)::bigint as outer_n from documents), i as (select unnest(range((select {rows or f'm * {parts}'} from c))) as id) select id, {sql} from i, c"


def _points(make):
    return lambda s, d: make(s, B.table(s, d, "documents").count())


query("G01_blobs", _gen(3, _xy.format(a="2 * cos(pi() / 4 + (id % 3) * 2 * pi() / 3)", b="2 * sin(pi() / 4 + (id % 3) * 2 * pi() / 3)", y="(id % 3)")))(_points(lambda s, n: toy.blobs(s, n, 3, 2.0)))
_T = "(id // 3) * 2 * pi() / (m - 1) + 1"
query("G02_spirals", _gen(3, _xy.format(a=f"({_T}) * cos({_T} + (id % 3) * 2 * pi() / 3)", b=f"({_T}) * sin({_T} + (id % 3) * 2 * pi() / 3)", y="(id % 3)")))(_points(lambda s, n: toy.spirals(s, n, 3, 1.0, 1.0)))
query("G03_circles", _gen(3, _xy.format(a="(id % 3) * cos((id // 3) * 2 * pi() / m)", b="(id % 3) * sin((id // 3) * 2 * pi() / m)", y="(id % 3)")))(_points(lambda s, n: toy.circles(s, n, 3)))
_R = "((id // 6) / m::double + 1)"
query("G04_xor_camembert", _gen(6, _xy.format(a=f"{_R} * cos((id % 6) * (2 * pi() - pi() / 3) / 5)", b=f"-{_R} * sin((id % 6) * (2 * pi() - pi() / 3) / 5)", y="(id % 6) % 3")))(_points(lambda s, n: toy.xor_camembert(s, n, 3)))
_T = "(case when id < outer_n then pow(id / (outer_n - 1)::double, 2) else 1 - pow((id - outer_n) / (n - outer_n - 1)::double, 2) end)"
query("G05_moons", _gen(1, _xy.format(a=f"case when id < outer_n then cos(pi() * {_T}) else 1 - cos(pi() * {_T}) end", b=f"case when id < outer_n then sin(pi() * {_T}) else 0.5 - sin(pi() * {_T}) end", y="(id >= outer_n)"), "n"))(
    _points(lambda s, n: toy.moons(s, n, "asymmetric", 2.0, 2.0))
)
query("G06_histogram_truth", f"with {BIN} select i, j, round(count(*) / any_value(t)::double, 6) as p_x, round(avg(y), 6) as p_y from (select floor(x[1] * 5)::integer as i, floor(x[2] * 4)::integer as j, y, count(*) over () as t from b where x[1] < 1) group by i, j")(
    lambda s, d: toy.histogram_truth(B.binary(s, d).select(F.get("x", F.lit(0)).alias("x1"), F.get("x", F.lit(1)).alias("x2"), "y").filter("x1 < 1"), (5, 4), (0.0, 0.0), (1.0, 1.0))
)

# Neighbours, metrics ------------------------------------------------------------------------------

query("M01_roc_auc", f"with {_TR}, f as (select tr.trust, flipped from tr join m using (id)), k as (select flipped, avg_rank from (select flipped, (rank() over (order by trust) + rank() over (order by trust) + count(*) over (partition by trust) - 1) / 2.0 as avg_rank from f)) select round(1 - (sum(avg_rank) filter (where flipped) - count(*) filter (where flipped) * (count(*) filter (where flipped) + 1) / 2.0) / (count(*) filter (where flipped) * count(*) filter (where not flipped)), 6) as auc from k")(
    lambda s, d: K.roc_auc(trusted(s, d).join(B.languages(s, d).select("id", (~F.col("flipped")).alias("good")), "id"), "trust", "good")
)
query("M02_balanced_accuracy", f"with {SCORED} select round(avg(r), 6) as balanced_accuracy from (select y, avg((list_position(z, list_max(z)) - 1 = y)::integer) as r from z group by y)")(lambda s, d: K.balanced_accuracy(scored(s, d).select("y", E.argmax(F.col("z")).alias("prediction"))))
query("M03_confusion", f"with {SCORED} select y, (list_position(z, list_max(z)) - 1)::integer as prediction, count(*) as n from z group by 1, 2")(lambda s, d: scored(s, d).select("y", E.argmax(F.col("z")).alias("prediction")).groupBy("y", "prediction").agg(F.count("*").alias("n")))

# Models of pyspark.ml: no SQL stands for their fits; the tests compare them with their libraries -----------

QUERIES |= {k: (lambda s, d, f=f: B.rounded(f(s, d))) for k, f in K.QUERIES.items()}

from trustloom.plans import literal as _literal  # noqa: E402,F401  registers its queries here
from trustloom.plans import fitted as _fitted  # noqa: E402,F401  so does this
from trustloom.plans import neighbour_queries as _neighbours  # noqa: E402,F401  and this
from trustloom.plans import sparse_queries as _sparse  # noqa: E402,F401  and this
from trustloom.plans import kernel_queries as _kernels  # noqa: E402,F401  and this
from trustloom.plans import path_queries as _paths  # noqa: E402,F401  and this
from trustloom.plans import grid_queries as _grids  # noqa: E402,F401  and this
from trustloom.plans import network_queries as _networks  # noqa: E402,F401  and this
from trustloom.plans import left_out_queries as _left_out  # noqa: E402,F401  and this
