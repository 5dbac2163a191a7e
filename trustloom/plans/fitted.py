"""Queries on trees fitted to the given tables, and SQL that fits the same trees."""

from __future__ import annotations

from pyspark.sql import functions as F

from trustloom.functions import expr as E
from trustloom.functions import probes as P
from trustloom.operators import aggregates as A
from trustloom.operators import complexity
from trustloom.operators import ensembles as N
from trustloom.operators import trees
from trustloom.operators.committees import AdaBoost, Bagging
from trustloom.plans import base as B
from trustloom.plans import catalogue as C
from trustloom.plans import learners as K
from trustloom.plans import literal as X

query = C.query

# SQL pieces --------------------------------------------------------------------------------------


def _counts(classes: int, weight: str = "1", frm: str = "") -> str:
    """l0 .. and r0 ..: what goes left and right of a cut of feature j, by class."""
    side = lambda s, c, op: f"coalesce(sum({weight}) filter (where {frm}x[j] {op} 0.5 and {frm}y = {c}), 0)::double as {s}{c}"
    return ", ".join(side(s, c, op) for s, op in (("l", "<="), ("r", ">")) for c in range(classes))


def _gini(classes: int) -> tuple[str, str]:
    """(condition, gain) of a cut."""
    total = lambda s: "(" + " + ".join(f"{s}{c}" for c in range(classes)) + ")"
    square = lambda s: "(" + " + ".join(f"{s}{c} * {s}{c}" for c in range(classes)) + ")"
    both = "(" + " + ".join(f"(l{c} + r{c}) * (l{c} + r{c})" for c in range(classes)) + ")"
    n = f"({total('l')} + {total('r')})"
    impure = " + ".join(f"(l{c} + r{c} > 0)::integer" for c in range(classes)) + " > 1"
    return f"{total('l')} > 0 and {total('r')} > 0 and {impure}", f"round({square('l')} / {total('l')} + {square('r')} / {total('r')} - {both} / {n}, 9)"


def _depth2(frame: str, name: str = "", classes: int = 2) -> str:
    """n<name>: side, j, l0 .. of the cuts of a tree of depth 2: the root's has side -1."""
    ok, gain = _gini(classes)
    counts = _counts(classes)
    return f"""
h{name} as (select -1 as side, j, {counts} from {frame}, j group by j),
r{name} as (select * from h{name} where {ok} order by {gain} desc, j limit 1),
u{name} as (select f.id, f.x, f.y, (f.x[r.j] > 0.5)::integer as side from {frame} as f, r{name} as r),
g{name} as (select side, j, {counts} from u{name}, j group by side, j),
n{name} as (select * from r{name} union all select * exclude (place) from (select *, row_number() over (partition by side order by {gain} desc, j) as place from g{name} where {ok}) where place = 1)"""


_J = "j as (select unnest(range(1, 8)) as j)"
#: A side's leaf for each cut that it hasn't, two for one that it has.
_LEAVES = "(select count(*) + 1 from n{0})::integer"

# Leaves ------------------------------------------------------------------------------------------

_value = lambda s, n: s.createDataFrame([(n,)], "value int")
_stump_tree = lambda depth: lambda df: trees.DecisionTree(2, depth).fit(df)

query("P40c_tree_leaves", f"with {X.TWO}, {_J}, {_depth2('t')} select {_LEAVES.format('')} as value")(
    lambda s, d: _value(s, K.parameter_count(trees.DecisionTree(2, 2).fit(X.two(s, d))))
)
_thirds = lambda m: (F.pmod(F.col("id"), F.lit(3)) != m).cast("double")
_BAGS = ", ".join(f"b{m} as (select * from t where id % 3 <> {m}), {_depth2(f'b{m}', str(m))}" for m in range(3))
query("P40d_bagging_leaves", f"with {X.TWO}, {_J}, {_BAGS} select ({' + '.join(_LEAVES.format(m) for m in range(3))})::integer as value")(
    lambda s, d: _value(s, K.parameter_count(Bagging(_stump_tree(2), 3, 2, _thirds).fit(X.two(s, d))))
)

# The tree's own nodes ----------------------------------------------------------------------------


def _nodes(spark, tree: trees.Tree):
    """side (-1 for the root), feature from 1, and the weights of both classes on the left and on the right."""
    rows = []
    for side, k in ((-1, 0), (0, tree.nodes[0].left), (1, tree.nodes[0].right)):
        n = tree.nodes[k] if k >= 0 else None
        if n is not None and n.at >= 0:
            rows.append((side, n.at + 1, *map(float, tree.nodes[n.left].sums), *map(float, tree.nodes[n.right].sums)))
    return spark.createDataFrame(rows, "side int, j int, l0 double, l1 double, r0 double, r1 double")


query("Z08_tree_nodes", f"with {X.TWO}, {_J}, {_depth2('t')} select side::integer as side, j::integer as j, l0, l1, r0, r1 from n")(
    lambda s, d: _nodes(s, trees.DecisionTree(2, 2).grow(X.two(s, d))[0])
)

# Stages along the weakest-link path of the fitted tree --------------------------------------

_loss = lambda a, b: f"(case when {a} + {b} > 0 then {a} + {b} - ({a} * {a} + {b} * {b}) / ({a} + {b}) else 0 end)"
_PATH = f"""with recursive {X.TWO}, {_J}, {_depth2('t')},
a as (select o.j as j0, o.l0, o.l1, o.r0, o.r1, p.j as jl, q.j as jr, o.l0 + o.l1 + o.r0 + o.r1 as whole,
  {_loss('(o.l0 + o.r0)', '(o.l1 + o.r1)')} / whole as c0, {_loss('o.l0', 'o.l1')} / whole as cl, {_loss('o.r0', 'o.r1')} / whole as cr,
  ({_loss('p.l0', 'p.l1')} + {_loss('p.r0', 'p.r1')}) / whole as sl, ({_loss('q.l0', 'q.l1')} + {_loss('q.r0', 'q.r1')}) / whole as sr,
  p.l1 > p.l0 as pll, p.r1 > p.r0 as plr, q.l1 > q.l0 as prl, q.r1 > q.r0 as prr
  from n as o left join n as p on p.side = 0 left join n as q on q.side = 1 where o.side = -1),
st(k, l, r, o, price) as (
  select 0, jl is not null, jr is not null, true, 0.0::double from a
  union all
  select k + 1, l and gl > m + 1e-12 and g0 > m + 1e-12, r and gr > m + 1e-12 and g0 > m + 1e-12, g0 > m + 1e-12, m from (
    select *, greatest(price, least(gl, gr, g0)) as m from (
      select st.*, case when l then cl - sl end as gl, case when r then cr - sr end as gr,
        (c0 - (case when l then sl else cl end) - (case when r then sr else cr end)) / (1 + l::integer + r::integer) as g0 from st, a where o))
),
kept as (select * from st as s where not exists (select 1 from st where st.k = s.k + 1 and st.price <= 1e-12)),
w as (select id, y, k, ((case when not o then l1 + r1 > l0 + r0
  when x[j0] <= 0.5 then (case when not l then l1 > l0 when x[jl] <= 0.5 then pll else plr end)
  else (case when not r then r1 > r0 when x[jr] <= 0.5 then prl else prr end) end)::integer = y)::integer as ac from t, kept, a)
select id, round(sum((pr > ac)::integer), 6) + 0.0 as value from (select id, ac, lag(ac) over (partition by id order by k desc) as pr from w) group by id"""


@query("S06_tree_pruning_forget", _PATH.replace("sum((pr > ac)::integer)", "sum(coalesce((pr > ac)::integer, 0))"))
def _pruning(spark, sf):
    return A.FORGET.run(N.ProgressiveEnsemble(trees.DecisionTree(2, 2)).probe(X.two(spark, sf), P.accuracy()))


# The tree without each row ------------------------------------------------------------------

_ok4, _gain4 = _gini(4)
_WITHOUT = f"""with {C.LANG}, {_J},
c as (select row_number() over () as k, * from (select x, y, count(*)::double as n from m group by x, y)),
lo as (select c.k, o.x, o.y, o.n - (o.k = c.k)::integer as n from c, c as o),
h as (select k, j, {_counts(4, 'n')} from lo, j group by k, j),
r as (select k, j from (select *, row_number() over (partition by k order by {_gain4} desc, j) as place from h where {_ok4}) where place = 1),
u as (select lo.k, (x[r.j] > 0.5)::integer as side, x, y, n from lo join r using (k)),
g as (select k, side, j, {_counts(4, 'n')} from u, j group by k, side, j),
s as (select distinct k, side from g where {_ok4}),
v as (select c.x, c.y, 1 + (select count(*) from r where r.k = c.k) + (select count(*) from s where s.k = c.k) as leaves from c)
select id, leaves::double as trust from m join v using (x, y)"""
query("D07b_tree_complexity", _WITHOUT)(lambda s, d: complexity.TreeComplexity(max_depth=2).trust_score(B.languages(s, d)))

# Boosting on histograms, unrolled ----------------------------------------------------------------

RATE, PENALTY, ROUNDS = 0.3, 1.0, 3


def _newton(left: str, right: str, both: str) -> str:
    part = lambda s: f"g{s} * g{s} / (h{s} + {PENALTY})"
    return f"round({part(left)} + {part(right)} - {part(both)}, 9)"


def _boosting_sql(frame: str, cut: str, candidates: str) -> str:
    """k<n>: the cut of round n, and the steps on both sides. ``candidates`` lists cuts; ``cut`` says who goes left."""
    out = f"z0 as (select ln(avg(y) / (1 - avg(y))) as base from {frame}), f0 as (select id, x, y, base as m from {frame}, z0)"
    for k in range(1, ROUNDS + 1):
        out += f""",
d{k} as (select x, p - y as g, p * (1 - p) as h from (select x, y, 1 / (1 + exp(-m)) as p from f{k - 1})),
e{k} as (select j, sum(g) filter (where {cut}) as gl, sum(h) filter (where {cut}) as hl, sum(g) filter (where not {cut}) as gr, sum(h) filter (where not {cut}) as hr, sum(g) as ga, sum(h) as ha from d{k}, {candidates} group by j),
k{k} as materialized (select {k - 1} as round, j, -{RATE} * gl / (hl + {PENALTY}) as below, -{RATE} * gr / (hr + {PENALTY}) as above from e{k} where gl is not null and gr is not null order by {_newton('l', 'r', 'a')} desc, j limit 1),
f{k} as materialized (select id, x, y, m + case when {cut} then below else above end as m from f{k - 1}, k{k})"""
    return out + ", ks as (" + " union all ".join(f"select * from k{k}" for k in range(1, ROUNDS + 1)) + ")"


def _steps(spark, model: trees.BoostedTrees, name: str, of):
    rows = [(k, of(t.nodes[0]), float(model.rate * t.value(1)), float(model.rate * t.value(2)), K.parameter_count(model)) for k, t in enumerate(model.trees)]
    return spark.createDataFrame(rows, f"round int, {name}, below double, above double, leaves int")


_OUT = f"round(below, 6) + 0.0 as below, round(above, 6) + 0.0 as above, {2 * ROUNDS}::integer as leaves from ks"
query("P40e_boosting_leaves", f"with {X.TWO}, {_J}, {_boosting_sql('t', 'x[j] <= 0.5', 'j')} select round::integer as round, j::integer as j, {_OUT}")(
    lambda s, d: _steps(s, trees.Boosting(ROUNDS, 1, RATE, penalty=PENALTY).fit(X.two(s, d)), "j int", lambda n: n.at + 1)
)
_ONE = f"{C.BIN}, o as (select id, x[2] as x, y from b), vs as (select distinct x as v from o), j as (select v as j from vs)"
query(
    "P40f_histogram_boosting_leaves",
    f"with {_ONE}, {_boosting_sql('o', 'x <= j', 'j')} select round::integer as round, round((j + (select min(v) from vs where v > j)) / 2, 6) as threshold, {_OUT}",
)(lambda s, d: _steps(s, trees.Boosting(ROUNDS, 1, RATE, penalty=PENALTY).fit(B.binary(s, d).select("id", F.array(F.get("x", F.lit(1))).alias("x"), "y")), "threshold double", lambda n: n.threshold))
query("S02b_fitted_boosting_aum", f"with {X.TWO}, {_J}, {_boosting_sql('t', 'x[j] <= 0.5', 'j')}, al as ({' union all '.join(f'select id, y, m from f{k}' for k in range(1, ROUNDS + 1))}) select id, round(sum(case when y = 1 then 2 * m else -2 * m end), 6) + 0.0 as trust from al group by id")(
    lambda s, d: C.T.area_under_margin(trees.Boosting(ROUNDS, 1, RATE, penalty=PENALTY)).trust_score(X.two(s, d))
)

# AdaBoost of trees of depth 1, unrolled ----------------------------------------------------------


def _samme_sql(rounds: int) -> str:
    out = "a0 as (select id, x, y, 1.0::double as w from t)"
    ok, gain = _gini(2)
    for k in range(1, rounds + 1):
        out += f""",
q{k} as (select j, {_counts(2, 'w')} from a{k - 1}, j group by j),
s{k} as materialized (select j, l1 > l0 as below, r1 > r0 as above from q{k} where {ok} order by {gain} desc, j limit 1),
v{k} as (select id, x, y, w, ((case when x[j] <= 0.5 then below else above end)::integer <> y)::integer as wrong from a{k - 1}, s{k}),
z{k} as materialized (select ln((1 - e) / e) as alpha, e from (select sum(w * wrong) / sum(w) as e from v{k})),
a{k} as materialized (select id, x, y, w * exp(alpha * wrong) / (1 + e * (exp(alpha) - 1)) as w from v{k}, z{k})"""
    votes = lambda c: " + ".join(f"z{k}.alpha * ((case when x[s{k}.j] <= 0.5 then s{k}.below else s{k}.above end)::integer = {c})::integer" for k in range(1, rounds + 1))
    frm = ", ".join(f"s{k}, z{k}" for k in range(1, rounds + 1))
    return out + f", vt as (select id, y, [{votes(0)}, {votes(1)}] as v from t, {frm})"


query("S04c_adaboost_of_trees", f"with {X.TWO}, {_J}, {_samme_sql(2)} select id, round(v[y + 1] / (v[1] + v[2]), 6) + 0.0 as trust from vt")(
    lambda s, d: C.T.ModelProbingDetector(N.NoEnsemble(AdaBoost(_stump_tree(1), 2, 2).fit), P.confidence("probabilities"), "sum").trust_score(X.two(s, d))
)

# A regression tree -------------------------------------------------------------------------------

_PARTS = f"""{C.PART}, j as (select distinct x as j from r),
e as (select j, sum(y) filter (where x <= j) as sl, count(*) filter (where x <= j)::double as nl, sum(y) filter (where x > j) as sr, count(*) filter (where x > j)::double as nr, sum(y) as sa from r, j group by j),
k as (select j, sl / nl as below, sr / nr as above from e where nr > 0 order by round(sl * sl / nl + sr * sr / nr - sa * sa / (nl + nr), 9) desc, j limit 1)"""
query("D10b_tree_regressor", f"with {_PARTS} select id, round(-abs(y - case when x <= j then below else above end), 6) + 0.0 as trust from r, k")(
    lambda s, d: C.T.regressor(trees.DecisionTree(None, 1).fit).trust_score(B.parts(s, d))
)
