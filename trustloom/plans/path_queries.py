"""Queries on chosen penalties and rank correlation, and SQL in closed form and over all pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from trustloom.operators import detectors as T
from trustloom.operators import paths
from trustloom.operators.ranks import kendall
from trustloom.plans import base as B
from trustloom.plans import catalogue as C

query = C.query
ALPHAS, FOLDS = [0.1, 1.0, 10.0, 100.0, 1000.0], 5


def _dealt(df):
    return df.withColumn("fold", F.pmod(F.col("id"), F.lit(FOLDS)).cast("int"))


def _errors(spark, found):
    model, errors = found
    return spark.createDataFrame([(a, e, a == model.regul) for a, e in errors.items()], "alpha double, error double, chosen boolean")


_AL = f"al as (select unnest({ALPHAS}::double[]) as alpha)"
_SUMS = "count(*)::double as n, sum(x) as sx, sum(y) as sy, sum(x * x) as sxx, sum(x * y) as sxy"
_CHOSEN = "select alpha, round(error, 6) as error, alpha = (select alpha from e order by round(error, 12), alpha desc limit 1) as chosen from e"
_W = "(sxy - sx * sy / n) / (sxx - sx * sx / n + alpha)"
_FOLDED = f"""with {C.PART}, {_AL}, f as (select *, id % {FOLDS} as fold from r), k as (select unnest(range({FOLDS})) as k),
s as (select k, {_SUMS} from f, k where fold <> k group by k),
w as (select k, alpha, {_W} as w, (sy - {_W} * sx) / n as w0 from s, al),
e as (select alpha, sum((y - w * x - w0) * (y - w * x - w0)) / (select count(*) from r) as error from f join w on f.fold = w.k group by alpha)"""
query("Z02b_ridge_by_folds", f"{_FOLDED} {_CHOSEN}")(lambda s, d: _errors(s, paths.ridge_by_folds(B.parts(s, d), ALPHAS, FOLDS, deal=_dealt)))
_LEFT = f"""with {C.PART}, {_AL}, s as (select {_SUMS} from r), w as (select *, {_W} as w, (sy - {_W} * sx) / n as w0, sx / n as mx, sxx - sx * sx / n + alpha as q from s, al),
e as (select alpha, avg(pow((y - w * x - w0) / (1 - 1 / n - (x - mx) * (x - mx) / q), 2)) as error from r, w group by alpha)"""
query("Z02c_ridge_by_leave_one_out", f"{_LEFT} {_CHOSEN}")(lambda s, d: _errors(s, paths.ridge_by_leave_one_out(B.parts(s, d), ALPHAS)))
query("D10c_ridge_of_chosen_penalty", f"{_FOLDED}, t as (select {_SUMS} from r), b as (select alpha from e order by round(error, 12), alpha desc limit 1), v as (select {_W} as w, (sy - {_W} * sx) / n as w0 from t, b) select id, round(-abs(y - w * x - w0), 6) + 0.0 as trust from r, v")(
    lambda s, d: T.regressor(lambda df: paths.ridge_by_folds(df, ALPHAS, FOLDS, deal=_dealt)[0]).trust_score(B.parts(s, d))
)

_SIGNS = "sign(round(a.trust, 2) - round(b.trust, 2)) as s, sign(round(a.other, 1) - round(b.other, 1)) as u"
query("M06_kendall", f"with {C._TR}, pr as (select {_SIGNS} from tr as a join tr as b on a.id < b.id) select round(sum(s * u) / (sqrt(sum(abs(s))) * sqrt(sum(abs(u)))), 6) as tau from pr")(
    lambda s, d: kendall(C.trusted(s, d).select(F.round("trust", 2).alias("a"), F.round("other", 1).alias("b")), "a", "b")
)
