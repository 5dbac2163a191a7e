"""A grid over quantiles of trust, and SQL that fits each of its models."""

from __future__ import annotations

from pyspark.sql import functions as F

from trustloom.operators import detectors as T
from trustloom.operators import ensembles as N
from trustloom.operators import grid
from trustloom.plans import base as B
from trustloom.plans import catalogue as C

SHARES, FOLDS = [0.0, 0.02, 0.1, 0.3], 3

_GRID = f"""with {C._NB1}, tr as (select id, round(p[y + 1], 9) as trust from np), qs as (select unnest({SHARES}::double[]) as q),
qc as (select q, {' '.join(['case'] + [f'when q = {q} then (select quantile_cont(trust, {q}) from tr)' for q in SHARES] + ['end'])} as cut from qs),
dt as (select m.id, x, y, id % {FOLDS} as fold, trust from m join tr using (id)), fs as (select unnest(range({FOLDS})) as f),
gn as (select q, f, c, count(*) filter (where y = c)::double as n, count(*)::double as t from dt, qc, fs, c where fold <> f and trust >= cut group by q, f, c),
gs as (select q, f, c, j, coalesce(sum(x[j]) filter (where y = c), 0) as s from dt, qc, fs, c, j where fold <> f and trust >= cut group by q, f, c, j),
gz as (select q, f, id, y, c, any_value(ln((n + 1) / (t + 4))) + sum(case when x[j] > 0 then ln((s + 1) / (n + 2)) else ln(1 - (s + 1) / (n + 2)) end) as z from dt join fs on fold = f join gn using (f) join gs using (q, f, c) group by q, f, id, y, c),
gp as (select q, id, y, list(round(z, 9) order by c) as z from gz group by q, id, y)
select q as quantile, round(any_value(cut), 6) as threshold, round(avg((list_position(z, list_max(z)) - 1 = y)::integer), 6) as accuracy, any_value((select count(*) from tr where trust >= cut)) as kept from gp join qc using (q) group by q"""


class _Rounded:
    """Trust to nine digits, so that two engines cut alike."""

    def __init__(self, inner) -> None:
        self.inner = inner

    def __repr__(self) -> str:
        return "naive Bayes confidence, nine digits"

    def trust_score(self, df):
        return self.inner.trust_score(df).withColumn("trust", F.round("trust", 9))


@C.query("H04_quantile_grid", _GRID)
def _grid(spark, sf):
    detector = T.ModelProbingDetector(N.NoEnsemble(C._FIT), C.P.confidence("probabilities"), "sum")
    rows = B.languages(spark, sf).withColumn("fold", F.pmod(F.col("id"), F.lit(FOLDS)).cast("int"))
    return grid.quantile_grid(rows, _Rounded(detector), SHARES, 4, FOLDS, memory={})
