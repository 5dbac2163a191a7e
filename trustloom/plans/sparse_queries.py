"""Queries on sparse rows, and SQL on long tables of their non-zeros."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from trustloom.operators import linear as L
from trustloom.operators import sparse as S
from trustloom.plans import base as B
from trustloom.plans import catalogue as C
from trustloom.sources.store import stored

query = C.query
LEAST, CLASSES = 2, len(B.LANGS)


def texts(spark, sf):
    """id, text, y: the language."""
    y = F.array_position(F.array(*[F.lit(v) for v in B.LANGS]), F.col("lang")).cast("int") - 1
    return B.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text", y.alias("y"))


_TF_IDF = f"""
d as (select doc_id as id, coalesce(text, '') as text, list_position({B.LANGS!r}, lang) - 1 as y from documents),
w as (select id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}]+'), lambda w: w <> '')) as term from d),
c as (select id, term, count(*) as n from w group by id, term),
k as (select term, ln((1.0 + (select count(*) from d)) / (1.0 + count(*))) + 1 as idf from c group by term having count(*) >= {LEAST}),
u as (select id, term, n * idf as v from c join k using (term)),
x as (select id, term, v / sqrt(sum(v * v) over (partition by id)) as v from u)"""

query("F09_tf_idf", f"with {_TF_IDF} select d.id, count(x.v) as n, round(coalesce(sum(x.v), 0), 6) as total from d left join x using (id) group by d.id")(
    lambda s, d: S.tf_idf(texts(s, d), least=LEAST)[0].select("id", F.size("i").cast("long").alias("n"), F.aggregate("v", F.lit(0.0), lambda a, v: a + v).alias("total"))
)

_UNIFORM = f"""with {_TF_IDF}, cl as (select unnest(range({CLASSES})) as c),
g as (select id, c, 1.0 / {CLASSES} - (y = c)::integer as g from d, cl),
mg as (select term, c, sum(v * g) / (select count(*) from d) as m from x join g using (id) group by term, c),
s as (select id, sum(v * g * m) as dot from x join g using (id) join mg using (term, c) group by id),
n as (select sqrt({1 - 1 / CLASSES} * (select sum(m * m) from mg)) as n)"""


def _agra(spark, sf):
    """The gradients of the model that knows nothing: all words of the corpus are its features."""
    rows, width = S.tf_idf(texts(spark, sf), least=LEAST)
    model = S.SparseModel(np.zeros((CLASSES, width)))
    return S.sparse_detectors(lambda df: model)["agra"].trust_score(stored(rows, "rows"))


query("D06b_agra_sparse", f"{_UNIFORM} select d.id, round(coalesce(dot / n, 0), 6) + 0.0 as trust from d left join s using (id), n")(_agra)


def _ridge(name: str):
    def run(spark, sf):
        rows = B.parts(spark, sf)
        model = S.SparseModel.of(L.fit_ridge(rows))
        return S.sparse_detectors(lambda df: model, 1)[name].trust_score(S.from_dense(rows))

    return run


query("D02b_self_influence_sparse", f"with {C._RIDGE} select id, round(-e * e * q, 6) + 0.0 as trust from i")(_ridge("self_influence"))
query("D03b_cook_distance_sparse", f"with {C._RIDGE} select id, round(-e * e * q / ((1 - q) * (1 - q)) / 2, 6) + 0.0 as trust from i")(_ridge("cook_distance"))
query("D04b_approximate_loo_sparse", f"with {C._RIDGE} select id, round({C._ALOO}, 6) + 0.0 as trust from i")(_ridge("approximate_loo"))
query("D05b_representer_sparse", f"with {C._RIDGE} select id, round(-abs(e) * x * x, 6) + 0.0 as trust from i")(_ridge("representer"))
