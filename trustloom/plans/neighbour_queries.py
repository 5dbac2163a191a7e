"""Queries over exact nearest neighbours, and SQL by brute force."""

from __future__ import annotations

from pyspark.sql import functions as F

from trustloom.functions import probes as P
from trustloom.operators import aggregates as A
from trustloom.operators import detectors as T
from trustloom.operators import neighbours as H
from trustloom.plans import base as B
from trustloom.plans import catalogue as C

query = C.query
K, CLASSES, SPLITS, REPEATS = 5, 10, 5, 2

_ROWS = "v as (select vec_id as id, embedding::double[] as x, label::integer as y from embeddings)"
_D = "pow(list_distance(a.x, b.x), 2)"


def vectors(spark, sf):
    return B.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("x"), F.col("label").cast("int").alias("y"))


_NEAR = f"{_ROWS}, n as (select id, other, d from (select a.id, b.id as other, {_D} as d, row_number() over (partition by a.id order by {_D}, b.id) as place from v as a join v as b on a.id <> b.id) where place <= {K})"
query("M04_nearest_neighbours", f"with {_NEAR} select id, list(other order by d, other) as near, round(max(d), 6) as d from n group by id")(
    lambda s, d: H.neighbours(vectors(s, d), K).select("id", F.transform("near", lambda v: v["id"]).alias("near"), F.get("near", F.lit(K - 1))["d"].alias("d"))
)
query("E03b_leave_one_out_neighbours", f"with {_NEAR} select n.id, round(avg((b.y = a.y)::integer), 6) as trust from n join v as a using (id) join v as b on b.id = n.other group by n.id")(
    lambda s, d: T.ModelProbingDetector(H.NeighboursLeaveOneOut(CLASSES, K), P.confidence("probabilities"), A.oob("sum")).trust_score(vectors(s, d))
)


def _fold(repeat: int) -> str:
    h = C._HASH.format(a=(C.N.FACTOR + C.N.STRIDE * repeat) % C.N.PRIME, b=13 + repeat)
    buckets = "(select greatest(1, count(*) // 50000) from embeddings)"
    return f"(row_number() over (partition by y, {h} * {buckets} // 2147483647 order by {h}, id) % {SPLITS})::integer"


_FOLDED = f"""with {_ROWS}, fo as ({' union all '.join(f'select *, {r} as rep, {_fold(r)} as fold from v' for r in range(REPEATS))}),
n as (select rep, id, y, other from (select a.rep, a.id, a.y, b.y as other, row_number() over (partition by a.rep, a.id order by {_D}, b.id) as place from fo as a join fo as b on a.rep = b.rep and a.fold <> b.fold) where place <= {K}),
c as (select unnest(range({CLASSES})) as c), p as (select rep, id, y, c, count(*) filter (where other = c) / {K}.0 as p from n, c group by rep, id, y, c),
q as (select rep, id, y, list(p order by c) as p from p group by rep, id, y)"""
query("D11b_consensus_neighbours", f"{_FOLDED} select id, round(avg((list_position(p, list_max(p)) - 1 = y)::integer), 6) as trust from q group by id")(
    lambda s, d: T.ModelProbingDetector(H.NeighboursFolds(CLASSES, K, SPLITS, REPEATS), "accuracy", A.oob("mean")).trust_score(vectors(s, d))
)
query("D12b_confident_neighbours", f"{_FOLDED} select id, round(avg(p[y + 1]), 6) as trust from q group by id")(
    lambda s, d: T.ModelProbingDetector(H.NeighboursFolds(CLASSES, K, SPLITS, REPEATS), P.confidence("probabilities"), A.oob("mean")).trust_score(vectors(s, d))
)
