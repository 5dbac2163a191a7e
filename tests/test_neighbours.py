"""Exact nearest neighbours against brute force, with copies, folds, small blocks and odd rows."""

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from trustloom.functions import probes as P
from trustloom.operators import aggregates as A
from trustloom.operators import detectors as T
from trustloom.operators import neighbours as H
from trustloom.plans import catalogue as C
from trustloom.plans import neighbour_queries as N


def brute(rows, k, ok=lambda a, b: True):
    out = {}
    for a in rows:
        found = sorted((float(((np.array(a[1]) - np.array(b[1])) ** 2).sum()), b[0]) for b in rows if b[0] != a[0] and ok(a, b))
        out[a[0]] = [i for _, i in found[:k]]
    return out


@pytest.fixture
def small(monkeypatch):
    """Many cells, chunks and blocks for few rows."""
    for name, v in (("CELL", 12), ("BLOCK", 9), ("SALT", 3)):
        monkeypatch.setattr(H, name, v)


def points(n=150):
    rng = np.random.default_rng(5)
    X = np.concatenate([rng.normal(c, 1, (n // 3, 3)) for c in (0, 4)] + [np.tile([[1.0, 2.0, 3.0]], (n // 3, 1))]).round(1)
    return [(i, [float(v) for v in x], int(i % 3)) for i, x in enumerate(X)]


def test_neighbours_with_a_third_of_copies(spark, small):
    rows = points()
    df = spark.createDataFrame(rows, "id long, x array<double>, y int").repartition(4)
    got = {r.id: [v.id for v in r.near] for r in H.neighbours(df, 4).collect()}
    assert got == brute(rows, 4)


def test_neighbours_of_other_folds(spark, small):
    rows = [(*r, r[0] * 7 % 4, r[0] % 2) for r in points(90)]
    df = spark.createDataFrame(rows, "id long, x array<double>, y int, fold int, part int")
    got = {r.id: [v.id for v in r.near] for r in H.neighbours(df, 3, "fold", "part").collect()}
    assert got == brute(rows, 3, lambda a, b: a[3] != b[3] and a[4] == b[4])


def test_few_and_odd_rows(spark):
    df = spark.createDataFrame([(1, [0.0], 0), (2, [1.0], 1), (3, None, 1), (4, [0.0], None)], "id long, x array<double>, y int")
    got = {r.id: None if r.near is None else [(v.d, v.id, v.y) for v in r.near] for r in H.neighbours(df, 5).collect()}
    assert got == {1: [(0.0, 4, None), (1.0, 2, 1)], 2: [(1.0, 1, 0), (1.0, 4, None)], 3: None, 4: [(0.0, 1, 0), (1.0, 2, 1)]}
    assert H.neighbours(df.limit(0)).count() == 0 and [r.near for r in H.neighbours(df.limit(1)).collect()] in ([[]], [None])


def test_detectors_over_neighbours_find_planted_flips(spark):
    rng = np.random.default_rng(3)
    X = np.concatenate([rng.normal(c, 0.5, (60, 2)) for c in (0, 5)])
    y = np.repeat([0, 1], 60)
    y[[5, 100]] = 1 - y[[5, 100]]
    df = spark.createDataFrame([(i, [float(v) for v in x], int(c)) for i, (x, c) in enumerate(zip(X, y))], "id long, x array<double>, y int")
    for ensemble in (H.NeighboursLeaveOneOut(2), H.NeighboursFolds(2, splits=5, repeats=2)):
        for probe in (P.confidence("probabilities"), "accuracy"):
            out = T.ModelProbingDetector(ensemble, probe, A.oob("mean")).trust_score(df).orderBy("trust", "id").limit(2).collect()
            assert {r.id for r in out} == {5, 100}
    with pytest.raises(ValueError):
        H.NeighboursLeaveOneOut(2).probe(df, P.confidence("logits")).count()


def test_members_are_out_of_fold(spark):
    df = spark.createDataFrame(points(60), "id long, x array<double>, y int")
    out = H.NeighboursFolds(3, 3, 4, 2).probe(df, P.confidence("probabilities"))
    assert out.count() == 120 and out.filter("oob").count() == 120 and out.agg(F.count_distinct("member")).first()[0] == 8


def test_rows_without_structure_are_not_copied_for_each_cell(spark, monkeypatch):
    monkeypatch.setattr(H, "CELL", 8)
    written, stored = {}, H.stored

    def counted(df, name="table", **options):
        out = stored(df, name, **options)
        written[name] = out.count()
        return out

    monkeypatch.setattr(H, "stored", counted)
    rows = [(i, [float(v) for v in x], 0) for i, x in enumerate(np.random.default_rng(2).normal(size=(400, 32)))]
    got = {r.id: [v.id for v in r.near] for r in H.neighbours(spark.createDataFrame(rows, "id long, x array<double>, y int"), 3).collect()}
    assert got == brute(rows, 3)
    assert max(written.values()) <= 400  # fifty cells, none of which can be ruled out


@pytest.mark.parametrize("scale, at", [(1.0, 1e7), (1e20, 0.0), (1e-25, 0.0)])
def test_numbers_that_single_precision_cannot_tell_apart(spark, monkeypatch, scale, at):
    monkeypatch.setattr(H, "BLOCK", 40)
    rows = [(i, [at + float(v) * scale for v in x], 0) for i, x in enumerate(np.random.default_rng(4).integers(-9, 9, (120, 4)))] + [(900, [0.0, float("nan"), 0.0, 0.0], 0)]
    got = {r.id: r.near and [v.id for v in r.near] for r in H.neighbours(spark.createDataFrame(rows, "id long, x array<double>, y int"), 4).collect()}
    assert got == brute(rows[:-1], 4) | {900: None}


def test_each_pair_of_blocks_meets_once_for_both_directions(spark, monkeypatch):
    for name, v in (("CELL", 8), ("BLOCK", 60)):
        monkeypatch.setattr(H, name, v)
    seen, stored = {}, H.stored

    def counted(df, name="table", **options):
        out = stored(df, name, **options)
        seen[name] = out.select("block").distinct().count() if name == "first" else out.count()
        return out

    monkeypatch.setattr(H, "stored", counted)
    rows = [(i, [float(v) for v in x], 0) for i, x in enumerate(np.random.default_rng(6).normal(size=(200, 24)))]
    got = {r.id: [v.id for v in r.near] for r in H.neighbours(spark.createDataFrame(rows, "id long, x array<double>, y int"), 3).collect()}
    assert got == brute(rows, 3)
    assert seen["first"] > 2 and seen["met"] == seen["first"] * (seen["first"] - 1) // 2


def test_pairs_of_equal_distance_are_not_held(monkeypatch):
    for name, v in (("HELD", 500), ("TILE", (8, 16)), ("SOME", 5)):
        monkeypatch.setattr(H, name, v)
    rng = np.random.default_rng(7)
    Q, X = np.eye(70)[rng.permutation(70)], np.eye(140)[70:, 70:] - 1  # all of Q as far from all of X, or nearly
    folds = rng.integers(0, 3, 70), rng.integers(0, 3, 70)
    most = []

    def nearest(ids):
        rows = pa.array([[{"id": int(i), "y": 0}] for i in ids], pa.list_(pa.struct([("id", pa.int64()), ("y", pa.int32())])))
        out = H._Nearest(rows, 4)
        add = out.add
        out.add = lambda *a: (add(*a), most.append(out.held))
        return out

    of_x, of_q = rng.permutation(70), rng.permutation(70)
    forth, back = nearest(of_x), nearest(of_q)
    cut = np.where(np.arange(70) % 5 == 0, -np.inf, np.inf)
    H._meet(Q, X, cut, forth, folds, np.full(70, np.inf), back)
    D = ((Q[:, None] - X[None]) ** 2).sum(axis=2)
    D[folds[0][:, None] == folds[1][None]] = np.inf
    for out, D, ids, asks in ((forth, D, of_x, np.isfinite(cut) | (cut > 0)), (back, D.T, of_q, np.full(70, True))):
        i, d, rows = out.found()
        got = [(int(a), float(b), c["id"]) for a, b, c in zip(i, d, rows.to_pylist())]
        assert got == [(q, float(b), int(c)) for q in range(70) if asks[q] for b, c in sorted((D[q, j], ids[j]) for j in range(70) if np.isfinite(D[q, j]))[:4]]
    assert max(most) <= 500


@pytest.mark.parametrize("name, copies", [("E03b_leave_one_out_neighbours", 1), ("D11b_consensus_neighbours", 2)])
def test_queries_write_no_row_for_each_cell(spark, monkeypatch, tmp_path, name, copies):
    for constant, v in (("CELL", 8), ("BLOCK", 60)):
        monkeypatch.setattr(H, constant, v)
    written, stored = {}, H.stored

    def counted(df, name="table", **options):
        out = stored(df, name, **options)
        written[name] = out.count()
        return out

    monkeypatch.setattr(H, "stored", counted)
    n, rng = 300, np.random.default_rng(8)
    vectors = pa.array(rng.normal(size=(n, 24)).astype(np.float32).tolist(), pa.list_(pa.float32()))
    pq.write_table(pa.table({"vec_id": pa.array(range(n), pa.int64()), "embedding": vectors, "label": pa.array(rng.integers(0, N.CLASSES, n), pa.int32())}), tmp_path / "embeddings.parquet")
    got = {r.id: r.trust for r in C.QUERIES[name](spark, str(tmp_path)).collect()}
    with duckdb.connect() as con:
        con.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet'")
        assert got == pytest.approx(dict(con.execute(C.ORACLE_SQL[name]).fetchall()), abs=1e-6)
    assert max(written.values()) <= copies * n  # a row for each point, whatever the cells


@pytest.mark.parametrize("parts", [1, 2])
def test_blocks_asked_are_kept_for_a_block_not_for_each_point(spark, monkeypatch, parts):
    for constant, v in (("CELL", 8), ("BLOCK", 30)):
        monkeypatch.setattr(H, constant, v)
    seen, stored = {}, H.stored

    def counted(df, name="table", **options):
        seen[name] = stored(df, name, **options)
        return seen[name]

    monkeypatch.setattr(H, "stored", counted)
    rows = [(i, [float(v) for v in x], 0, i % 2, i // 2 % parts) for i, x in enumerate(np.random.default_rng(9).normal(size=(240, 24)))]
    got = {r.id: [v.id for v in r.near] for r in H.neighbours(spark.createDataFrame(rows, "id long, x array<double>, y int, fold int, part int"), 3, "fold", "part").collect()}
    assert got == brute(rows, 3, lambda a, b: a[3] != b[3] and a[4] == b[4])
    blocks = seen["first"].select("block").distinct().count()
    assert blocks > 4 * parts
    asked = seen["first"].select(F.explode("asks")).count()
    assert 0 < asked <= blocks * (blocks - 1)
