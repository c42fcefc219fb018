"""Exact neighbours by pivots against all pairs: crowded cells, ties, batches, few points."""

import numpy as np
import pytest

from lattica.operators import neighbours


def plain(queries, points, k, others=False):
    out = {}
    for q, x in queries:
        for batch in {b for *_, b in points}:
            d = sorted((round(float(((np.array(x) - np.array(y)) ** 2).sum()), 9), i) for i, y, b in points if b == batch and not (others and i == q))[:k]
            if d:
                out[q, batch] = [(i, r) for r, (_, i) in enumerate(d, 1)]
    return out


def shown(df):
    out = {}
    for r in df.orderBy("rank").collect():
        out.setdefault((r.query, r.batch), []).append((r.id, r["rank"]))
    return out


def cloud(seed, n=700):
    """Nine tenths of the points in one place, exact ties, batches of unequal size."""
    rng = np.random.default_rng(seed)
    x = np.where(rng.random(n)[:, None] < 0.9, rng.normal(0, 0.05, (n, 3)), rng.normal(0, 4, (n, 3))).round(2)
    return [(i, v.tolist(), "ab"[i % 7 == 0] if i != 5 else "lone") for i, v in enumerate(x)]


@pytest.mark.parametrize("others", [False, True])
def test_knn_by_pivots(spark, monkeypatch, others):
    monkeypatch.setattr(neighbours, "WORTH", 20)
    monkeypatch.setattr(neighbours, "CHUNK_BYTES", 8 * 3 * 50)
    monkeypatch.setattr(neighbours, "BLOCK", 16)
    rows = cloud(1)
    points = spark.createDataFrame([*rows, (900, None, "a"), (901, [1.0, None, 2.0], "a"), (None, [1.0, 2.0, 3.0], "a"), (902, [0.0, 0.0, 0.0], None)], "id long, vector array<double>, batch string")
    queries = points.where("id % 9 = 0 AND id < 800")
    asked = [(i, x) for i, x, _ in rows if i % 9 == 0]
    assert shown(neighbours.knn(queries, points, 6, others, "batch")) == plain(asked, rows, 6, others)
    every = [(i, x, "") for i, x, _ in rows] + [(902, [0.0, 0.0, 0.0], "")]
    got = neighbours.knn(queries, points, 6, others).withColumn("batch", neighbours.F.lit(""))
    assert shown(got) == plain(asked, every, 6, others)


def test_knn_of_few_points(spark):
    points = spark.createDataFrame([("x", [0.0]), ("y", [0.0]), ("z", [3.0])], "id string, vector array<double>")
    got = neighbours.knn(points, points, 5, others=True).orderBy("query", "rank").collect()
    assert [(r.query, r.id) for r in got] == [("x", "y"), ("x", "z"), ("y", "x"), ("y", "z"), ("z", "x"), ("z", "y")]
    assert neighbours.knn(points, points.where("false"), 5).collect() == [] and neighbours.knn(points.where("false"), points, 5).collect() == []


def test_only_near_cells_are_met(spark, monkeypatch):
    """Two far clouds: a query meets no points of the other one in the second round."""
    monkeypatch.setattr(neighbours, "WORTH", 50)
    met = []
    monkeypatch.setattr(neighbours, "materialize", lambda df, name, f=neighbours.materialize: met.append((name, out := f(df, name))) or out)
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(0, 1, (300, 2)), rng.normal(1000, 1, (300, 2))])
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<double>")
    assert {r.id for r in neighbours.knn(points.where("id < 10"), points, 4).collect()} <= set(range(300))
    asked = [r.cell for name, df in met if name == "visits" for r in df.collect()]
    cells = {r.cell: r.id < 300 for name, df in met if name == "dealt" for r in df.collect()}
    assert asked and all(cells[c] for c in asked)


def test_matched_columns(spark):
    cells = spark.createDataFrame([(0, 1, 2.0), (4, 1, 3.0), (0, 2, 1.0)], "row_id long, col_id long, val double")
    found = spark.createDataFrame([(7, 1, 1, 0.0), (8, 1, 1, 0.1), (8, 2, 2, 0.2), (8, 9, 3, 0.3)], "query long, id long, rank int, distance double")
    assert sorted(map(tuple, neighbours.matched_columns(cells, found).collect())) == [(7, 1, 0, 2.0), (7, 1, 4, 3.0), (8, 1, 0, 2.0), (8, 1, 4, 3.0), (8, 2, 0, 1.0)]


@pytest.mark.parametrize("others", [False, True])
def test_matrices_and_visits_in_pieces(spark, monkeypatch, others):
    """with few distances held, few queries dealt at once and visits leaving in pieces, ties and all, the neighbours are those of brute force."""
    for name, value in (("WORTH", 4), ("HELD", 30), ("SLICE", 3), ("VISITS", 5)):
        monkeypatch.setattr(neighbours, name, value)
    rng = np.random.default_rng(3)
    x = rng.integers(0, 4, (90, 3)).astype(float)
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<double>")
    got = {(r.query, r.rank): (r.id, r.distance) for r in neighbours.knn(points.where("id % 4 = 0"), points, 6, others=others).collect()}
    want = {}
    for q in range(0, 90, 4):
        far = ((x - x[q]) ** 2).sum(axis=1)
        ranked = [i for i in sorted(range(90), key=lambda i: (far[i], i)) if not others or i != q][:6]
        want |= {(q, r + 1): (i, far[i]) for r, i in enumerate(ranked)}
    assert got == want


def test_labels_of_every_embedding(spark, tmp_path):
    """shares of labels for all rows of the table, not for one in a hundred, by brute force; also where a query goes to few places and blocks are small."""
    import math

    from lattica import catalog

    catalog.load()
    rng = np.random.default_rng(5)
    x = rng.normal(0, 1, (300, 8)).round(1).astype("float32")
    rows = [(i, v.tolist(), int(i * 7 % 4)) for i, v in enumerate(x)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    want = {}
    for q, v in enumerate(x.astype(float)):
        near = sorted((round(float(((v - y) ** 2).sum()), 9), i) for i, y in enumerate(x.astype(float)))[:10]
        half = 2 * max(1e-12, float(np.median([d for d, _ in near])))
        e = [math.exp(-d / half) for d, _ in near]
        for (_, i), w in zip(near, e):
            want[q, rows[i][2]] = want.get((q, rows[i][2]), 0.0) + w / sum(e)
    got = {(r.query, r.label): r.share for r in catalog.QUERIES["knn_label_impute"](spark, str(tmp_path)).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1.1e-5 for k in want)
    assert "%" not in catalog.SQL["knn_label_impute"]


@pytest.mark.parametrize("others", [False, True])
def test_far_points_are_met_in_few_places(spark, monkeypatch, others):
    """points of many dimensions, where every query meets all cells: cells are met together, split by blocks and chunks, ties and huge values included."""
    for name, value in (("WORTH", 8), ("BLOCK", 16), ("PLACES", 3), ("CHUNK_BYTES", 8 * 12 * 40)):
        monkeypatch.setattr(neighbours, name, value, raising=False)
    visits = []
    monkeypatch.setattr(neighbours, "materialize", lambda df, name, f=neighbours.materialize: visits.append((name, out := f(df, name))) or out)
    rng = np.random.default_rng(6)
    x = rng.normal(0, 1, (240, 12))
    x[200:220], x[230] = x[0:20], 1e9
    rows = [(i, v.tolist(), "") for i, v in enumerate(x)]
    points = spark.createDataFrame([r[:2] for r in rows], "id long, vector array<double>")
    got = neighbours.knn(points, points, 5, others).withColumn("batch", neighbours.F.lit(""))
    assert shown(got) == plain([r[:2] for r in rows], rows, 5, others)
    second = [df for name, df in visits if name == "visits"][1]
    assert second.count() <= 240 * 12
