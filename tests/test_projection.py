"""Random projections and singular vectors against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.operators import projection


def cells_of(spark, a):
    rows = [(int(i), int(j), float(a[i, j])) for i, j in zip(*np.nonzero(a))]
    return spark.createDataFrame(rows, "row_id long, col_id long, val double").repartition(3)


def dense(rows, n):
    k = len(rows[0].vector)
    out = np.zeros((n, k))
    for r in rows:
        out[r.id] = r.vector
    return out


def low_rank(seed, n=60, m=45, rank=4):
    rng = np.random.default_rng(seed)
    a = rng.normal(size=(n, rank)) * np.array([9, 5, 3, 1]) @ rng.normal(size=(rank, m))
    a[7] = 0
    a[:, 9] = 0
    return a


def test_rsvd_reconstructs(spark):
    a = low_rank(1)
    u, s, v = projection.rsvd(cells_of(spark, a), 4)
    u, v = dense(u.collect(), 60), dense(v.collect(), 45)
    assert np.allclose(s, np.linalg.svd(a)[1][:4]) and np.allclose(u * s @ v.T, a)
    assert np.allclose(u.T @ u, np.eye(4), atol=1e-8) and np.allclose(v.T @ v, np.eye(4), atol=1e-8)
    assert (u[7] == 0).all() and (v[9] == 0).all()


def test_rsvd_of_noise_and_of_less_rank(spark):
    rng = np.random.default_rng(2)
    a = rng.normal(size=(100, 50)) + 8 * np.outer(rng.normal(size=100), rng.normal(size=50)) / 10
    u, s, v = projection.rsvd(cells_of(spark, a), 3)
    assert np.allclose(s[:1], np.linalg.svd(a)[1][:1], rtol=1e-3)
    u, v = dense(u.collect(), 100), dense(v.collect(), 50)
    assert np.allclose(u.T @ u, np.eye(3), atol=1e-8) and np.allclose(v.T @ v, np.eye(3), atol=1e-8)
    one = np.outer(np.arange(1.0, 6), np.ones(4))
    s = projection.rsvd(cells_of(spark, one), 3)[1]
    assert len(s) == 1 and np.allclose(s, np.linalg.svd(one)[1][0])
    eye = projection.rsvd(cells_of(spark, np.eye(8)), 3)[1]
    assert np.allclose(eye, 1)
    assert len(projection.rsvd(cells_of(spark, one).where("false"), 3)[1]) == 0


def test_tall_svd_is_exact(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 6)) * np.array([5, 4, 3, 2, 1, 0.5])
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<double>").repartition(9)
    left, s, v = projection.tall_svd(rows, 6)
    assert np.allclose(s, np.linalg.svd(x)[1]) and np.allclose(dense(left.collect(), 300) * s @ v.T, x)
    code = {r.id: r.code for r in projection.sign_codes(rows, 3).collect()}
    u = dense(left.collect(), 300)[:, :3]
    assert [code[i] for i in range(300)] == ((u - u.mean(axis=0) > 0) * np.array([1, 2, 4])).sum(axis=1).tolist()


@pytest.mark.parametrize("weighted", [False, True])
def test_projection_as_plain(spark, weighted):
    rng = np.random.default_rng(4)
    a = rng.poisson(1.5, size=(30, 20)).astype(float)
    a[:, 3] = 0
    signs = spark.range(30).select("id", *(projection.sign(F.col("id"), 7, k).alias(f"k{k}") for k in range(5))).orderBy("id").toPandas().to_numpy()[:, 1:].astype(float)
    assert set(np.unique(signs)) == {-1.0, 1.0}
    w = np.where(np.arange(30) % 4 == 0, 0.0, 1.0 + np.arange(30) % 3) if weighted else np.ones(30)
    b = np.arange(20) % 2
    weights = spark.createDataFrame([(i, float(x)) for i, x in enumerate(w)], "row_id long, weight double") if weighted else None
    batches = spark.createDataFrame([(i, int(x)) for i, x in enumerate(b)], "col_id long, batch int")
    got = projection.project_columns(cells_of(spark, a), 5, 7, weights, batches).withColumnRenamed("col_id", "id").collect()
    x = np.log1p(a)
    x = x / np.maximum(np.linalg.norm(x, axis=0), 1e-8)
    p = (x * w[:, None]).T @ signs
    keep = a.sum(axis=0) > 0
    for g in (0, 1):
        p[(b == g) & keep] -= p[(b == g) & keep].mean(axis=0)
    p = np.clip((p - p.mean(axis=1, keepdims=True)) / np.where(p.std(axis=1, keepdims=True) > 0, p.std(axis=1, keepdims=True), 1), -4, 4)
    assert {r.id for r in got} == set(np.flatnonzero(keep).tolist())
    assert all(np.allclose(r.vector, p[r.id]) for r in got)


def test_columns_without_variance_as_in_sql(spark):
    """Columns of two cells whose sums agree in all dimensions: whether rounding leaves a variance is told by the logarithm's last bit."""
    import math

    words = {i: projection_word(i) for i in range(4000)}
    flat = {v: [i for i, w in words.items() if w & 63 == v][:2] for v in (0, 63)}
    pairs = [(r, x, y) for rows in flat.values() for r in [tuple(rows)] for x in range(1, 51) for y in range(x, 60)]
    cells = spark.createDataFrame([(row, c, float(v)) for c, (r, x, y) in enumerate(pairs) for row, v in zip(r, (x, y))], "row_id long, col_id long, val double")
    got = {r.col_id: r.vector for r in projection.project_columns(cells, 6).collect()}
    for c, (r, x, y) in enumerate(pairs):
        s = 1.0 if words[r[0]] & 63 else -1.0
        a, b = math.log(1 + x), math.log(1 + y)
        v = s * (a + b) / math.sqrt(a * a + b * b)
        mean = (v + v + v + v + v + v) / 6
        spread = math.sqrt(sum([(v - mean) ** 2] * 6) / 6)
        assert got[c] == [(v - mean) / (spread if spread > 0 else 1.0)] * 6, (x, y)


def projection_word(i):
    import hashlib

    return int(hashlib.md5(f"1:0:{i}".encode()).hexdigest()[:15], 16)


def test_scaling_is_worked_out_once_a_row(spark):
    """no aggregate over the vector stands inside a lambda, where each element would repeat it."""
    cells = spark.createDataFrame([(r, c, float(r + c)) for r in range(6) for c in range(4)] + [(9, 9, 0.0)], "row_id long, col_id long, val double")
    out = projection.project_columns(cells, 5, seed=3)
    # One for the mean, one for the spread; inside lambdas the plan held seven.
    assert out._jdf.queryExecution().optimizedPlan().toString().count("aggregate(") == 2
    got = {r.col_id: np.array(r.vector) for r in out.collect()}
    assert np.allclose([v.mean() for c, v in got.items() if c != 9], 0) and np.allclose(got[9], 0)
    assert all(abs(v.std() - 1) < 1e-12 or np.allclose(v, 0) for v in got.values())
