"""Fuzzy weights by a plain bisection; sign flips by the same signs and by known cases."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from lattica.operators import kernels


def plain_scale(ds):
    low, high, mid, near, target = 0.0, math.inf, 1.0, min(ds), math.log2(len(ds))
    for _ in range(64):
        total = sum(math.exp(-(d - near) / mid) if d > near else 1.0 for d in ds)
        if abs(total - target) < 1e-5:
            break
        if total > target:
            high = mid
            mid = (low + high) / 2
        else:
            low = mid
            mid = mid * 2 if high == math.inf else (low + high) / 2
    return max(mid, sum(ds) / len(ds) * 1e-3)


def test_fuzzy_weights(spark):
    random.seed(2)
    near = {(q, i): random.choice([0.0, 1.0, round(random.random() * 9, 3)]) for q in range(30) for i in random.sample([x for x in range(30) if x != q], random.choice([1, 2, 5, 8]))}
    by = {}
    for (q, _), d in near.items():
        by.setdefault(q, []).append(d)
    want = {}
    for (q, i), d in near.items():
        gap = d - min(by[q])
        scale = plain_scale(by[q])
        w = 1.0 if gap <= 0 else math.exp(-gap / scale) if scale > 0 else 0.0
        e = (min(q, i), max(q, i))
        want[e] = want.get(e, 0.0) + w - want.get(e, 0.0) * w
    got = {(r.u, r.v): r.weight for r in kernels.fuzzy_weights(spark.createDataFrame([(*k, v) for k, v in near.items()] + [(3, 3, 0.0), (4, 5, None)], "query long, id long, distance double")).collect()}
    assert set(got) == set(want) and all(abs(got[e] - want[e]) < 1e-6 and 0 <= got[e] <= 1 for e in want)


def test_sign_flips(spark):
    rng = np.random.default_rng(1)
    rows = [("hot", i, float(v)) for i, v in enumerate(rng.normal(0.3, 1, 2000))] + [("null", i, float(v)) for i, v in enumerate(rng.normal(0, 1, 60))] + [("one", 1, 2.0), ("zero", 1, 0.0), (None, 5, 1.0), ("hot", 9, None)]
    df = spark.createDataFrame(rows, "grp string, id long, x double")
    got = {r.grp: r for r in kernels.sign_flip_pvalues(df, "grp", 300, 7).collect()}
    again = {r.grp: r.p for r in kernels.sign_flip_pvalues(df.repartition(5), "grp", 300, 7).collect()}
    assert set(got) == {"hot", "null", "one", "zero", None} and {g: r.p for g, r in got.items()} == again
    assert got["hot"].p == 1 / 301 and got["null"].p > 0.05 and got["one"].p == got["zero"].p == got[None].p == 1.0
    h = {r.id: r.h for r in spark.range(60).select("id", F.xxhash64(F.lit(7), "id").alias("h")).collect()}
    x = np.array([r[2] for r in rows if r[0] == "null"])
    signs = kernels.flips(np.array([h[i] for i in range(60)]), 300, 7)
    assert got["null"].p == (1 + (np.abs(x @ signs) >= abs(x.sum()) * (1 - 1e-9)).sum()) / 301
    assert abs(signs.mean()) < 0.03 and abs(np.corrcoef(signs[:, :8].T) - np.eye(8)).max() < 0.5
    assert kernels.sign_flip_pvalues(df.where("false"), "grp").collect() == []


def test_sign_flips_of_many_groups_and_of_a_crowd(spark, monkeypatch):
    """Many small groups shuffle rows, not an array of draws for each batch; a crowded group is dealt to several tasks with the same result."""
    written = lambda: sum(e.totalShuffleWrite() for e in (lambda x: [x.apply(i) for i in range(x.size())])(spark.sparkContext._jsc.sc().statusStore().executorList(False)))
    df = spark.range(20_000).selectExpr("IF(id < 8000, 0, IF(id < 8100, NULL, id % 3000)) AS grp", "id", "(id % 13 - 5.5D) / 7 AS x")
    before = written()
    once = {r.grp: r for r in kernels.sign_flip_pvalues(df, "grp", 300, 7).collect()}
    assert written() - before < 1_500_000
    monkeypatch.setattr(kernels, "SHARE", 1000)
    again = {r.grp: r for r in kernels.sign_flip_pvalues(df, "grp", 300, 7).collect()}
    assert len(once) == 3001 and once[0].n == 8004 and once[None].n == 100 and {g: r.p for g, r in once.items()} == {g: r.p for g, r in again.items()}
    assert all(r.n == again[g].n and abs(r.mean - again[g].mean) < 1e-12 for g, r in once.items())
