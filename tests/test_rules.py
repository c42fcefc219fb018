"""Rules of small operators at their edges."""

import math
import random

import pytest
from pyspark.sql import functions as F

from lattica.operators import access, evidence, graph, qc
from lattica.plans import ranking, scratch


def test_basename(spark):
    names = {"d/sample.zarr.zip": "sample", "x.h5": "x", "x.h5ad.gz": "x", "a/b.c/y": "y", "y.tsv.gz": "y.tsv", ".hidden": ".hidden", "dir/z.zarr/": "z", "plain": "plain", "q.zarr": "q"}
    got = spark.createDataFrame([(n,) for n in names], "p string").select("p", access.basename(F.col("p")).alias("b")).collect()
    assert {r.p: r.b for r in got} == names


def test_binomial_edges(spark):
    rows = [(m, k) for m in range(0, 13) for k in range(-1, 16)]
    got = spark.createDataFrame(rows, "m int, k int").select("m", "k", access.upper_tail_of_half(F.col("m"), F.col("k")).alias("p")).collect()
    for r in got:
        want = 1.0 if r.m == 0 else min(1.0, sum(math.comb(r.m, i) for i in range(max(0, min(r.k, r.m)), r.m + 1)) / 2**r.m)
        assert abs(r.p - want) < 1e-12


def test_log_factorial_and_fisher(spark):
    values = [*range(60), 1000, 10**6, 10**9]
    got = spark.createDataFrame([(v,) for v in values], "x long").select("x", access.log_factorial(F.col("x")).alias("y")).collect()
    assert all(abs(r.y - math.lgamma(r.x + 1)) <= 1e-13 * max(1, math.lgamma(r.x + 1)) for r in got)
    tables = [(3, 1, 1, 3), (0, 5, 5, 0), (10, 2, 3, 15), (400, 300, 200, 500)]
    got = spark.createDataFrame(tables, "a long, b long, c long, d long").select("a", "b", "c", "d", access.fisher_greater(*map(F.col, "abcd")).alias("p")).collect()
    for r in got:
        row, col, n = r.a + r.b, r.a + r.c, r.a + r.b + r.c + r.d
        want = sum(math.comb(row, i) * math.comb(n - row, col - i) for i in range(r.a, min(row, col) + 1)) / math.comb(n, col)
        assert abs(r.p - want) < 1e-9


def test_memberships(spark):
    samples = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "col_id long, name string")
    wide = spark.createDataFrame([("a", 0.5, -0.25), ("b", 0.0, None), ("z", 1.0, 1.0)], "cell string, t double, u double")
    assert sorted(map(tuple, access.membership_proportions(wide, samples, "cell").collect())) == [(0, "t", 0.5), (0, "u", -0.25)]
    with pytest.raises(ValueError):
        access.membership_proportions(wide.where("cell = 'z'"), samples, "cell")
    with pytest.raises(ValueError):
        access.onehot(spark.createDataFrame([("z", "x")], "name string, label string"), samples)


def test_top_hits(spark):
    rows = [("x", v, t, p) for v, t, p in [(1, 1, 0.9), (1, 2, 0.9), (0, 2, 0.9), (5, 1, 0.95), (6, 1, 0.7), (7, 1, 0.71), (8, 1, 0.72), (9, 1, 0.699)]] + [("y", 1, 1, 0.1)]
    got = access.top_hits(spark.createDataFrame(rows, "block string, variant int, trait int, pip double"), "block").orderBy("rank").collect()
    assert [(r.variant, r.trait, r["rank"], r.more) for r in got] == [(5, 1, 1, 2), (0, 2, 2, 2), (1, 1, 3, 2), (1, 2, 4, 2), (8, 1, 5, 2)]


def test_restricted_by_file(spark):
    cells = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("c", 1)], "file string, cell int")
    got = evidence.restricted(cells, spark.createDataFrame([("a", 2), ("b", 9)], "file string, cell int"), spark.createDataFrame([("a",), ("b",)], "file string"))
    assert sorted(map(tuple, got.collect())) == [("a", 2), ("c", 1)]


def test_median_of_mostly_zeros(spark, monkeypatch):
    monkeypatch.setattr(ranking, "MOST", 20)
    random.seed(1)
    for n in (1, 2, 9, 10, 500):
        values = [0.0] * (n * 3 // 4) + [random.random() for _ in range(n - n * 3 // 4)]
        df = spark.createDataFrame([(v,) for v in [*values, float("nan"), float("inf"), None]], "v double")
        assert qc.upper_median(df, "v").first().m == sorted(values)[n // 2]
    assert qc.upper_median(df.where("v IS NULL"), "v").collect() == []
    kept = {r.v: r.keep for r in qc.robust_keep(spark.createDataFrame([(0.0,)] * 5 + [(9.0,), (None,)], "v double"), "v", 2.0).collect()}
    assert kept == {0.0: True, 9.0: False, None: False}


def hub_graph(seed):
    """A hub that all nodes know, others at random."""
    random.seed(seed)
    pairs = {(0, i) for i in range(1, 80)} | {tuple(sorted(random.sample(range(1, 80), 2))) for _ in range(250)} | {(200, 201)}
    return sorted(pairs)


def test_shared_neighbours_with_a_hub(spark):
    pairs = hub_graph(3)
    near = {}
    for u, v in pairs:
        near.setdefault(u, set()).add(v)
        near.setdefault(v, set()).add(u)
    edges = spark.createDataFrame(pairs, "u long, v long")
    assert sorted(map(tuple, graph.shared_neighbours(edges).collect())) == [(u, v, len(near[u] & near[v])) for u, v in pairs]
    low = [r["count"] for r in graph.oriented(edges).groupBy("low").count().collect()]
    assert max(low) <= (2 * len(pairs)) ** 0.5
    for least in (1, 2, 3, 5):
        want = {(u, v) for u in near for v in near if u < v and len(near[u] & near[v]) >= least} | set(pairs)
        assert {tuple(r) for r in graph.augment_snn(edges, least).collect()} == want
    assert graph.augment_snn(edges, 0).count() == len(pairs) and graph.shared_neighbours(edges.where("false")).collect() == []


def test_tables_go_with_the_driver():
    """The folder of intermediate tables is gone when the driver has ended."""
    import os
    import subprocess
    import sys
    import tempfile

    folder = tempfile.mkdtemp(prefix="spark-")
    code = f"""
from pyspark.sql import SparkSession
from lattica.plans.scratch import materialize, session_folder
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", "file://{folder}").getOrCreate()
print(materialize(spark.range(3), "x").count(), session_folder(spark))
"""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = subprocess.run([sys.executable, "-c", code], env=os.environ | {"PYTHONPATH": root}, capture_output=True, text=True, timeout=120).stdout.split()
    assert out[0] == "3" and out[1].startswith(f"file://{folder}/lattica-") and not os.path.exists(out[1].removeprefix("file://"))
    assert scratch.materialize is not None


def test_common_neighbours_by_lists_and_by_prefixes(spark):
    """Both ways give the same pairs; a flat graph shuffles lists of neighbours, not its candidates' neighbours."""
    edges = spark.createDataFrame(hub_graph(4), "u long, v long")
    for least in (1, 2, 4):
        ways = [{tuple(r) for r in graph.augment_snn(edges, least, listed, cheap).collect()} for listed, cheap in ((20_000, 256), (3, 256), (20_000, 0))]
        assert ways[0] == ways[1] == ways[2]
    written = lambda: sum(e.totalShuffleWrite() for e in (lambda x: [x.apply(i) for i in range(x.size())])(spark.sparkContext._jsc.sc().statusStore().executorList(False)))
    before = written()
    flat = spark.range(20_000).selectExpr("pmod(xxhash64(id), 2000) AS u", "2000 + pmod(xxhash64(id, 1), 2000) AS v").distinct()
    assert graph.augment_snn(flat, 2).count() > 0
    assert written() - before < 2_600_000
