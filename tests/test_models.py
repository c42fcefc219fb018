"""Hidden Markov chains, k-means, tests on trees, spanning trees and shortest paths against plain versions."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.operators import clustering, hmm, paths, tree
from lattica.plans import ranking


@pytest.mark.parametrize("most", [10**6, 7])
def test_hmm_by_enumeration(spark, monkeypatch, most):
    """All state sequences of short chains; with most = 7 chains cross the borders of buckets."""
    monkeypatch.setattr(ranking, "MOST", most)
    monkeypatch.setattr(ranking, "LEAST", 5)
    rng = np.random.default_rng(2)
    means, trans, start = hmm.sticky([-1.0, 0.0, 1.5], 0.1)
    trans = trans + rng.normal(0, 0.2, (3, 3))
    chains = {c: rng.normal(0, 1, n).tolist() for c, n in {"a": 1, "b": 2, "c": 8, "d": 7, "e": 8, "f": 1}.items()}
    rows = [(c, t, y) for c, ys in chains.items() for t, y in enumerate(ys)] + [(None, 0, 1.0), ("a", 5, None)]
    df = spark.createDataFrame(rows, "chain string, t int, y double").withColumn("emit", hmm.gaussian("y", means, "1.2", "0.5"))
    got = {(r.chain, r.t): r for r in hmm.decode(df, "chain", ["t"], trans, start).collect()}
    assert len(got) == sum(map(len, chains.values()))
    for c, ys in chains.items():
        emit = np.array([[-0.5 * (np.log(0.5) + np.log(2 * np.pi)) - (y - 1.2 * m) ** 2 for m in means] for y in ys])
        total, best, mass = 0.0, (-np.inf, None), np.zeros((len(ys), 3))
        for states in itertools.product(range(3), repeat=len(ys)):
            score = start[states[0]] + emit[0, states[0]] + sum(trans[i, j] + emit[t + 1, j] for t, (i, j) in enumerate(zip(states, states[1:])))
            best = max(best, (score, states), key=lambda x: x[0])
            total += np.exp(score)
            for t, s in enumerate(states):
                mass[t, s] += np.exp(score)
        assert [got[c, t].state for t in range(len(ys))] == list(best[1])
        assert np.allclose([got[c, t].posterior for t in range(len(ys))], mass / total)
        assert abs(sum(got[c, t].scale for t in range(len(ys))) - np.log(total)) < 1e-9
    assert hmm.decode(df.where("false"), "chain", ["t"], trans, start).collect() == []


def test_hmm_ties(spark):
    """Equal densities: the largest state at the end, the smallest before each step."""
    flat = np.zeros((2, 2))
    df = spark.createDataFrame([("c", t) for t in range(4)], "chain string, t int").withColumn("emit", F.array(F.lit(0.0), F.lit(0.0)))
    assert [r.state for r in hmm.decode(df, "chain", ["t"], flat, np.zeros(2)).orderBy("t").collect()] == [0, 0, 0, 1]


def test_hmm_shared_emissions(spark):
    rows = spark.createDataFrame([("c", 0, [1.0, 2.0], 1.0), ("c", 0, [3.0, 5.0], 2.0), ("c", 1, [1.0, 1.0], 1.0)], "chain string, t int, emit array<double>, weight double")
    assert {r.t: r.emit for r in hmm.shared_emissions(rows, "chain", "t", "weight").collect()} == {0: [7.0, 12.0], 1: [1.0, 1.0]}


def test_long_chain_in_one_hot_key(spark, monkeypatch):
    """A chain with nine tenths of the rows, over many buckets, decoded as by a loop."""
    monkeypatch.setattr(ranking, "MOST", 300)
    rng = np.random.default_rng(4)
    truth = np.repeat(rng.integers(0, 3, 60), 50)
    means, trans, start = hmm.sticky([-0.5, 0.0, 0.4], 0.02)
    y = rng.normal(np.array(means)[truth], 0.2)
    rows = [("hot", t, float(v)) for t, v in enumerate(y)] + [(f"c{i}", t, 0.1) for i in range(30) for t in range(10)]
    df = spark.createDataFrame(rows, "chain string, t int, y double").withColumn("emit", hmm.gaussian("y", means, "1.0", "0.04"))
    got = [r.state for r in hmm.decode(df, "chain", ["t"], trans, start).where("chain = 'hot'").orderBy("t").collect()]
    emit = -0.5 * (y[:, None] - np.array(means)) ** 2 / 0.04
    d, back = start + emit[0], []
    for e in emit[1:]:
        s = d[:, None] + trans
        back.append(s.argmax(axis=0))
        d = s.max(axis=0) + e
    want = [int(d.argmax())]
    for b in reversed(back):
        want.append(int(b[want[-1]]))
    assert got == want[::-1] and np.mean(np.array(got) == truth) > 0.9


def test_lloyd_as_plain(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(c, 0.3, (40, 3)) for c in (0, 2, 5)])
    x[5] = [30, 30, 30]
    points = clustering.prepared(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(900, None)], "id long, vector array<double>"))
    start = np.array([x[0], x[1], x[50], [500.0, 500, 500]])  # the last one is empty at first
    centres, by = clustering.lloyd(points, start, 30)
    want, label = start.copy(), np.zeros(len(x), dtype=int)
    for _ in range(30):
        d = ((x[:, None] - want[None]) ** 2).sum(axis=2)
        new, near = d.argmin(axis=1), d.min(axis=1)
        moved, label = (new != label).any(), new
        following = want.copy()
        for c in range(4):
            if (label == c).any():
                following[c] = x[label == c].mean(axis=0)
            else:
                following[c] = x[near.argmax()]
                near[near.argmax()] = 0
        want = following
        if not moved:
            break
    assert np.allclose(centres, want)
    assert {r.id: r.cluster for r in clustering.labelled(points, by).collect()} == dict(enumerate(label.tolist()))


def test_kmeans_finds_planted_clusters(spark):
    rng = np.random.default_rng(8)
    truth = np.array([0] * 400 + [1] * 30 + [2] * 20)
    x = rng.normal(0, 0.2, (450, 4)) + np.array([[0, 0, 0, 0], [3, 3, 0, 0], [0, 3, 3, 3]])[truth]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<double>")
    found = [clustering.kmeans(d, 3, seed=5) for d in (df, df.repartition(7))]
    labels = [{r.id: r.cluster for r in f[1].collect()} for f in found]
    assert labels[0] == labels[1] and np.allclose(found[0][0], found[1][0])
    assert len({(labels[0][i], t) for i, t in enumerate(truth)}) == 3
    one = clustering.kmeans(df, 1)
    assert np.allclose(one[0], x.mean(axis=0)) and {r.cluster for r in one[1].collect()} == {0}
    assert clustering.kmeans(df.where("false"), 3)[1].collect() == []
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(9)], "id long, vector array<double>")
    assert {r.cluster for r in clustering.kmeans(same, 3)[1].collect()} == {0}


def test_select_k(spark):
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(-5, 0.5, 150), rng.normal(0, 0.5, 150), rng.normal(6, 0.5, 150)])
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "id long, value double")
    fit = clustering.select_k(df, [1, 2, 3, 4])
    assert fit["k"] == 3 and np.allclose(sorted(fit["means"]), [-5, 0, 6], atol=0.2) and abs(sum(fit["weights"]) - 1) < 1e-12
    one = clustering.mixture_fit(df, 1)
    want = (-0.5 * ((x - x.mean()) ** 2 / x.var() + np.log(2 * np.pi * x.var()))).sum()
    assert abs(one["log_likelihood"] - want) < 1e-6 and abs(one["bic"] - (2 * np.log(450) - 2 * want)) < 1e-6


def random_tree(seed, dag=False):
    random.seed(seed)
    nodes = ["r"] + [f"n{i}" for i in range(120)]
    edges = {(nodes[random.randrange(max(1, i // 3 + 1))], n) for i, n in enumerate(nodes[1:])}
    if dag:
        edges |= {(nodes[i], nodes[j]) for i, j in ((random.randrange(1, 40), random.randrange(60, 121)) for _ in range(40))}
    leaves = {n: round(random.random() ** 4, 3) for n in nodes if not any(p == n for p, _ in edges) and random.random() < 0.9}
    return nodes, sorted(edges), leaves


def simes(ps):
    return min(1.0, min(len(ps) * p / i for i, p in enumerate(sorted(ps), 1)))


@pytest.mark.parametrize("dag", [False, True])
@pytest.mark.parametrize("by", [False, True])
def test_tree_both_ways(spark, dag, by):
    nodes, edges, leaves = random_tree(3, dag)
    kids = {n: [c for p, c in edges if p == n] for n in nodes}
    want = {}

    def combined(n):
        if n not in want:
            want[n] = leaves[n] if n in leaves else simes([combined(c) for c in kids[n]]) if kids[n] else 1.0
        return want[n]

    combined("r")
    df = spark.createDataFrame([*edges, edges[0]], "parent string, child string")
    p = tree.combine_bottom_up(df, spark.createDataFrame(list(leaves.items()), "node string, p double"))
    got = {r.node: r.p for r in p.collect()}
    assert set(got) == set(nodes) and all(abs(got[n] - want[n]) < 1e-12 for n in want)
    rejected, stack = set(), [("r", 1.0)]
    while stack:
        v, gamma = stack.pop()
        fam = sorted(kids[v], key=lambda c: want[c])
        level = 0.4 * gamma / (sum(1 / i for i in range(1, len(fam) + 1)) if by and fam else 1)
        hit = [i for i, c in enumerate(fam, 1) if want[c] <= level * i / len(fam)]
        for c in fam[: max(hit, default=0)]:
            rejected.add(c)
            stack.append((c, gamma * max(hit) / len(fam)))
    assert {r.node for r in tree.descend(df, p, "r", 0.4, by).collect()} == rejected and rejected
    assert tree.descend(df, p, "nowhere", 0.4).collect() == []


def test_tree_edges(spark):
    up = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("c", "d")], "parent string, child string")
    got = {(r.node, r.ancestor): r.steps for r in tree.ancestors(up).collect()}
    assert got == {**{(n, n): 0 for n in "abcd"}, ("b", "a"): 1, ("c", "b"): 1, ("c", "a"): 1, ("d", "c"): 1, ("d", "b"): 2, ("d", "a"): 2}
    with pytest.raises(ValueError):
        tree.combine_bottom_up(spark.createDataFrame([("a", "b"), ("b", "a"), ("a", "x")], "parent string, child string"), spark.createDataFrame([("x", 0.1)], "node string, p double"))
    assert {r.node: r.p for r in tree.combine_bottom_up(up.where("false"), spark.createDataFrame([("x", 1.7), ("y", -1.0)], "node string, p double")).collect()} == {"x": 1.0, "y": 0.0}


def test_spanning_forest_and_distances(spark):
    """Kruskal and Dijkstra as the measure; a hub, ties, two components, a repeated edge."""
    import heapq

    random.seed(2)
    edges = [(0, i, float(random.randrange(1, 9))) for i in range(1, 60)] + [(random.randrange(1, 60), random.randrange(1, 60), float(random.randrange(1, 6))) for _ in range(200)]
    edges += [(100, 101, 1.0), (101, 102, 2.0), (100, 102, 2.0), (101, 100, 3.0), (5, 5, 0.0)]
    df = spark.createDataFrame([*edges, (None, 3, 1.0), (3, 4, None)], "u long, v long, w double")
    least = {}
    for u, v, w in edges:
        if u != v:
            least[min(u, v), max(u, v)] = min(w, least.get((min(u, v), max(u, v)), w))
    up = {n: n for e in least for n in e}

    def root(n):
        while up[n] != n:
            n = up[n]
        return n

    want = []
    for w, u, v in sorted((w, u, v) for (u, v), w in least.items()):
        if root(u) != root(v):
            up[root(u)] = root(v)
            want.append((u, v, w))
    assert sorted(map(tuple, paths.spanning_forest(df).collect())) == sorted(want)
    assert paths.spanning_forest(df.where("false")).collect() == []
    near = {n: [] for n in up}
    for (u, v), w in least.items():
        near[u].append((v, w))
        near[v].append((u, w))
    far, heap = {}, [(0.0, 7)]
    while heap:
        d, n = heapq.heappop(heap)
        if n not in far:
            far[n] = d
            for m, w in near[n]:
                heapq.heappush(heap, (d + w, m))
    got = {r.node: r.distance for r in paths.distances(df.where("u <> v"), spark.createDataFrame([(7,)], "node long")).collect()}
    assert got == far


def test_spanning_forest_keeps_one_edge_between_components(spark, monkeypatch):
    """A complete graph of six scales: from the second round on one open edge is left for two components."""
    kept, open_ = paths.materialize, []

    def counted(df, name):
        out = kept(df, name)
        open_.extend([out.count()] if name == "edges" else [])
        return out

    monkeypatch.setattr(paths, "materialize", counted)
    edges = [(i, j, float((i ^ j).bit_length())) for i in range(64) for j in range(i + 1, 64)]
    got = paths.spanning_forest(spark.createDataFrame(edges, "u long, v long, w double")).collect()
    assert open_ == [2016, 1984, 120, 28, 6, 1, 0]
    assert sorted((r.u, r.v, r.w) for r in got) == sorted((i, i + (1 << k), k + 1.0) for k in range(6) for i in range(0, 64, 2 << k))


def test_pseudotime_on_a_line(spark):
    centres = np.array([[0.0, 0], [1, 0], [2, 0], [2, 1]])
    points = spark.createDataFrame([(0, [-1.0, 0.3]), (1, [0.5, 0.2]), (2, [1.5, -0.1]), (3, [2.1, 0.75]), (4, [2.0, 5.0])], "id long, vector array<double>")
    got = {r.id: r.pseudotime for r in paths.pseudotime(points, centres, 0).collect()}
    assert all(abs(got[i] - w) < 1e-12 for i, w in {0: 0.0, 1: 0.5, 2: 1.5, 3: 2.75, 4: 3.0}.items())


def test_hmm_buckets_are_bounded(spark, monkeypatch):
    """A long chain fills many buckets of few rows, with the path and posteriors of one."""
    from lattica.operators import hmm

    rows = spark.range(3000).selectExpr("0 AS chain", "id AS at", "double(id % 37 > 18) + (id * 7919 % 11) / 20 AS v")
    means, trans, start = hmm.sticky([0.0, 1.0], 0.05, 0)
    emit = rows.select("chain", "at", hmm.gaussian("v", means).alias("emit"))
    whole = {r.at: (r.state, r.posterior) for r in hmm.decode(emit, "chain", ["at"], trans, start).collect()}
    monkeypatch.setattr(hmm, "BUCKET", 100)
    seen, dealt = [], hmm.ranged
    monkeypatch.setattr(hmm, "ranged", lambda *a, **k: seen.append(dealt(*a, **k)) or seen[-1])
    monkeypatch.setattr(hmm, "forget", lambda df: None)
    got = {r.at: (r.state, r.posterior) for r in hmm.decode(emit, "chain", ["at"], trans, start).collect()}
    assert max(r["count"] for r in seen[0].groupBy("__bucket").count().collect()) < 400
    assert len(got) == 3000 and all(got[i][0] == whole[i][0] and abs(got[i][1][0] - whole[i][1][0]) < 1e-9 for i in range(3000))
