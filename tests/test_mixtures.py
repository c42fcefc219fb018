"""Weights by EM and the choice of sites against plain loops and planted sites."""

import math

import numpy as np

from lattica.operators import mixtures as mx


def plain_em(logs, counts, n):
    k, before = len(logs[0]), None
    w = [1 / k] * k
    for turn in range(1, 41):
        rows = [[math.exp(v) * x for v, x in zip(row, w)] for row in logs]
        total = sum(c * math.log(sum(r)) for c, r in zip(counts, rows))
        if turn > 1 and (abs(total - before) < 1e-4 or turn == 40):
            break
        before = total
        w = [sum(c * r[j] / sum(r) for c, r in zip(counts, rows)) / sum(counts) for j in range(k)]
        w = [w[0]] + [x if x >= 0.01 else 0.0 for x in w[1:]]
        w = [x / sum(w) for x in w]
    return w, total, -2 * total + (k - 1) * math.log(n)


def test_weights_as_plain():
    rng = np.random.default_rng(0)
    for k in (1, 2, 5):
        logs, counts = rng.normal(-3, 1, (60, k + 1)), rng.integers(1, 9, 60).astype(float)
        logs[:, -1] -= 6  # a component that goes
        w, total, bic = mx.fit_weights(logs, counts, 77.0)
        want = plain_em(logs.tolist(), counts.tolist(), 77.0)
        assert np.allclose(w, want[0]) and abs(total - want[1]) < 1e-9 and abs(bic - want[2]) < 1e-9
    assert mx.fit_weights(np.array([[0.0, -np.inf]]), np.array([1.0]), 1.0)[0].tolist() == [1.0, 0.0]


def items_of(rng, places, shares, candidates, n=600, spread=10.0, length=1000.0):
    x = np.where(rng.random(n) < 0.1, rng.uniform(0, length, n), rng.normal(rng.choice(places, n, p=shares), spread)).round()
    pos, counts = np.unique(x, return_counts=True)
    logs = -0.5 * ((pos[:, None] - np.array(candidates)) / spread) ** 2 - math.log(spread * math.sqrt(2 * math.pi))
    return [(int(c), -math.log(length), row.tolist()) for c, row in zip(counts, logs)]


def test_planted_sites(spark, monkeypatch):
    monkeypatch.setattr(mx, "TASK_BYTES", 20_000)
    rng = np.random.default_rng(4)
    genes = {"two": ([200, 700], [0.6, 0.4], [200, 700, 450, 205, 900, 50]), "one": ([500], [1.0], [500, 510, 100]), "lone": ([300], [1.0], [300]), "close": ([400, 408], [0.5, 0.5], [400, 408, 900])}
    genes |= {f"g{i}": ([100 + i], [1.0], [100 + i, 800]) for i in range(20)}
    rows = [(g, *item) for g, (p, s, c) in genes.items() for item in items_of(rng, p, s, c)]
    rows += [rows[0]] * 3 + [("none", 1, -6.9, []), ("zero", 0, -6.9, [1.0])]
    items = spark.createDataFrame(rows, "gene string, n long, noise double, sites array<double>")
    places = spark.createDataFrame([(g, [float(x) for x in c], [10.0] * len(c)) for g, (_, _, c) in genes.items()] + [("none", [], []), ("zero", [1.0], [1.0]), ("missing", [1.0], [1.0])], "gene string, places array<double>, spreads array<double>")
    got = {}
    for r in mx.select_sites(items, places).collect():
        got.setdefault(r.gene, {})[r.place] = r.weight
    assert set(got) == set(genes)
    assert set(got["two"]) == {200.0, 700.0} and abs(got["two"][200.0] - 0.54) < 0.06
    assert all(set(got[g]) == {float(p[0])} for g, (p, _, c) in genes.items() if g not in ("two", "close"))
    assert len(got["close"]) == 1  # nearer than two spreads
    assert mx.select_sites(items.where("false"), places).collect() == []


def test_choice_stops_after_two_worse():
    rng = np.random.default_rng(1)
    x = rng.normal(0, 1, 300)
    logs = np.column_stack([-0.5 * (x - p) ** 2 - 0.92 for p in (0.0, 40.0, 50.0, 60.0, 0.1)])
    chosen, weights, _, bic = mx.choose(np.full(300, -5.0), logs, np.ones(300), np.array([0.0, 40, 50, 60, 0.1]), np.ones(5))
    assert chosen == [0] and bic == mx.fit_weights(np.column_stack([np.full(300, -5.0), logs[:, :1]]), np.ones(300), 300.0)[2]


def test_sites_by_density_as_by_arrays(spark, monkeypatch):
    """F16: positions with a density give what arrays of its values give, and no array of values is shuffled."""
    monkeypatch.setattr(mx, "TASK_BYTES", 2_000)
    rng = np.random.default_rng(7)
    density = lambda pos, places, spreads: -0.5 * ((pos[:, None] - places) / spreads) ** 2 - np.log(spreads * np.sqrt(2 * np.pi))
    places = {g: sorted(rng.choice(1000, 1 + g % 4, replace=False).astype(float).tolist()) for g in range(12)}
    rows = [(g, int(n), -6.9, int(x)) for g in range(13) for x, n in zip(rng.integers(0, 1000, 80), rng.integers(0, 5, 80))]
    known = spark.createDataFrame([(g, p, [15.0] * len(p)) for g, p in places.items()], "gene long, places array<double>, spreads array<double>")
    by_pos = mx.select_sites(spark.createDataFrame(rows, "gene long, n long, noise double, pos long"), known, density=density)
    arrays = [(g, n, noise, density(np.array([x]), np.array(places.get(g, [1.0])), 15.0)[0].tolist()) for g, n, noise, x in rows]
    by_array = mx.select_sites(spark.createDataFrame(arrays, "gene long, n long, noise double, sites array<double>"), known)
    a, b = (sorted(map(tuple, df.collect())) for df in (by_pos, by_array))
    assert len(a) and [r[:3] for r in a] == [r[:3] for r in b] and np.allclose([r[3:] for r in a], [r[3:] for r in b])


def test_weights_when_an_item_loses_its_component():
    logs = np.array([[-2000.0, -1.0, -900.0], [-1.0, -3000.0, -2.0]])
    w, total, _ = mx.fit_weights(logs, np.array([1.0, 500.0]), 501.0)
    assert w[1] == 0 and np.isfinite(total) and abs(w.sum() - 1) < 1e-12
