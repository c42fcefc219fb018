"""Calls beyond the knee against a plain version of the same draws."""

import numpy as np
from pyspark.sql import functions as F

from lattica.operators import droplets


def test_good_turing():
    rng = np.random.default_rng(0)
    truth = rng.dirichlet(np.full(400, 0.3))
    seen = rng.multinomial(3000, truth)
    counts, sizes = np.unique(seen[seen > 0], return_counts=True)
    unseen = int((seen == 0).sum())
    p = droplets.good_turing(counts, sizes, unseen)
    assert (p > 0).all() and abs((p * np.concatenate([[unseen], sizes])).sum() - 1) < 1e-12
    assert abs(p[0] * unseen - sizes[0] / seen.sum()) < 1e-9 and (np.diff(p) > 0).all()
    assert p[-1] < counts[-1] / seen.sum() * 1.01  # large counts hardly move
    # No line through one class: one is added to each count.
    assert np.allclose(droplets.good_turing(np.array([4]), np.array([3]), 2), [1 / 17, 5 / 17])
    assert np.allclose(droplets.good_turing(np.array([]), np.array([]), 5), [0.2])


def planted(seed=3):
    """400 empty columns of one profile, 20 large ones, 25 small ones of another profile."""
    rng = np.random.default_rng(seed)
    soup, real = rng.dirichlet(np.full(80, 1.0)), rng.dirichlet(np.full(80, 0.2))
    rows = [rng.multinomial(rng.integers(5, 40), soup) for _ in range(300)] + [rng.multinomial(rng.integers(60, 120), soup) for _ in range(100)]
    rows += [rng.multinomial(2000, real) for _ in range(20)] + [rng.multinomial(rng.integers(60, 120), real) for _ in range(25)]
    return np.array(rows)


def test_empty_drops_as_plain(spark, monkeypatch):
    monkeypatch.setattr(droplets, "TOTALS", 7)
    monkeypatch.setattr(droplets, "COLUMNS", 5)
    x = planted()
    cells = [(int(g), int(c), float(x[c, g])) for c, g in zip(*np.nonzero(x))]
    got = droplets.empty_drops(spark.createDataFrame(cells, "row_id long, col_id long, val double"), 90, 20, 0.99, 0.1, (150, 400), 50, 300, 0.05, 9)  # 300 draws reach q values of 0.017 here
    got = {r.col_id: r for r in got.collect()}
    tot = x.sum(axis=1)
    cut = max(1, round(0.1 * np.sort(tot)[::-1][0]))
    assert {c for c, r in got.items() if r.p is None} == set(np.flatnonzero(tot >= cut).tolist())
    order = sorted(range(len(tot)), key=lambda c: (-tot[c], c))
    ambient = x[order[150:400]].sum(axis=0)
    counts, sizes = np.unique(ambient[ambient > 0], return_counts=True)
    unseen = 90 - int(sizes.sum())
    p = droplets.good_turing(counts, sizes, unseen)
    log_p = np.log(p[[0 if a == 0 else int(np.flatnonzero(counts == a)[0]) + 1 for a in ambient]])
    asked = [c for c in range(len(tot)) if 50 <= tot[c] < cut]
    totals = np.unique(tot[asked])
    null = np.stack([droplets.path(9, i, p, np.concatenate([[unseen], sizes]), totals) for i in range(300)])
    pv = {c: (1 + (null[:, np.searchsorted(totals, tot[c])] <= x[c] @ log_p).sum()) / 301 for c in asked}
    m, low, want = len(pv), 1.0, {}
    for rank, c in sorted(enumerate(sorted(pv, key=lambda c: (pv[c], c)), 1), reverse=True):
        low = min(low, pv[c] * m / rank)
        want[c] = low
    rescued = {c for c, r in got.items() if r.p is not None}
    assert rescued == {c for c in want if want[c] < 0.05}
    assert all(abs(got[c].p - pv[c]) < 1e-12 and abs(got[c].q - want[c]) < 1e-12 for c in rescued)
    assert len(rescued & set(range(420, 445))) >= 20 and len(rescued - set(range(420, 445))) <= 2


def test_nothing_ambient(spark):
    cells = spark.createDataFrame([(0, 0, 50.0), (1, 1, 3.0)], "row_id long, col_id long, val double")
    assert [(r.col_id, r.p) for r in droplets.empty_drops(cells, 5, 10).collect()] == [(0, None)]
    assert droplets.empty_drops(cells.where(F.lit(False)), 5, 10).collect() == []
