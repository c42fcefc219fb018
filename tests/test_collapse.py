"""Gamma-Poisson means and batch effects against the dense fit."""

import numpy as np

from lattica.operators import collapse


def test_means_and_effects_as_dense(spark):
    rng = np.random.default_rng(3)
    g, s, b = 12, 4, 3
    observed, imputed, residual = (np.where(rng.random((g, s)) < 0.5, rng.integers(1, 60, (g, s)), 0).astype(float) for _ in range(3))
    observed[0] = imputed[0] = residual[0] = 0
    size, n = rng.integers(3, 30, s).astype(float), rng.integers(0, 9, (b, s)).astype(float)
    batch = np.where(rng.random((g, b)) < 0.7, rng.integers(1, 90, (g, b)), 0).astype(float)
    a0, b0 = 0.5, 2.0
    resid, gamma = (residual + a0) / (size + b0), np.zeros((g, s))
    for _ in range(30):
        rate = (resid + gamma) * size + b0
        mu = (observed + imputed + a0) / rate
        gamma = (imputed + a0) / (mu * size + b0)
    delta = (batch + a0) / (mu @ n.T + b0)
    rows = [(i, j, float(observed[i, j]) or None, float(imputed[i, j]) or None, float(residual[i, j]) or None) for i in range(g) for j in range(s) if observed[i, j] or imputed[i, j] or residual[i, j]]
    stats = spark.createDataFrame(rows, "row_id long, sample int, observed double, imputed double, residual double")
    sizes = spark.createDataFrame([(j, float(x)) for j, x in enumerate(size)], "sample int, size double")
    means = collapse.adjusted_means(stats, sizes, a0, b0, 30)
    got = {(r.row_id, r.sample): r for r in means.collect()}
    assert set(got) == {r[:2] for r in rows}
    for (i, j), r in got.items():
        want = ((observed[i, j] + a0) / (size[j] + b0) if observed[i, j] else 0, mu[i, j], np.sqrt(observed[i, j] + imputed[i, j] + a0) / rate[i, j], resid[i, j], gamma[i, j] if imputed[i, j] else 0)
        assert np.allclose([r.mu_observed, r.mu_adjusted, r.sd_adjusted, r.mu_residual, r.gamma], want)
    batches = spark.createDataFrame([(i, k, float(batch[i, k])) for i in range(g) for k in range(b) if batch[i, k]], "row_id long, batch int, observed double")
    counts = spark.createDataFrame([(k, j, float(n[k, j])) for k in range(b) for j in range(s)], "batch int, sample int, n double")
    found = {(r.row_id, r.batch): r.delta for r in collapse.batch_effects(means, batches, counts, sizes, a0, b0, 30).collect()}
    assert set(found) == {(i, k) for i in {r[0] for r in rows} for k in range(b)} and 0 not in {i for i, _ in found}
    assert all(np.isclose(v, delta[i, k]) for (i, k), v in found.items())


def test_nothing_to_collapse(spark):
    stats = spark.createDataFrame([], "row_id long, sample int, observed double, imputed double, residual double")
    sizes = spark.createDataFrame([(0, 2.0)], "sample int, size double")
    means = collapse.adjusted_means(stats, sizes)
    assert means.collect() == []
    counts = spark.createDataFrame([(0, 0, 1.0)], "batch int, sample int, n double")
    assert collapse.batch_effects(means, spark.createDataFrame([], "row_id long, batch int, observed double"), counts, sizes).collect() == []
    assert collapse.batch_effects(means, spark.createDataFrame([], "row_id long, batch int, observed double"), counts.where("false"), sizes).collect() == []
