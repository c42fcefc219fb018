"""Tails against plain sums, and cases at the borders."""

from math import comb, erfc, exp, inf, isclose, lgamma, sqrt

from pyspark.sql import functions as F

from lattica.operators import evidence


def test_two_sided_p(spark):
    zs = [0.0, 0.3, -1.0, 1.96, 2.82, 2.84, -5.0, 8.0, 20.0]
    found = spark.createDataFrame([(z,) for z in zs] + [(None,)], "z double").select("z", evidence.two_sided_p(F.col("z")).alias("p")).collect()
    assert all(r.p is None if r.z is None else isclose(r.p, erfc(abs(r.z) / sqrt(2)), rel_tol=1e-9) for r in found)


def test_beta_binomial(spark):
    cases = [(k, n) for n in (0, 1, 7, 60) for k in (0, 1, 5, 7, 60, 61)]
    df = spark.createDataFrame(cases, "k long, n long")

    def want(k, n, rate, rho):
        if n == 0 or k == 0:
            return 1.0
        if rho <= 0:
            return sum(comb(n, i) * rate**i * (1 - rate) ** (n - i) for i in range(k, n + 1))
        a, b = rate * (1 - rho) / rho, (1 - rate) * (1 - rho) / rho
        beta = lambda x, y: lgamma(x) + lgamma(y) - lgamma(x + y)
        return sum(comb(n, i) * exp(beta(i + a, n - i + b) - beta(a, b)) for i in range(k, n + 1))

    for rate, rho in ((0.01, 0.0), (0.3, 0.2), (0.05, 0.02)):
        for r in df.select("k", "n", evidence.beta_binomial_greater(F.col("k"), F.col("n"), rate, rho).alias("p")).collect():
            assert isclose(r.p, want(r.k, r.n, rate, rho), rel_tol=1e-8), (r, rate, rho)


def test_log_odds_of_empty_products(spark):
    df = spark.createDataFrame([(0, 0, 0, 0), (0, 1, 1, 1), (1, 0, 1, 1), (3, 2, 3, 2)], "a long, b long, c long, d long")
    assert [r[0] for r in df.select(evidence.log_odds_ratio(*map(F.col, "abcd"))).collect()] == [0.0, -inf, inf, 0.0]


def test_permuted_within_batches(spark):
    df = spark.createDataFrame([(i, "b" if i % 3 else "a") for i in range(60)], "id int, batch string")
    rows = evidence.permuted_within(df, "batch", "id", 1).collect()
    for b in "ab":
        ids = sorted(r.id for r in rows if r.batch == b)
        assert ids == sorted(r.drawn for r in rows if r.batch == b) and any(r.id != r.drawn for r in rows if r.batch == b)
    assert evidence.permuted_within(df.limit(0), "batch", "id", 1).count() == 0


def test_intercept_without_variation(spark):
    df = spark.createDataFrame([("t", 2.0, 0.1), ("t", 2.0, 0.3)], "trait string, x double, y double")
    assert evidence.score_intercepts(df, "trait", "x", "y").first()[1:] == (1.0, 0.0)


def test_agreed_with_a_set_not_given(spark):
    ids = spark.range(3)
    assert evidence.agreed(None, None, ["id"]) is None
    assert evidence.agreed(ids.union(ids), None, ["id"]).count() == 3 and evidence.agreed(ids, spark.range(2, 9), ["id"]).collect()[0].id == 2
