"""Gamma-Poisson means of samples adjusted for batches, from observed, imputed and residual sums.

Per feature and sample, coordinate descent alternates between the adjusted mean, which explains
observed and imputed counts, and the share of the imputed ones; every update is a ratio of
sums, so a feature's descent is one expression over its row and rows never meet. Batch
effects divide what a batch holds by what the adjusted means expect of it. Pairs of a
feature and a sample without counts need no row: what they expect depends on the sample
alone, so it is summed once for each batch and corrected where there are counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalog import register
from ..matrix import table
from ..plans.scratch import materialize
from .gene_index import _S, matched_statistics


def _descent(observed: Column, imputed: Column, residual: Column, size: Column, a0: float, b0: float, rounds: int) -> Column:
    """struct(mu, gamma, resid, a, b): the means after so many rounds, and the adjusted mean's shape and rate."""
    resid = (residual + a0) / (size + b0)
    start = F.struct(F.lit(0.0).alias("mu"), F.lit(0.0).alias("gamma"), F.lit(b0).alias("rate"))

    def update(state: Column, _: Column) -> Column:
        rate = (resid + state["gamma"]) * size + b0
        mu = (observed + imputed + a0) / rate
        return F.struct(mu.alias("mu"), ((imputed + a0) / (mu * size + b0)).alias("gamma"), rate.alias("rate"))

    done = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, update)
    return F.struct(done["mu"].alias("mu"), done["gamma"].alias("gamma"), resid.alias("resid"), (observed + imputed + a0).alias("a"), done["rate"].alias("b"))


def adjusted_means(stats: DataFrame, sizes: DataFrame, a0: float = 1.0, b0: float = 1.0, rounds: int = 100) -> DataFrame:
    """(row_id, sample, mu_observed, mu_adjusted, sd_adjusted, mu_residual, gamma): posterior means under Gamma(a0, b0) priors, and the adjusted mean's deviation.

    stats: (row_id, sample, observed, imputed, residual), the rows with counts; sizes: (sample, size), one row a sample, few.
    Without observed counts mu_observed is 0, without imputed ones gamma is; the means of pairs without a row are those of the prior.
    """
    none = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    x = stats.join(F.broadcast(sizes.select("sample", F.col("size").cast("double").alias("size"))), "sample")
    x = x.withColumn("d", _descent(none("observed"), none("imputed"), none("residual"), F.col("size"), a0, b0, rounds))
    observed = F.when(none("observed") > 0, (none("observed") + a0) / (F.col("size") + b0)).otherwise(0.0)
    return x.select("row_id", "sample", observed.alias("mu_observed"), F.col("d.mu").alias("mu_adjusted"), (F.sqrt("d.a") / F.col("d.b")).alias("sd_adjusted"), F.col("d.resid").alias("mu_residual"), F.when(none("imputed") > 0, F.col("d.gamma")).otherwise(0.0).alias("gamma"))


def batch_effects(means: DataFrame, batches: DataFrame, counts: DataFrame, sizes: DataFrame, a0: float = 1.0, b0: float = 1.0, rounds: int = 100) -> DataFrame:
    """(row_id, batch, delta): the posterior mean of what a batch holds of a feature over what the adjusted means expect.

    means: adjusted_means(); batches: (row_id, batch, observed); counts: (batch, sample, n), how many columns of a sample lie in a
    batch; sizes: (sample, size). Every feature of means has a row for every batch of counts.
    """
    zero = F.lit(0.0)
    prior = sizes.select("sample", _descent(zero, zero, zero, F.col("size").cast("double"), a0, b0, rounds)["mu"].alias("mu0"))
    known = materialize(counts.join(prior, "sample").select("batch", "sample", "n", "mu0"), "expected")  # batches by samples
    base = known.groupBy("batch").agg(F.sum(F.col("n") * F.col("mu0")).alias("base"))
    more = means.join(F.broadcast(known), "sample").groupBy("row_id", "batch").agg(F.sum(F.col("n") * (F.col("mu_adjusted") - F.col("mu0"))).alias("more"))
    rows = means.select("row_id").distinct().withColumn("batch", F.explode(F.lit([r.batch for r in base.select("batch").orderBy("batch").collect()] or None).cast(f"array<{dict(counts.dtypes)['batch']}>")))
    found = rows.join(F.broadcast(base), "batch").join(more, ["row_id", "batch"], "left").join(batches, ["row_id", "batch"], "left")
    expected = F.col("base") + F.coalesce("more", zero)
    return found.select("row_id", "batch", ((F.coalesce(F.col("observed").cast("double"), zero) + a0) / (expected + b0)).alias("delta"))


def _bound(spark, d) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    l = table(spark, d, "lineitem")
    cells = l.groupBy(F.col("l_suppkey").alias("row_id"), F.col("l_partkey").alias("col_id")).agg(F.sum("l_quantity").cast("double").alias("val"))
    near = l.where("l_partkey <> l_orderkey % 40").groupBy(F.col("l_partkey").alias("query"), (F.col("l_orderkey") % 40).alias("id")).agg((F.min("l_discount") * 10.0).alias("distance"))
    groups = table(spark, d, "part").select(F.col("p_partkey").alias("col_id"), (F.col("p_size") % 3).alias("sample"), (F.col("p_partkey") % 2).alias("batch"))
    held = cells.join(groups, "col_id")
    observed = held.groupBy("row_id", "sample").agg(F.sum("val").alias("observed"))
    stats = matched_statistics(cells, groups.select("col_id", "sample"), near).join(observed, ["row_id", "sample"], "full")
    sizes = groups.groupBy("sample").agg(F.count("*").alias("size"))
    return stats, sizes, held.groupBy("row_id", "batch").agg(F.sum("val").alias("observed")), groups.groupBy("batch", "sample").agg(F.count("*").alias("n"))


_ROUNDS = 20
_FIT = f"""{_S}, gb AS (SELECT p_partkey AS col_id, p_size % 3 AS sample, p_partkey % 2 AS batch FROM part), sz AS (SELECT sample, count(*)::DOUBLE AS size FROM gb GROUP BY 1),
ms AS (SELECT row_id, sample, sum(coalesce(hat, 0)) AS imputed, sum(coalesce(CASE WHEN hat > 0 THEN val / (hat * scale) ELSE val END, 0)) AS residual FROM b JOIN g USING (col_id) LEFT JOIN t USING (col_id) GROUP BY ALL),
ob AS (SELECT row_id, sample, sum(val) AS observed FROM x JOIN gb USING (col_id) GROUP BY ALL),
st AS MATERIALIZED (SELECT row_id, sample, coalesce(observed, 0) AS observed, coalesce(imputed, 0) AS imputed, coalesce(residual, 0) AS residual FROM (SELECT coalesce(ms.row_id, ob.row_id) AS row_id, coalesce(ms.sample, ob.sample) AS sample, observed, imputed, residual FROM ms FULL JOIN ob ON ob.row_id = ms.row_id AND ob.sample = ms.sample)),
st0 AS (SELECT row_id, sample, observed, imputed, residual FROM st UNION ALL SELECT NULL, sample, 0, 0, 0 FROM sz),
it AS (SELECT row_id, sample, observed, imputed, (residual + 1) / (size + 1) AS resid, size, 0.0::DOUBLE AS mu, 0.0::DOUBLE AS gamma, 0 AS k FROM st0 JOIN sz USING (sample)
  UNION ALL SELECT row_id, sample, observed, imputed, resid, size, (observed + imputed + 1) / ((resid + gamma) * size + 1), (imputed + 1) / ((observed + imputed + 1) / ((resid + gamma) * size + 1) * size + 1), k + 1 FROM it WHERE k < {_ROUNDS}),
f AS MATERIALIZED (SELECT * FROM it WHERE k = {_ROUNDS})"""


@register("adjusted_means", f"WITH RECURSIVE {_FIT} SELECT row_id, sample, round(CASE WHEN observed > 0 THEN (observed + 1) / (size + 1) ELSE 0 END, 6) AS mu_observed, round(mu, 6) AS mu_adjusted, round(resid, 6) AS mu_residual, round(CASE WHEN imputed > 0 THEN gamma ELSE 0 END, 6) AS gamma FROM f WHERE row_id IS NOT NULL")
def _means(spark, d):
    stats, sizes, *_ = _bound(spark, d)
    return adjusted_means(stats, sizes, rounds=_ROUNDS).select("row_id", "sample", *(F.round(c, 6).alias(c) for c in ("mu_observed", "mu_adjusted", "mu_residual", "gamma")))


@register("batch_effects", f"""WITH RECURSIVE {_FIT}, nb AS (SELECT batch, sample, count(*) AS n FROM gb GROUP BY ALL), r AS (SELECT DISTINCT row_id FROM st),
e AS (SELECT r.row_id, nb.batch, sum(n * coalesce(f.mu, z.mu)) AS expected FROM r CROSS JOIN nb JOIN f z ON z.row_id IS NULL AND z.sample = nb.sample LEFT JOIN f ON f.row_id = r.row_id AND f.sample = nb.sample GROUP BY ALL),
o AS (SELECT row_id, batch, sum(val) AS observed FROM x JOIN gb USING (col_id) GROUP BY ALL) SELECT e.row_id, e.batch, round((coalesce(observed, 0) + 1) / (expected + 1), 6) AS delta FROM e LEFT JOIN o ON o.row_id = e.row_id AND o.batch = e.batch""")
def _effects(spark, d):
    stats, sizes, batches, counts = _bound(spark, d)
    means = materialize(adjusted_means(stats, sizes, rounds=_ROUNDS), "means")
    return batch_effects(means, batches, counts, sizes, rounds=_ROUNDS).select("row_id", "batch", F.round("delta", 6).alias("delta"))
