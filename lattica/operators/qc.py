"""Quality control of columns and rows: robust bands, cutoffs, calls, type filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalog import register
from ..matrix import X, part_by_order, table
from ..plans.ranking import ranged, running
from .stats import column_stats


def upper_median(df: DataFrame, value: str) -> DataFrame:
    """One row (m): the element at position n div 2 from 0, without interpolation; only finite values count. Equal values are counted first, so many of one value fill no task."""
    finite = df.where(F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))).groupBy(value).agg(F.count("*").alias("__n"))
    total = {"__all": ("sum", F.col("__n"))}
    placed = running(ranged(finite, value), [], [value], {"__to": ("sum", F.col("__n"))}, total)
    middle = F.floor(F.col("__all") / 2) + 1
    return placed.where((F.col("__to") >= middle) & (F.col("__to") - F.col("__n") < middle)).select(F.col(value).alias("m"))


def robust_keep(df: DataFrame, value: str, k: float, tail: str = "both") -> DataFrame:
    """df with keep: within k * 1.4826 * MAD of the upper median on the asked side(s); values that are not finite go."""
    m = upper_median(df, value).first()
    mad = upper_median(df.select(F.abs(F.col(value) - m.m).alias(value)), value).first() if m else None
    if m is None:
        return df.withColumn("keep", F.lit(False))
    width = k * 1.4826 * mad.m
    good = F.lit(True)
    if tail in ("lower", "both"):
        good &= F.col(value) >= m.m - width
    if tail in ("upper", "both"):
        good &= F.col(value) <= m.m + width
    return df.withColumn("keep", F.coalesce(good & ~F.isnan(value) & (F.abs(value) < float("inf")), F.lit(False)))


@register("qc_robust_keep", f"""WITH {X}, t AS (SELECT o_orderkey AS col_id, coalesce(sum(val), 0) AS tot FROM orders LEFT JOIN x ON col_id = o_orderkey GROUP BY 1),
m AS (SELECT list(tot ORDER BY tot)[count(*) // 2 + 1] AS m FROM t), a AS (SELECT list(abs(tot - m) ORDER BY abs(tot - m))[count(*) // 2 + 1] AS mad FROM t CROSS JOIN m)
SELECT col_id, tot, (tot >= m - 2 * 1.4826 * mad AND tot <= m + 2 * 1.4826 * mad) AS keep FROM t CROSS JOIN m CROSS JOIN a""")
def _robust(spark, d):
    return robust_keep(column_stats(part_by_order(spark, d)).select("col_id", "tot"), "tot", 2.0)


def call_columns_ordmag(stats: DataFrame, expected: int, q: float = 0.99, fraction: float = 0.1) -> DataFrame:
    """Columns whose total reaches max(1, round(fraction * baseline)); the baseline is the total at descending rank floor(expected * (1 - q))."""
    rank = int(expected * (1 - q))
    at = stats.orderBy(F.desc("tot"), "col_id").limit(rank + 1).agg(F.min("tot").alias("baseline"))
    cut = F.greatest(F.lit(1.0), F.round(F.lit(fraction) * F.col("baseline")))
    return stats.join(F.broadcast(at)).where(F.col("tot") >= cut).select("col_id", "tot")


@register("qc_call_ordmag", f"""WITH {X}, t AS (SELECT col_id, sum(val) AS tot FROM x GROUP BY 1), b AS (SELECT min(tot) AS b FROM (SELECT tot FROM t ORDER BY tot DESC, col_id LIMIT 31))
SELECT col_id, tot FROM t CROSS JOIN b WHERE tot >= greatest(1, round(0.5 * b))""")
def _ordmag(spark, d):
    return call_columns_ordmag(column_stats(part_by_order(spark, d)).where("tot > 0"), 3000, 0.99, 0.5)


def nnz_cutoff(counts: DataFrame, value: str) -> DataFrame:
    """One row (cutoff): the least value of the upper cluster of an exact two-means split of ln(1 + value), or null if one Gaussian is no worse by BIC, or below four or equal values.

    Equal values are summed first, so the scan runs over distinct counts.
    """
    from pyspark.sql import Window

    x = counts.select(F.col(value).cast("double").alias("v")).groupBy("v").agg(F.count("*").cast("double").alias("w")).withColumn("x", F.log1p("v"))
    w = Window.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    s = x.withColumns({"n1": F.sum("w").over(w), "s1": F.sum(F.col("w") * F.col("x")).over(w), "q1": F.sum(F.col("w") * F.col("x") * F.col("x")).over(w), "up": F.lead("v").over(Window.orderBy("v"))})
    t = x.agg(F.sum("w").alias("n"), F.sum(F.col("w") * F.col("x")).alias("s"), F.sum(F.col("w") * F.col("x") * F.col("x")).alias("q"))
    s = s.join(F.broadcast(t)).where("up IS NOT NULL").withColumn("sse", F.expr("q1 - s1 * s1 / n1 + (q - q1) - (s - s1) * (s - s1) / (n - n1)"))
    best = s.orderBy(F.round("sse", 9), "v").limit(1)
    # Shared variance: 2 means, 1 variance and 1 weight against 1 mean and 1 variance.
    one, two = "n * ln(greatest(q - s * s / n, 1e-12) / n) + 2 * ln(n)", "n * ln(greatest(sse, 1e-12) / n) - 2 * (n1 * ln(n1 / n) + (n - n1) * ln((n - n1) / n)) + 4 * ln(n)"
    return best.selectExpr(f"CASE WHEN n >= 4 AND {two} < {one} THEN up END AS cutoff")


@register("qc_nnz_cutoff", f"""WITH {X}, c AS (SELECT row_id, count(*) FILTER (val > 0)::DOUBLE AS v FROM x GROUP BY 1), x1 AS (SELECT v, count(*)::DOUBLE AS w, ln(1 + v) AS x FROM (SELECT v FROM c UNION ALL SELECT v * 20 FROM c WHERE row_id % 3 = 0) GROUP BY v),
s AS (SELECT v, sum(w) OVER o AS n1, sum(w * x) OVER o AS s1, sum(w * x * x) OVER o AS q1, lead(v) OVER (ORDER BY v) AS up FROM x1 WINDOW o AS (ORDER BY v ROWS UNBOUNDED PRECEDING)),
t AS (SELECT sum(w) AS n, sum(w * x) AS s, sum(w * x * x) AS q FROM x1),
b AS (SELECT *, q1 - s1 * s1 / n1 + (q - q1) - (s - s1) * (s - s1) / (n - n1) AS sse FROM s CROSS JOIN t WHERE up IS NOT NULL ORDER BY round(q1 - s1 * s1 / n1 + (q - q1) - (s - s1) * (s - s1) / (n - n1), 9), v LIMIT 1)
SELECT CASE WHEN n >= 4 AND n * ln(greatest(sse, 1e-12) / n) - 2 * (n1 * ln(n1 / n) + (n - n1) * ln((n - n1) / n)) + 4 * ln(n) < n * ln(greatest(q - s * s / n, 1e-12) / n) + 2 * ln(n) THEN up END AS cutoff FROM b""")
def _cutoff(spark, d):
    c = part_by_order(spark, d).cells.groupBy("row_id").agg(F.count_if(F.col("val") > 0).alias("v"))
    return nnz_cutoff(c.select("v").unionAll(c.where("row_id % 3 = 0").select(F.col("v") * 20)), "v")


def rows_by_type(name: Column, select: str = "", remove: str = "") -> Column:
    """Whether a type passes comma lists of substrings, letter case ignored; an empty selection takes all, and removal wins."""
    parts = lambda s: [p.strip().lower() for p in s.split(",") if p.strip()]
    has = lambda ps: F.greatest(F.lit(False), *(F.contains(F.lower(name), F.lit(p)) for p in ps)) if ps else F.lit(False)
    return (has(parts(select)) if parts(select) else F.lit(True)) & ~has(parts(remove))


@register("qc_rows_by_type", "SELECT p_partkey AS row_id, p_type FROM part WHERE (contains(lower(p_type), 'small') OR contains(lower(p_type), 'promo') OR contains(lower(p_type), 'dium')) AND NOT contains(lower(p_type), 'medi')")
def _by_type(spark, d):
    return table(spark, d, "part").where(rows_by_type(F.col("p_type"), "small,PROMO,dium", "medi")).select(F.col("p_partkey").alias("row_id"), "p_type")


@register("qc_fraction_by_regex", f"""WITH {X} SELECT col_id, count(*) FILTER (val > 0) AS n_genes, sum(val) AS total, round(coalesce(sum(val) FILTER (regexp_matches(p_name, '[02468]$')), 0) / sum(val), 6) AS fraction
FROM x JOIN part ON p_partkey = row_id GROUP BY col_id""")
def _fraction(spark, d):
    """Genes, totals and the share of a row set given by a pattern on names, per column."""
    m = part_by_order(spark, d)
    hit = m.features.select("row_id", F.col("name").rlike("[02468]$").alias("hit"))
    return m.cells.join(hit, "row_id").groupBy("col_id").agg(F.count_if(F.col("val") > 0).alias("n_genes"), F.sum("val").alias("total"), F.round(F.sum(F.when(F.col("hit"), F.col("val")).otherwise(0.0)) / F.sum("val"), 6).alias("fraction"))
