"""Ranks, cumulative statistics and multiple testing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..catalog import register
from ..matrix import table
from ..plans.ranking import global_position, medians, positions, ranged, running, suffix_min
from ..plans.scratch import materialize

#: p-like test values: a hash of keys in [0, 1), the same in both engines.
_P = "cast(conv(substr(md5(concat_ws(':', cast(l_orderkey as string), cast(l_linenumber as string), cast(l_partkey as string))), 1, 8), 16, 10) as double) / 4294967296.0"
_PQ = "('0x' || substr(md5(l_orderkey || ':' || l_linenumber || ':' || l_partkey), 1, 8))::BIGINT / 4294967296.0::DOUBLE"


def _pvalues(spark, d) -> DataFrame:
    return table(spark, d, "lineitem").select(F.concat_ws(":", "l_orderkey", "l_linenumber", "l_partkey").alias("id"), F.col("l_suppkey").alias("grp"), F.expr(_P).alias("p")).distinct()


_V = f"v AS (SELECT DISTINCT l_orderkey || ':' || l_linenumber || ':' || l_partkey AS id, l_suppkey AS grp, {_PQ} AS p FROM lineitem)"


def benjamini_hochberg(df: DataFrame, p: str = "p", id_: str = "id") -> DataFrame:
    """df with q: the least p * m / rank among its own and larger p-values, at most 1. Null p-values are left out."""
    rows = ranged(df.where(F.col(p).isNotNull()), p, id_)
    m = rows.count()
    ranked = global_position(rows, p, id_, dealt=True)
    return suffix_min(ranked, p, F.col(p) * m / F.col("position"), "q", id_).withColumn("q", F.least("q", F.lit(1.0))).drop("position")


@register("bh_qvalues", f"""WITH {_V}, r AS (SELECT id, p, p * count(*) OVER () / row_number() OVER (ORDER BY p, id) AS raw FROM v)
SELECT id, round(p, 9) AS p, round(least(1, min(raw) OVER (ORDER BY p DESC, id DESC ROWS UNBOUNDED PRECEDING)), 8) AS q FROM r""")
def _bh(spark, d):
    return benjamini_hochberg(_pvalues(spark, d)).select("id", F.round("p", 9).alias("p"), F.round("q", 8).alias("q"))


def harmonic(m: Column) -> Column:
    """1 + 1/2 + ... + 1/m: summed below 32, from there by Euler and Maclaurin, whose error is below 1e-15."""
    sums = F.array(*(F.lit(sum(1.0 / i for i in range(1, n + 1))) for n in range(32)))
    x = m.cast("double")
    far = F.log(x) + 0.5772156649015329 + 1 / (2 * x) - 1 / (12 * x * x) + 1 / (120 * x * x * x * x) - 1 / (252 * F.pow(x, F.lit(6)))
    return F.when(m < 32, F.get(sums, m.cast("int"))).otherwise(far)


def scaled_pvalues(df: DataFrame, group: str, p: str = "p", id_: str = "id") -> DataFrame:
    """df with position (ties by id), m and raw = p * m / position within groups, without null p-values."""
    rows = positions(df.where(F.col(p).isNotNull()), [group], [p, id_], "position", "m")
    return rows.withColumn("raw", F.col(p) * F.col("m") / F.col("position"))


def bh_by_group(df: DataFrame, group: str, p: str = "p", id_: str = "id") -> DataFrame:
    """df with q-values within groups, at most 1. Null p-values are left out."""
    rows = materialize(scaled_pvalues(df, group, p, id_).drop("position", "m"), "raw")
    out = running(rows, [group], [p, id_], {"q": ("min", F.col("raw"))}, reverse=True)
    return out.withColumn("q", F.least(F.lit(1.0), F.col("q"))).drop("raw", "__bucket")


@register("bh_qvalues_by_group", f"""WITH {_V}, r AS (SELECT id, grp, p, p * count(*) OVER (PARTITION BY grp) / row_number() OVER (PARTITION BY grp ORDER BY p, id) AS raw FROM v)
SELECT id, grp, round(least(1, min(raw) OVER (PARTITION BY grp ORDER BY p DESC, id DESC ROWS UNBOUNDED PRECEDING)), 8) AS q FROM r""")
def _bh_group(spark, d):
    return bh_by_group(_pvalues(spark, d), "grp").select("id", "grp", F.round("q", 8).alias("q"))


def bh_reject(df: DataFrame, group: str, alpha: float | Column, by: bool = False) -> DataFrame:
    """Rejected rows per group: p up to the largest p with p <= alpha * rank / m (divided by the harmonic number of m for BY). alpha may be a column with one value for a group."""
    rows = materialize(positions(df.where("p IS NOT NULL"), [group], ["p", "id"], "__at", "__m").drop("__bucket"), "placed")
    level = F.lit(alpha) if isinstance(alpha, float) else alpha
    ok = F.col("p") <= level / (harmonic(F.col("__m")) if by else F.lit(1.0)) * F.col("__at") / F.col("__m")
    cuts = rows.where(ok).groupBy(F.col(group).alias("__g")).agg(F.max("p").alias("__cut"))
    return rows.join(cuts, rows[group].eqNullSafe(F.col("__g"))).where("p <= __cut").drop("__g", "__cut", "__at", "__m")


for _name, _by, _h in (("bh", False, "1.0"), ("by", True, "list_sum(list_transform(range(1, m + 1), lambda i: 1.0::DOUBLE / i))")):

    @register(f"{_name}_reject", f"""WITH {_V}, w AS (SELECT *, count(*) OVER (PARTITION BY grp) AS m, row_number() OVER (PARTITION BY grp ORDER BY p, id) AS r FROM (SELECT id, grp, p * p * p AS p FROM v)),
c AS (SELECT grp, max(p) AS cut FROM w WHERE p <= 0.2 / {_h} * r / m GROUP BY grp) SELECT id, w.grp FROM w JOIN c ON c.grp = w.grp AND p <= cut""")
    def _reject(spark, d, by=_by):
        return bh_reject(_pvalues(spark, d).withColumn("p", F.col("p") * F.col("p") * F.col("p")), "grp", 0.2, by).select("id", "grp")


@register("simes", f"""WITH {_V}, r AS (SELECT grp, p * count(*) OVER (PARTITION BY grp) / row_number() OVER (PARTITION BY grp ORDER BY p, id) AS s FROM v) SELECT grp, round(least(1, min(s)), 8) AS simes FROM r GROUP BY grp""")
def _simes(spark, d):
    """min of m * p_(i) / i per group, at most 1."""
    return scaled_pvalues(_pvalues(spark, d), "grp").groupBy("grp").agg(F.round(F.least(F.lit(1.0), F.min("raw")), 8).alias("simes"))


def running_enrichment(df: DataFrame, group: str, order: list[str], hit: str, w: str) -> DataFrame:
    """Weighted running-sum score per group: hits add w / sum(w), misses take 1 / misses, in the order; the first deviation of the largest size. 0 without hits or misses.

    The sums are carried over, so a group may fill any number of tasks.
    """
    weight = F.when(F.col(hit), F.col(w)).otherwise(0.0)
    miss = F.when(F.col(hit), 0).otherwise(1)
    rows = ranged(df.withColumn("__w", weight.cast("double")).withColumn("__miss", miss.cast("long")), group, *order)
    sums = {"__at": ("sum", F.lit(1).cast("long")), "__sw": ("sum", F.col("__w")), "__sm": ("sum", F.col("__miss"))}
    run = running(rows, [group], order, sums, {"__tw": sums["__sw"], "__tm": sums["__sm"]})
    es = F.when((F.col("__tw") > 0) & (F.col("__tm") > 0), F.col("__sw") / F.col("__tw") - F.col("__sm") / F.col("__tm")).otherwise(0.0)
    return run.withColumn("es", es).groupBy(group).agg(F.max_by("es", F.struct(F.round(F.abs("es"), 9), -F.col("__at"))).alias("es"))


@register("enrichment_score", """WITH r AS (SELECT l_suppkey AS grp, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) AS rank, l_returnflag = 'R' AS hit, l_quantity AS w FROM lineitem),
s AS (SELECT grp, rank, CASE WHEN sum(w) FILTER (hit) OVER (PARTITION BY grp) > 0 AND count(*) FILTER (NOT hit) OVER (PARTITION BY grp) > 0 THEN CASE WHEN hit THEN w / sum(w) FILTER (hit) OVER (PARTITION BY grp) ELSE -1.0::DOUBLE / count(*) FILTER (NOT hit) OVER (PARTITION BY grp) END ELSE 0 END AS step FROM r),
e AS (SELECT grp, rank, sum(step) OVER (PARTITION BY grp ORDER BY rank ROWS UNBOUNDED PRECEDING) AS es FROM s) SELECT grp, round(arg_max(es, (round(abs(es), 9), -rank)), 6) AS es FROM e GROUP BY grp""")
def _es(spark, d):
    r = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("grp"), "l_extendedprice", "l_orderkey", "l_linenumber", "l_partkey", (F.col("l_returnflag") == "R").alias("hit"), F.col("l_quantity").alias("w"))
    return running_enrichment(r, "grp", ["-l_extendedprice", "l_orderkey", "l_linenumber", "l_partkey"], "hit", "w").select("grp", F.round("es", 6).alias("es"))


def top_two(shares: DataFrame, id_: str) -> DataFrame:
    """Per id the label of the largest share (first label on ties), and the two largest shares. shares: (id, label, share)."""
    r = F.row_number().over(Window.partitionBy(id_).orderBy(F.desc("share"), "label"))
    t = shares.withColumn("r", r).where("r <= 2")
    return t.groupBy(id_).agg(F.max(F.when(F.col("r") == 1, F.col("label"))).alias("label"), F.max(F.when(F.col("r") == 1, F.col("share"))).alias("best"), F.coalesce(F.max(F.when(F.col("r") == 2, F.col("share"))), F.lit(0.0)).alias("second"))


@register("consensus_top_two", """WITH v AS (SELECT l_partkey AS id, year(l_shipdate)::VARCHAR AS label, count(*)::DOUBLE AS n FROM lineitem GROUP BY ALL), s AS (SELECT id, label, n / sum(n) OVER (PARTITION BY id) AS share FROM v)
SELECT id, arg_max(label, (round(share, 9), -label::BIGINT)) AS label, round(max(share), 6) AS best, round(coalesce(list(share ORDER BY share DESC)[2], 0), 6) AS second FROM s GROUP BY id""")
def _top_two(spark, d):
    votes = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("id"), F.year("l_shipdate").cast("string").alias("label")).agg(F.count("*").alias("n"))
    shares = votes.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("id")))
    return top_two(shares, "id").select("id", "label", F.round("best", 6).alias("best"), F.round("second", 6).alias("second"))


def credible_sets(df: DataFrame, group: str, coverage: float, most: int) -> DataFrame:
    """Per group the smallest set of ids, largest probability first, that reaches the coverage; groups that need more than `most` are left out. df: (group, id, p)."""
    w = Window.partitionBy(group).orderBy(F.desc("p"), "id")
    c = df.withColumns({"r": F.row_number().over(w), "before": F.coalesce(F.sum("p").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)), "all": F.sum("p").over(Window.partitionBy(group))})
    kept = c.where((F.round("before", 9) < coverage) & (F.round("all", 9) >= coverage))
    return kept.withColumn("size", F.count("*").over(Window.partitionBy(group))).where(F.col("size") <= most).select(group, "id", "r", "size")


@register("credible_sets", """WITH v AS (SELECT l_orderkey AS grp, l_partkey AS id, sum(l_extendedprice) AS v FROM lineitem GROUP BY ALL), p AS (SELECT grp, id, v / sum(v) OVER (PARTITION BY grp) AS p FROM v),
c AS (SELECT grp, id, row_number() OVER (PARTITION BY grp ORDER BY p DESC, id) AS r, coalesce(sum(p) OVER (PARTITION BY grp ORDER BY p DESC, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM p)
SELECT grp, id, r, count(*) OVER (PARTITION BY grp) AS size FROM c WHERE round(before, 9) < 0.8 QUALIFY count(*) OVER (PARTITION BY grp) <= 3""")
def _credible(spark, d):
    s = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("grp"), F.col("l_partkey").alias("id")).agg(F.sum("l_extendedprice").alias("v"))
    return credible_sets(s.withColumn("p", F.col("v") / F.sum("v").over(Window.partitionBy("grp"))), "grp", 0.8, 3)


@register("within_source_rank", """SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, round(CASE WHEN count(*) OVER (PARTITION BY l_suppkey) > 1 THEN (row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice, l_orderkey, l_linenumber, l_partkey) - 1)::DOUBLE / (count(*) OVER (PARTITION BY l_suppkey) - 1) ELSE 0 END, 8) AS rank FROM lineitem""")
def _rank(spark, d):
    """(rank by distance and index) / (n - 1), 0 for n <= 1; ties have distinct ranks."""
    keys = ["l_orderkey", "l_linenumber", "l_partkey"]
    rows = positions(table(spark, d, "lineitem").select("l_suppkey", "l_extendedprice", *keys), ["l_suppkey"], ["l_extendedprice", *keys], "at", "n")
    return rows.select("l_suppkey", *keys, F.round(F.when(F.col("n") > 1, (F.col("at") - 1) / (F.col("n") - 1)).otherwise(0.0), 8).alias("rank"))


def quantile_strata(df: DataFrame, value: str, id_: str, strata: int, at_least: int) -> DataFrame:
    """df with stratum: rank * k div n with k = min(strata, n div at_least), 1 at least; ties by id."""
    rows = ranged(df, value, id_)
    n = rows.count()
    k = max(1, min(strata, n // at_least))
    return global_position(rows, value, id_, dealt=True).drop("__bucket").withColumn("stratum", F.expr(f"(position - 1) * {k} div {max(n, 1)}").cast("long")).drop("position")


@register("quantile_strata", "SELECT p_partkey AS id, (row_number() OVER (ORDER BY p_retailprice, p_partkey) - 1) * least(10, (SELECT count(*) FROM part) // 30) // (SELECT count(*) FROM part) AS stratum FROM part")
def _strata(spark, d):
    return quantile_strata(table(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_retailprice"), "p_retailprice", "id", 10, 30).select("id", "stratum")


def equal_width_bins(df: DataFrame, value: str, n: int) -> DataFrame:
    """floor((x - lo) / span * n), n - 1 at most; 0 where all values are equal."""
    r = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    x = F.when(F.col("hi") > F.col("lo"), F.floor((F.col(value) - F.col("lo")) / (F.col("hi") - F.col("lo")) * n)).otherwise(0)
    return df.join(F.broadcast(r)).withColumn("bin", F.least(x, F.lit(n - 1)).cast("long")).drop("lo", "hi")


@register("pseudotime_bins", "SELECT o_orderkey, least(floor((o_totalprice - lo) / (hi - lo) * 20), 19)::BIGINT AS bin FROM orders CROSS JOIN (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders)")
def _bins(spark, d):
    return equal_width_bins(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", 20).select("o_orderkey", "bin")


@register("log_histogram", "SELECT floor(log10(1 + o_totalprice) * 10)::BIGINT AS bin, count(*) AS n FROM orders GROUP BY 1")
def _histogram(spark, d):
    return table(spark, d, "orders").groupBy(F.floor(F.log10(1 + F.col("o_totalprice")) * 10).cast("long").alias("bin")).agg(F.count("*").alias("n"))


@register("fuzzy_exp_weights", """SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, round(exp(-l_extendedprice / median(l_extendedprice) OVER (PARTITION BY l_suppkey)), 8) AS w FROM lineitem""")
def _exp_weights(spark, d):
    """exp(-d / median d) per source."""
    keys = ["l_orderkey", "l_linenumber", "l_partkey"]
    rows = table(spark, d, "lineitem").select("l_suppkey", *keys, F.col("l_extendedprice").alias("x"))
    return rows.join(medians(rows, ["l_suppkey"], "x", *keys), "l_suppkey").select("l_suppkey", *keys, F.round(F.exp(-F.col("x") / F.col("median")), 8).alias("w"))
