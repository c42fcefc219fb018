"""Association tables: evidence, meta-analysis, selection, regression, calls, curves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..catalog import register
from ..matrix import table


def _qtl(spark, d) -> DataFrame:
    """(gene, variant, context, beta, se): mean and standard error of quantities per supplier, part mod 40 and flag."""
    g = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("gene"), (F.col("l_partkey") % 40).alias("variant"), F.concat("l_returnflag", "l_linestatus").alias("context"))
    q = g.agg((F.avg("l_quantity") - 25.5).alias("beta"), (F.stddev_samp("l_quantity") / F.sqrt(F.count("*"))).alias("se"))
    return q.where("se > 0")


_Q = "q AS (SELECT l_suppkey AS gene, l_partkey % 40 AS variant, l_returnflag || l_linestatus AS context, avg(l_quantity) - 25.5 AS beta, stddev_samp(l_quantity) / sqrt(count(*)) AS se FROM lineitem GROUP BY ALL HAVING stddev_samp(l_quantity) > 0)"


def select_top_variants(qtl: DataFrame, k: int) -> DataFrame:
    """Every pair of a variant that is among the k of some gene with the largest mean chi-square; ties by variant."""
    score = qtl.groupBy("gene", "variant").agg(F.avg(F.pow(F.col("beta") / F.col("se"), 2)).alias("s"))
    r = F.row_number().over(Window.partitionBy("gene").orderBy(F.desc(F.round("s", 6)), "variant"))
    top = score.withColumn("r", r).where(F.col("r") <= k).select("variant").distinct()
    return qtl.join(top, "variant", "left_semi")


@register("qtl_select_top", f"WITH {_Q}, s AS (SELECT gene, variant, avg((beta / se) ** 2) AS s FROM q GROUP BY ALL), t AS (SELECT DISTINCT variant FROM (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY gene ORDER BY round(s, 6) DESC, variant) <= 2)) SELECT gene, variant, context, round(beta, 6) AS beta FROM q SEMI JOIN t USING (variant)")
def _select(spark, d):
    return select_top_variants(_qtl(spark, d), 2).select("gene", "variant", "context", F.round("beta", 6).alias("beta"))


def evidence_states(qtl: DataFrame, detect: float = 2.0, power: float = 2.8) -> DataFrame:
    """state per context of a pair: edge if |beta / se| >= detect; absent if power * se is below the reference effect, |beta| of the runner-up by |z|; else unknown."""
    w = Window.partitionBy("gene", "variant").orderBy(F.desc(F.round(F.abs(F.col("beta") / F.col("se")), 9)), "context")
    ref = F.max(F.when(F.col("r") == 2, F.abs("beta"))).over(Window.partitionBy("gene", "variant"))
    z = qtl.withColumn("r", F.row_number().over(w)).withColumn("ref", ref)
    state = F.when(F.round(F.abs(F.col("beta") / F.col("se")), 9) >= detect, "edge").when(F.round(power * F.col("se"), 9) < F.round("ref", 9), "absent").otherwise("unknown")
    return z.select("gene", "variant", "context", state.alias("state"))


_ST = "z AS (SELECT *, row_number() OVER (PARTITION BY gene, variant ORDER BY round(abs(beta / se), 9) DESC, context) AS r FROM q), f AS (SELECT *, max(abs(beta)) FILTER (r = 2) OVER (PARTITION BY gene, variant) AS ref FROM z), s AS (SELECT gene, variant, context, CASE WHEN round(abs(beta / se), 9) >= 2 THEN 'edge' WHEN round(2.8 * se, 9) < round(ref, 9) THEN 'absent' ELSE 'unknown' END AS state FROM f)"


@register("qtl_evidence_states", f"WITH {_Q}, {_ST} SELECT * FROM s")
def _states(spark, d):
    return evidence_states(_qtl(spark, d))


@register("qtl_ubiquity", f"WITH {_Q}, {_ST} SELECT gene, variant, count(*) FILTER (state <> 'unknown') AS n_powered, count(*) FILTER (state = 'edge') AS n_edge, count(*) FILTER (state = 'unknown') AS n_unknown, round(CASE WHEN count(*) FILTER (state <> 'unknown') > 0 THEN count(*) FILTER (state = 'edge')::DOUBLE / count(*) FILTER (state <> 'unknown') END, 6) AS ubiquity FROM s GROUP BY ALL")
def _ubiquity(spark, d):
    s = evidence_states(_qtl(spark, d)).groupBy("gene", "variant").agg(F.count_if(F.col("state") != "unknown").alias("n_powered"), F.count_if(F.col("state") == "edge").alias("n_edge"), F.count_if(F.col("state") == "unknown").alias("n_unknown"))
    return s.withColumn("ubiquity", F.round(F.when(F.col("n_powered") > 0, F.col("n_edge") / F.col("n_powered")), 6))


def leave_one_out_meta(qtl: DataFrame) -> DataFrame:
    """Inverse-variance meta-analysis without the context of the largest |z| (first on ties); null for fewer than two."""
    w = Window.partitionBy("gene", "variant")
    r = F.row_number().over(w.orderBy(F.desc(F.round(F.abs(F.col("beta") / F.col("se")), 9)), "context"))
    iv = 1 / (F.col("se") * F.col("se"))
    q = qtl.withColumn("r", r)
    g = q.groupBy("gene", "variant").agg(F.count("*").alias("n"), F.sum(F.when(F.col("r") > 1, F.col("beta") * iv)).alias("a"), F.sum(F.when(F.col("r") > 1, iv)).alias("b"))
    return g.select("gene", "variant", "n", F.when(F.col("n") >= 2, F.col("a") / F.col("b")).alias("beta"), F.when(F.col("n") >= 2, 1 / F.sqrt("b")).alias("se"))


@register("qtl_loo_meta", f"WITH {_Q}, z AS (SELECT *, row_number() OVER (PARTITION BY gene, variant ORDER BY round(abs(beta / se), 9) DESC, context) AS r FROM q) SELECT gene, variant, count(*) AS n, round(CASE WHEN count(*) >= 2 THEN sum(beta / (se * se)) FILTER (r > 1) / sum(1 / (se * se)) FILTER (r > 1) END, 5) + 0.0::DOUBLE AS beta, round(CASE WHEN count(*) >= 2 THEN 1 / sqrt(sum(1 / (se * se)) FILTER (r > 1)) END, 5) AS se FROM z GROUP BY ALL")
def _meta(spark, d):
    return leave_one_out_meta(_qtl(spark, d)).select("gene", "variant", "n", (F.round("beta", 5) + F.lit(0.0)).alias("beta"), F.round("se", 5).alias("se"))


def marginal_ols(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Slope, its standard error and z of y on x per group, both centred by group; a constant x gives slope 0 and no error."""
    a = df.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(F.col(x) * F.col(x)).alias("sxx"), F.sum(F.col(x) * F.col(y)).alias("sxy"), F.sum(F.col(y) * F.col(y)).alias("syy"))
    a = a.selectExpr(*keys, "n", "sxx - sx * sx / n AS xx", "sxy - sx * sy / n AS xy", "syy - sy * sy / n AS yy")
    flat = F.col("xx") < 1e-9
    beta = F.when(flat, 0.0).otherwise(F.col("xy") / F.col("xx"))
    se = F.when(~flat & (F.col("n") > 2), F.sqrt(F.greatest(F.lit(0.0), F.col("yy") - F.col("xy") * F.col("xy") / F.col("xx")) / (F.col("n") - 2)) / F.sqrt("xx"))
    return a.select(*keys, "n", beta.alias("beta"), se.alias("se"))


@register("marginal_ols", """WITH a AS (SELECT l_suppkey AS gene, count(*) AS n, sum(l_quantity) AS sx, sum(l_discount) AS sy, sum(l_quantity * l_quantity) AS sxx, sum(l_quantity * l_discount) AS sxy, sum(l_discount * l_discount) AS syy FROM lineitem GROUP BY 1), c AS (SELECT gene, n, sxx - sx * sx / n AS xx, sxy - sx * sy / n AS xy, syy - sy * sy / n AS yy FROM a)
SELECT gene, n, round(xy / xx, 8) AS beta, round(sqrt(greatest(0, yy - xy * xy / xx) / (n - 2)) / sqrt(xx), 8) AS se FROM c""")
def _ols(spark, d):
    return marginal_ols(table(spark, d, "lineitem").withColumnRenamed("l_suppkey", "gene"), ["gene"], "l_quantity", "l_discount").select("gene", "n", F.round("beta", 8).alias("beta"), F.round("se", 8).alias("se"))


def auc(df: DataFrame, group: str, score: str, positive: str) -> DataFrame:
    """Area under the ROC curve with average ranks on ties, and average precision (positives first on ties), per group; null without both classes.

    Rows are counted per score first; the counts above a score are carried over between buckets of a group.
    """
    from ..plans.ranking import ranged, running
    from .windows import harmonic

    tied = df.groupBy(group, score).agg(F.count_if(positive).alias("__p"), F.count_if(~F.col(positive)).alias("__n"))
    above = {"__pa": ("sum", F.col("__p")), "__na": ("sum", F.col("__n"))}
    r = running(ranged(tied, group, score), [group], [score], above, {"p": above["__pa"], "n": above["__na"]}, reverse=True, before=True)
    # Pairs of a positive and a lower negative, ties half; the j-th positive of a score has precision (pa + j) / (pa + na + j).
    won = F.col("__p") * (F.col("n") - F.col("__na") - F.col("__n") / 2)
    before = F.col("__pa") + F.col("__na")
    precise = F.col("__p") - F.col("__na") * (harmonic(before + F.col("__p")) - harmonic(before))
    g = r.groupBy(group).agg(F.max("p").alias("p"), F.max("n").alias("n"), F.sum(won).alias("won"), F.sum(precise).alias("precise"))
    both = (F.col("p") > 0) & (F.col("n") > 0)
    return g.select(group, F.when(both, F.col("won") / (F.col("p") * F.col("n"))).alias("auc"), F.when(both, F.col("precise") / F.col("p")).alias("auprc"))


@register("auc_auprc", """WITH b AS (SELECT l_suppkey AS grp, l_quantity AS s, l_returnflag = 'R' AS y FROM lineitem), r AS (SELECT *, rank() OVER (PARTITION BY grp ORDER BY s) + (count(*) OVER (PARTITION BY grp, s) - 1) / 2.0::DOUBLE AS r, sum(y::INT) OVER (PARTITION BY grp ORDER BY s DESC, y DESC ROWS UNBOUNDED PRECEDING) AS hits, row_number() OVER (PARTITION BY grp ORDER BY s DESC, y DESC) AS pos FROM b)
SELECT grp, round((sum(r) FILTER (y) - count(*) FILTER (y) * (count(*) FILTER (y) + 1) / 2) / (count(*) FILTER (y) * count(*) FILTER (NOT y)), 8) AS auc, round(avg(hits::DOUBLE / pos) FILTER (y), 8) AS auprc FROM r GROUP BY grp""")
def _auc(spark, d):
    b = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("grp"), F.col("l_quantity").alias("s"), (F.col("l_returnflag") == "R").alias("y"))
    return auc(b, "grp", "s", "y").select("grp", F.round("auc", 8).alias("auc"), F.round("auprc", 8).alias("auprc"))


def allele_match(a1: Column, a2: Column, b1: Column, b2: Column) -> Column:
    """same, flipped, ambiguous (A/T or C/G pairs) or mismatch."""
    pair = F.concat(a1, a2)
    return F.when(pair.isin("AT", "TA", "CG", "GC"), "ambiguous").when((a1 == b1) & (a2 == b2), "same").when((a1 == b2) & (a2 == b1), "flipped").otherwise("mismatch")


@register("alleles_match", """WITH a AS (SELECT p_partkey AS snp, substr('ACGT', (p_partkey % 4 + 1)::INT, 1) AS a1, substr('ACGT', (p_size % 4 + 1)::INT, 1) AS a2, substr('ACGT', (p_partkey // 4 % 4 + 1)::INT, 1) AS b1, substr('ACGT', (p_size // 4 % 4 + 1)::INT, 1) AS b2 FROM part)
SELECT snp, CASE WHEN a1 || a2 IN ('AT', 'TA', 'CG', 'GC') THEN 'ambiguous' WHEN a1 = b1 AND a2 = b2 THEN 'same' WHEN a1 = b2 AND a2 = b1 THEN 'flipped' ELSE 'mismatch' END AS match FROM a""")
def _alleles(spark, d):
    base = lambda e: F.expr(f"substring('ACGT', cast({e} % 4 + 1 AS int), 1)")
    return table(spark, d, "part").select(F.col("p_partkey").alias("snp"), allele_match(base("p_partkey"), base("p_size"), base("p_partkey div 4"), base("p_size div 4")).alias("match"))


def call_genotypes(df: DataFrame, error: float = 0.01, least_depth: int = 5, least_quality: float = 20.0) -> DataFrame:
    """Genotype of k alternative reads out of n by binomial likelihoods of RR, RA, AA with equal priors; no call below depth or quality -10 log10(1 - P)."""
    k, n = F.col("k"), F.col("n")
    logs = [k * F.log(F.lit(p)) + (n - k) * F.log(F.lit(1 - p)) for p in (error, 0.5, 1 - error)]
    top = F.greatest(*logs)
    weights = [F.exp(x - top) for x in logs]
    rest = (sum(weights[1:], weights[0]) - 1) / sum(weights[1:], weights[0])
    quality = F.least(F.lit(99.0), -10 * F.log10(F.greatest(rest, F.lit(1e-12))))
    name = F.when(logs[0] == top, "RR").when(logs[1] == top, "RA").otherwise("AA")
    return df.withColumn("quality", F.round(quality, 3)).withColumn("genotype", F.when((n < least_depth) | (F.col("quality") < least_quality), "NoCall").otherwise(name))


@register("genotype_calls", """WITH s AS (SELECT l_partkey AS site, count(*) FILTER (l_returnflag = 'R') AS k, count(*) AS n FROM lineitem GROUP BY 1), g AS (SELECT *, k * ln(0.01::DOUBLE) + (n - k) * ln(0.99::DOUBLE) AS a, k * ln(0.5::DOUBLE) + (n - k) * ln(0.5::DOUBLE) AS b, k * ln(0.99::DOUBLE) + (n - k) * ln(0.01::DOUBLE) AS c FROM s),
w AS (SELECT *, exp(a - greatest(a, b, c)) + exp(b - greatest(a, b, c)) + exp(c - greatest(a, b, c)) AS z FROM g), q AS (SELECT *, round(least(99, -10 * log10(greatest((z - 1) / z, 1e-12))), 3) AS quality FROM w)
SELECT site, k, n, quality, CASE WHEN n < 5 OR quality < 20 THEN 'NoCall' WHEN a = greatest(a, b, c) THEN 'RR' WHEN b = greatest(a, b, c) THEN 'RA' ELSE 'AA' END AS genotype FROM q""")
def _genotypes(spark, d):
    s = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("site")).agg(F.count_if(F.col("l_returnflag") == "R").alias("k"), F.count("*").alias("n"))
    return call_genotypes(s).select("site", "k", "n", "quality", "genotype")


def first_read_counts(reads: DataFrame) -> DataFrame:
    """Reads of one (cell, umi, gene) count once; the first read fixes the channel. reads: (cell, umi, gene, channel, at)."""
    first = reads.groupBy("cell", "umi", "gene").agg(F.min_by("channel", F.struct("at", "channel")).alias("channel"))
    return first.groupBy("cell", "gene", "channel").agg(F.count("*").alias("val"))


@register("umi_dedupe", "WITH f AS (SELECT user_id, props, event_type, arg_min(value < 10, (ts, value < 10)) AS small FROM events GROUP BY ALL) SELECT user_id AS cell, event_type AS gene, small AS channel, count(*) AS val FROM f GROUP BY ALL")
def _umi(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("cell"), F.col("props").alias("umi"), F.col("event_type").alias("gene"), (F.col("value") < 10).alias("channel"), F.col("ts").alias("at"))
    return first_read_counts(e)


@register("two_channel_rows", """WITH s AS (SELECT l_suppkey AS cell, l_partkey % 20 AS gene, sum(l_quantity) FILTER (l_returnflag = 'R') AS pos, sum(l_quantity) FILTER (l_returnflag <> 'R') AS neg FROM lineitem GROUP BY ALL)
SELECT cell, gene, unnest(['positive', 'negative']) AS channel, unnest([pos, neg]) AS val FROM s""")
def _channels(spark, d):
    """Sites pooled to genes: a row per (cell, gene) and channel."""
    s = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("cell"), (F.col("l_partkey") % 20).alias("gene"))
    s = s.agg(F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_quantity"))).alias("positive"), F.sum(F.when(F.col("l_returnflag") != "R", F.col("l_quantity"))).alias("negative"))
    return s.unpivot(["cell", "gene"], ["positive", "negative"], "channel", "val")


@register("distal_usage", """WITH s AS (SELECT l_suppkey AS cell, l_partkey % 50 AS gene, sum(l_quantity) FILTER (l_linenumber <= 3) AS a, sum(l_quantity) FILTER (l_linenumber > 3) AS b FROM lineitem GROUP BY ALL)
SELECT cell, gene, coalesce(a, 0) AS proximal, coalesce(b, 0) AS distal, round(coalesce(b, 0) / (coalesce(a, 0) + coalesce(b, 0)), 6) AS pdui FROM s""")
def _pdui(spark, d):
    """Share of the distal of two sites per (cell, gene); pairs without counts drop."""
    s = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("cell"), (F.col("l_partkey") % 50).alias("gene"))
    s = s.agg(F.sum(F.when(F.col("l_linenumber") <= 3, F.col("l_quantity")).otherwise(0.0)).alias("proximal"), F.sum(F.when(F.col("l_linenumber") > 3, F.col("l_quantity")).otherwise(0.0)).alias("distal"))
    return s.where("proximal + distal > 0").withColumn("pdui", F.round(F.col("distal") / (F.col("proximal") + F.col("distal")), 6))


@register("log_odds_woolf", """WITH t AS (SELECT l_suppkey AS gene, count(*) FILTER (l_returnflag = 'R' AND l_linestatus = 'O') + 0.5::DOUBLE AS a, count(*) FILTER (l_returnflag = 'R' AND l_linestatus <> 'O') + 0.5::DOUBLE AS b, count(*) FILTER (l_returnflag <> 'R' AND l_linestatus = 'O') + 0.5::DOUBLE AS c, count(*) FILTER (l_returnflag <> 'R' AND l_linestatus <> 'O') + 0.5::DOUBLE AS d FROM lineitem GROUP BY 1)
SELECT gene, round(ln(a * d / (b * c)), 6) + 0.0::DOUBLE AS log_odds, round(sqrt(1 / a + 1 / b + 1 / c + 1 / d), 6) AS se FROM t""")
def _woolf(spark, d):
    """Log odds ratio with half counts added, and its standard error."""
    r, o = F.col("l_returnflag") == "R", F.col("l_linestatus") == "O"
    t = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("gene")).agg(*((F.count_if(c) + 0.5).alias(n) for n, c in (("a", r & o), ("b", r & ~o), ("c", ~r & o), ("d", ~r & ~o))))
    return t.selectExpr("gene", "round(ln(a * d / (b * c)), 6) + 0.0D AS log_odds", "round(sqrt(1 / a + 1 / b + 1 / c + 1 / d), 6) AS se")
