"""Marker weights, specificity, cell labels, masks, block correlations, matched draws."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..catalog import register
from ..plans.ranking import positions
from ..matrix import X, part_by_order, table


def idf_weights(markers: DataFrame) -> DataFrame:
    """(type, gene, weight): ln(C / c_g) with C types and c_g types that claim the gene; 0 for genes of all types. markers: (type, gene)."""
    m = markers.select("type", "gene").distinct()
    types = m.agg(F.count_distinct("type").alias("all"))
    claims = m.groupBy("gene").agg(F.count("*").alias("c"))
    return m.join(claims, "gene").join(F.broadcast(types)).select("type", "gene", F.log(F.col("all") / F.col("c")).alias("weight"))


@register("marker_idf_weights", """WITH m AS (SELECT DISTINCT p_type AS type, p_brand || p_size % 3 AS gene FROM part WHERE p_size % 5 < 2), c AS (SELECT gene, count(*) AS c FROM m GROUP BY 1)
SELECT type, gene, round(ln((SELECT count(DISTINCT type) FROM m)::DOUBLE / c), 8) + 0.0::DOUBLE AS weight FROM m JOIN c USING (gene)""")
def _idf(spark, d):
    m = table(spark, d, "part").where("p_size % 5 < 2").select(F.col("p_type").alias("type"), F.concat("p_brand", (F.col("p_size") % 3).cast("string")).alias("gene"))
    return idf_weights(m).withColumn("weight", F.round("weight", 8) + F.lit(0.0))


def specificity(profile: DataFrame, how: str = "simplex") -> DataFrame:
    """Rows (gene, k, beta) as shares over k: simplex clips below 0, abs takes sizes, raw keeps values. Rows without mass stay 0."""
    v = {"simplex": F.greatest("beta", F.lit(0.0)), "abs": F.abs("beta"), "raw": F.col("beta")}[how]
    p = profile.withColumn("v", v)
    total = F.sum("v").over(Window.partitionBy("gene"))
    return p.select("gene", "k", (F.col("v") if how == "raw" else F.when(total > 0, F.col("v") / total).otherwise(0.0)).alias("value"))


@register("profile_specificity", """WITH p AS (SELECT l_partkey AS gene, l_returnflag AS k, avg(l_quantity) - 25 AS beta FROM lineitem GROUP BY ALL), s AS (SELECT *, sum(greatest(beta, 0)) OVER (PARTITION BY gene) AS t FROM p)
SELECT gene, k, round(CASE WHEN t > 0 THEN greatest(beta, 0) / t ELSE 0 END, 6) AS value FROM s""")
def _specificity(spark, d):
    p = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("gene"), F.col("l_returnflag").alias("k")).agg((F.avg("l_quantity") - 25).alias("beta"))
    return specificity(p).withColumn("value", F.round("value", 6))


def label_cells(membership: DataFrame, q: DataFrame, least: float) -> DataFrame:
    """(cell, type, confidence): membership (cell, k, p) times q (k, type, w), rows brought to 1 where they have mass, the largest type (last on ties); unassigned below the least confidence or without mass."""
    s = membership.join(F.broadcast(q), "k").groupBy("cell", "type").agg(F.sum(F.col("p") * F.col("w")).alias("s"))
    g = s.groupBy("cell").agg(F.sum("s").alias("mass"), F.max(F.struct(F.round("s", 9).alias("r"), "type", "s")).alias("top"))
    c = F.when(F.col("mass") > 1e-12, F.col("top.s") / F.col("mass")).otherwise(0.0)
    return membership.select("cell").distinct().join(g.withColumn("confidence", c), "cell", "left").select("cell", F.when(F.round("confidence", 9) >= least, F.col("top.type")).otherwise("unassigned").alias("type"), F.round(F.coalesce("confidence", F.lit(0.0)), 6).alias("confidence"))


_Q = [("R", "ret", 1.0), ("A", "kept", 0.7), ("A", "ret", 0.3), ("N", "kept", 1.0)]


@register("label_cells", f"""WITH q(k, type, w) AS (VALUES {", ".join(f"('{k}', '{t}', {w}::DOUBLE)" for k, t, w in _Q)}), n AS (SELECT l_orderkey AS cell, l_returnflag AS k, count(*)::DOUBLE AS n FROM lineitem GROUP BY ALL), m AS (SELECT cell, k, n / sum(n) OVER (PARTITION BY cell) AS p FROM n),
s AS (SELECT cell, type, sum(p * w) AS s FROM m JOIN q USING (k) GROUP BY ALL), g AS (SELECT cell, sum(s) AS mass, arg_max(type, (round(s, 9), type)) AS type, max(s) AS top FROM s GROUP BY cell)
SELECT cell, CASE WHEN round(top / mass, 9) >= 0.6 THEN type ELSE 'unassigned' END AS type, round(top / mass, 6) AS confidence FROM g""")
def _label(spark, d):
    n = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("cell"), F.col("l_returnflag").alias("k")).agg(F.count("*").alias("n"))
    m = n.select("cell", "k", (F.col("n") / F.sum("n").over(Window.partitionBy("cell"))).alias("p"))
    return label_cells(m, spark.createDataFrame(_Q, "k string, type string, w double"), 0.6)


def drop_masked(sites: DataFrame, mask: DataFrame, offsets: dict[str, tuple[int, ...]]) -> DataFrame:
    """Sites (chr, pos, strand, ...) none of whose positions pos + offset, by strand, is masked (chr, pos)."""
    at = F.coalesce(*(F.when(F.col("strand") == s, F.array(*(F.col("pos") + o for o in os))) for s, os in offsets.items()), F.array("pos"))
    hit = sites.withColumn("__p", F.explode(at)).join(mask.select("chr", F.col("pos").alias("__p")).distinct(), ["chr", "__p"], "left_semi")
    return sites.join(hit.select("chr", "pos", "strand").distinct(), ["chr", "pos", "strand"], "left_anti")


@register("mask_motif_sites", """WITH s AS (SELECT DISTINCT l_suppkey AS chr, l_partkey AS pos, l_linestatus AS strand FROM lineitem), m AS (SELECT DISTINCT l_suppkey AS chr, l_partkey AS pos FROM lineitem WHERE l_quantity < 2)
SELECT chr, pos, strand FROM s WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.chr = s.chr AND m.pos BETWEEN s.pos - CASE strand WHEN 'F' THEN 2 ELSE 0 END AND s.pos + CASE strand WHEN 'F' THEN 0 ELSE 2 END)""")
def _mask(spark, d):
    l = table(spark, d, "lineitem")
    s = l.select(F.col("l_suppkey").alias("chr"), F.col("l_partkey").alias("pos"), F.col("l_linestatus").alias("strand")).distinct()
    m = l.where("l_quantity < 2").select(F.col("l_suppkey").alias("chr"), F.col("l_partkey").alias("pos"))
    return drop_masked(s, m, {"F": (-2, -1, 0), "O": (0, 1, 2)}).select("chr", "pos", "strand")


def ld_scores(long: DataFrame) -> DataFrame:
    """(block, snp, score): the sum of squared correlations with all variants of the block, itself included, from long (block, snp, sample, x); samples without a row count as 0. n: samples of a block.

    Pairs come from a join on (block, sample), summed before they meet anything else.
    """
    n = long.groupBy("block").agg(F.count_distinct("sample").alias("n"))
    m = long.groupBy("block", "snp").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q")).join(F.broadcast(n), "block")
    m = m.selectExpr("block", "snp", "n", "s", "q - s * s / n AS v").where("v > 1e-9")
    a, b = (long.select("block", "sample", F.col("snp").alias(f"snp_{i}"), F.col("x").alias(f"x_{i}")) for i in "ab")
    xy = a.join(b, ["block", "sample"]).groupBy("block", "snp_a", "snp_b").agg(F.sum(F.col("x_a") * F.col("x_b")).alias("xy"))
    side = lambda i: m.select("block", *([F.col("n")] if i == "a" else []), F.col("snp").alias(f"snp_{i}"), F.col("s").alias(f"s_{i}"), F.col("v").alias(f"v_{i}"))
    pairs = side("a").join(side("b"), "block").join(xy, ["block", "snp_a", "snp_b"], "left").na.fill(0.0, ["xy"])
    c = F.col("xy") - F.col("s_a") * F.col("s_b") / F.col("n")
    return pairs.groupBy("block", F.col("snp_a").alias("snp")).agg(F.sum(c * c / (F.col("v_a") * F.col("v_b"))).alias("score"))


@register("block_ld_scores", """WITH x AS (SELECT l_suppkey AS block, l_partkey % 8 AS snp, l_orderkey % 60 AS sample, sum(l_quantity) AS x FROM lineitem GROUP BY ALL), n AS (SELECT block, count(DISTINCT sample) AS n FROM x GROUP BY 1),
m AS (SELECT block, snp, sum(x) AS s, sum(x * x) - sum(x) ** 2 / any_value(n) AS v, any_value(n) AS n FROM x JOIN n USING (block) GROUP BY ALL), p AS (SELECT a.block, a.snp AS i, b.snp AS j, sum(a.x * b.x) AS xy FROM x a JOIN x b ON a.block = b.block AND a.sample = b.sample GROUP BY ALL)
SELECT a.block, a.snp, round(sum((coalesce(xy, 0) - a.s * b.s / a.n) ** 2 / (a.v * b.v)), 6) AS score FROM m a JOIN m b ON a.block = b.block LEFT JOIN p ON p.block = a.block AND i = a.snp AND j = b.snp WHERE a.v > 1e-9 AND b.v > 1e-9 GROUP BY ALL""")
def _ld(spark, d):
    x = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("block"), (F.col("l_partkey") % 8).alias("snp"), (F.col("l_orderkey") % 60).alias("sample")).agg(F.sum("l_quantity").alias("x"))
    return ld_scores(x).withColumn("score", F.round("score", 6))


def draw_matched(pool: DataFrame, chosen: DataFrame, seed: int) -> DataFrame:
    """A random set with the same number per stratum as the chosen ids, none of them chosen. pool: (id, stratum). chosen: (id)."""
    want = pool.join(chosen, "id", "left_semi").groupBy("stratum").agg(F.count("*").alias("n"))
    drawn = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("id").cast("string")))
    rest = positions(pool.join(chosen, "id", "left_anti").withColumn("__drawn", drawn), ["stratum"], ["__drawn", "id"], "r")
    return rest.join(want, "stratum").where("r <= n").select("id", "stratum")


@register("draw_matched", """WITH p AS (SELECT p_partkey AS id, p_size % 6 AS stratum FROM part), w AS (SELECT stratum, count(*) AS n FROM p WHERE id % 17 = 0 GROUP BY 1), r AS (SELECT id, stratum, row_number() OVER (PARTITION BY stratum ORDER BY md5('3:' || id), id) AS r FROM p WHERE id % 17 <> 0)
SELECT id, stratum FROM r JOIN w USING (stratum) WHERE r <= n""")
def _draw(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") % 6).alias("stratum"))
    return draw_matched(p, p.where("id % 17 = 0").select("id"), 3)


@register("top_alternative", """WITH n AS (SELECT l_partkey AS site, l_returnflag AS allele, count(*) AS n FROM lineitem WHERE l_returnflag <> 'N' GROUP BY ALL) SELECT site, arg_max(allele, (n, allele)) AS allele, max(n) AS n FROM n GROUP BY site""")
def _alternative(spark, d):
    """The most frequent allele other than the reference, last on ties."""
    n = table(spark, d, "lineitem").where("l_returnflag <> 'N'").groupBy(F.col("l_partkey").alias("site"), F.col("l_returnflag").alias("allele")).agg(F.count("*").alias("n"))
    return n.groupBy("site").agg(F.max_by("allele", F.struct("n", "allele")).alias("allele"), F.max("n").alias("n"))


@register("adjust_poisson_ratio", f"""WITH {X}, d AS (SELECT row_id, avg(val) AS d FROM x GROUP BY 1), l AS (SELECT col_id, sum(val) / sum(d) AS l FROM x JOIN d USING (row_id) GROUP BY 1) SELECT row_id, col_id, round(val / (d * l), 6) AS val FROM x JOIN d USING (row_id) JOIN l USING (col_id)""")
def _poisson(spark, d):
    """x / (d * lambda) with lambda = sum x / sum d over the stored entries of a column."""
    c = part_by_order(spark, d).cells
    x = c.join(c.groupBy("row_id").agg(F.avg("val").alias("d")), "row_id")
    return x.join(x.groupBy("col_id").agg((F.sum("val") / F.sum("d")).alias("l")), "col_id").select("row_id", "col_id", F.round(F.col("val") / (F.col("d") * F.col("l")), 6).alias("val"))


@register("json_props", "SELECT event_type, (props->>'$.k')::BIGINT % 10 AS k, count(*) AS n FROM events GROUP BY ALL")
def _json(spark, d):
    """A manifest-like JSON column read with an explicit schema."""
    return table(spark, d, "events").select("event_type", (F.from_json("props", "k bigint").k % 10).alias("k")).groupBy("event_type", "k").agg(F.count("*").alias("n"))


@register("site_profile", """SELECT o_orderpriority AS branch, least(floor(o_totalprice / 20000), 19)::BIGINT AS bin, count(*) FILTER (l_returnflag = 'R') AS k, count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL""")
def _site_profile(spark, d):
    """Sums of k and n per (branch, bin)."""
    j = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    return j.groupBy(F.col("o_orderpriority").alias("branch"), F.least(F.floor(F.col("o_totalprice") / 20000), F.lit(19)).cast("long").alias("bin")).agg(F.count_if(F.col("l_returnflag") == "R").alias("k"), F.count("*").alias("n"))
