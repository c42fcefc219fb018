"""Row and column statistics, access, filters and normalisation of sparse matrices.

Means and deviations count implicit zeros: denominators come from the dimensions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..catalog import register
from ..matrix import X, Matrix, part_by_order, table


def moments(n: int | Column) -> list[Column]:
    """nnz, tot, mu and sig (population) of val over n entries, stored or not; values that are not finite are skipped but counted in n."""
    n = F.lit(n) if isinstance(n, int) else n
    v = F.when(~F.isnan("val") & (F.abs("val") < float("inf")), F.col("val"))
    mu = F.sum(v) / n
    return [F.count_if(v > 0).alias("nnz"), F.sum(v).alias("tot"), mu.alias("mu"), F.sqrt(F.greatest(F.lit(0.0), F.sum(v * v) / n - mu * mu)).alias("sig")]


def row_stats(m: Matrix) -> DataFrame:
    """row_id, nnz, tot, mu, sig for every feature; empty ones are zero."""
    found = m.cells.groupBy("row_id").agg(*moments(m.n_cols))
    return m.features.select("row_id").join(found, "row_id", "left").na.fill(0)


def column_stats(m: Matrix) -> DataFrame:
    found = m.cells.groupBy("col_id").agg(*moments(m.n_rows))
    return m.samples.select("col_id").join(found, "col_id", "left").na.fill(0)


def stratified_row_stats(m: Matrix, groups: DataFrame) -> DataFrame:
    """Row statistics per group of columns. groups: (col_id, grp); columns without one form the group ''."""
    of = m.samples.select("col_id").join(groups, "col_id", "left").select("col_id", F.coalesce("grp", F.lit("")).alias("grp"))
    sizes = of.groupBy("grp").agg(F.count("*").alias("n"))
    return m.cells.join(of, "col_id").join(F.broadcast(sizes), "grp").groupBy("row_id", "grp", "n").agg(*moments(F.col("n"))).drop("n")


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) + F.lit(0.0) for c in columns})


@register("matrix_row_stats", f"""WITH {X}, n AS (SELECT count(*) AS n FROM orders)
SELECT p_partkey AS row_id, count(*) FILTER (val > 0) AS nnz, coalesce(sum(val), 0) AS tot, round(coalesce(sum(val), 0) / any_value(n), 6) AS mu,
round(sqrt(greatest(0, coalesce(sum(val * val), 0) / any_value(n) - (coalesce(sum(val), 0) / any_value(n)) ** 2)), 6) AS sig
FROM part CROSS JOIN n LEFT JOIN x ON row_id = p_partkey GROUP BY p_partkey""")
def _row_stats(spark, d):
    return rounded(row_stats(part_by_order(spark, d)), "mu", "sig")


@register("matrix_column_stats", f"""WITH {X}, n AS (SELECT count(*) AS n FROM part)
SELECT o_orderkey AS col_id, count(*) FILTER (val > 0) AS nnz, coalesce(sum(val), 0) AS tot, round(coalesce(sum(val), 0) / any_value(n), 6) AS mu,
round(sqrt(greatest(0, coalesce(sum(val * val), 0) / any_value(n) - (coalesce(sum(val), 0) / any_value(n)) ** 2)), 6) AS sig
FROM orders CROSS JOIN n LEFT JOIN x ON col_id = o_orderkey GROUP BY o_orderkey""")
def _column_stats(spark, d):
    return rounded(column_stats(part_by_order(spark, d)), "mu", "sig")


@register("matrix_stratified_row_stats", f"""WITH {X}, n AS (SELECT o_orderpriority AS grp, count(*) AS n FROM orders GROUP BY 1)
SELECT row_id, n.grp, count(*) FILTER (val > 0) AS nnz, sum(val) AS tot, round(sum(val) / any_value(n), 6) AS mu,
round(sqrt(greatest(0, sum(val * val) / any_value(n) - (sum(val) / any_value(n)) ** 2)), 6) AS sig
FROM x JOIN orders ON o_orderkey = col_id JOIN n ON n.grp = o_orderpriority GROUP BY row_id, n.grp""")
def _stratified(spark, d):
    groups = table(spark, d, "orders").select(F.col("o_orderkey").alias("col_id"), F.col("o_orderpriority").alias("grp"))
    return rounded(stratified_row_stats(part_by_order(spark, d), groups), "mu", "sig")


def squeeze(m: Matrix, min_row: int, min_col: int) -> Matrix:
    """Keeps rows and columns with enough positive entries, both counted on the original; an axis that would be emptied stays as it is."""
    positive = m.cells.where("val > 0")
    rows = positive.groupBy("row_id").count().where(F.col("count") >= min_row).select("row_id")
    cols = positive.groupBy("col_id").count().where(F.col("count") >= min_col).select("col_id")
    rows = m.features.select("row_id") if rows.isEmpty() else rows
    cols = m.samples.select("col_id") if cols.isEmpty() else cols
    return Matrix(m.cells.join(rows, "row_id", "left_semi").join(cols, "col_id", "left_semi"), m.features.join(rows, "row_id", "left_semi"), m.samples.join(cols, "col_id", "left_semi"))


@register("matrix_squeeze", f"""WITH {X}, r AS (SELECT row_id FROM x WHERE val > 0 GROUP BY 1 HAVING count(*) >= 28), c AS (SELECT col_id FROM x WHERE val > 0 GROUP BY 1 HAVING count(*) >= 4)
SELECT row_id, col_id, val FROM x SEMI JOIN r USING (row_id) SEMI JOIN c USING (col_id)""")
def _squeeze(spark, d):
    return squeeze(part_by_order(spark, d), 28, 4).cells.select("row_id", "col_id", "val")


def parse_index_spec(spec: str) -> list[int]:
    """'1-3,10' -> [1, 2, 3, 10]; reversed, empty or non-numeric parts are errors."""
    out: list[int] = []
    for part in spec.split(","):
        first, dash, last = part.strip().partition("-")
        a, b = int(first), int(last if dash else first)
        if b < a:
            raise ValueError(f"reversed range {part!r}")
        out += range(a, b + 1)
    if not out:
        raise ValueError("no index")
    return out


def take_columns(m: Matrix, ids: list[int]) -> DataFrame:
    """(position, row_id, val): the columns in the order asked for, repeats kept; unknown ids give nothing."""
    wanted = m.cells.sparkSession.createDataFrame(list(enumerate(ids)), "position long, col_id long")
    return F.broadcast(wanted).join(m.cells, "col_id").select("position", "row_id", "val")


@register("matrix_take_columns", f"""WITH {X}, w AS (SELECT unnest(range(6))::BIGINT AS position, unnest([1, 2, 3, 7, 7, 99999999])::BIGINT AS col_id)
SELECT position, row_id, val FROM x JOIN w USING (col_id)""")
def _take_columns(spark, d):
    return take_columns(part_by_order(spark, d), parse_index_spec("1-3,7,7,99999999"))


def reorder_rows(m: Matrix, order: DataFrame) -> DataFrame:
    """order: (position, name). Cells renumbered to it; names that the matrix lacks give empty rows (val null), other rows go."""
    named = m.features.join(m.cells, "row_id").select("name", "col_id", "val")
    return order.join(named, "name", "left").select("position", "name", "col_id", "val")


@register("matrix_reorder_rows", f"""WITH {X}, o AS (SELECT p_partkey % 50 AS position, p_name AS name FROM part WHERE p_partkey < 50 UNION ALL SELECT 50, 'absent')
SELECT position, o.name, col_id, val FROM o LEFT JOIN (SELECT p_name, col_id, val FROM x JOIN part ON p_partkey = row_id) y ON p_name = o.name""")
def _reorder(spark, d):
    order = table(spark, d, "part").where("p_partkey < 50").select((F.col("p_partkey") % 50).alias("position"), F.col("p_name").alias("name"))
    return reorder_rows(part_by_order(spark, d), order.unionAll(spark.createDataFrame([(50, "absent")], "position long, name string")))


def show_info(m: Matrix) -> DataFrame:
    return m.cells.agg(F.count_if(F.col("val") > 0).alias("nnz")).select(F.lit(m.n_rows).cast("long").alias("n_rows"), F.lit(m.n_cols).cast("long").alias("n_cols"), "nnz")


@register("matrix_info", f"WITH {X} SELECT (SELECT count(*) FROM part) AS n_rows, (SELECT count(*) FROM orders) AS n_cols, count(*) FILTER (val > 0) AS nnz FROM x")
def _info(spark, d):
    return show_info(part_by_order(spark, d))


def folded_stats(m: Matrix, buckets: DataFrame) -> DataFrame:
    """Statistics on a folded feature axis. buckets: (row_id, bucket). Entries of a bucket are summed per column first."""
    sums = m.dealt(m.cells.join(buckets, "row_id"), "bucket", "col_id").groupBy("bucket", "col_id").agg(F.sum("val").alias("val"))
    return sums.groupBy("bucket").agg(*moments(m.n_cols))


@register("matrix_folded_stats", f"""WITH {X}, s AS (SELECT p_brand AS bucket, col_id, sum(val) AS val FROM x JOIN part ON p_partkey = row_id GROUP BY ALL), n AS (SELECT count(*) AS n FROM orders)
SELECT bucket, count(*) FILTER (val > 0) AS nnz, sum(val) AS tot, round(sum(val) / any_value(n), 6) AS mu, round(sqrt(greatest(0, sum(val * val) / any_value(n) - (sum(val) / any_value(n)) ** 2)), 6) AS sig
FROM s CROSS JOIN n GROUP BY bucket""")
def _folded(spark, d):
    buckets = table(spark, d, "part").select(F.col("p_partkey").alias("row_id"), F.col("p_brand").alias("bucket"))
    return rounded(folded_stats(part_by_order(spark, d), buckets), "mu", "sig")


def pseudobulk(m: Matrix, groups: DataFrame, a0: float = 1.0, b0: float = 1.0) -> DataFrame:
    """Sums per (row, group), group sizes and the posterior mean (a0 + sum) / (b0 + n) of a Gamma rate. groups: (col_id, grp[, weight])."""
    weight = F.col("weight") if "weight" in groups.columns else F.lit(1.0)
    groups = groups.select("col_id", "grp", weight.cast("double").alias("weight"))
    sizes = groups.groupBy("grp").agg(F.sum("weight").alias("n"))
    sums = m.cells.join(groups, "col_id").groupBy("row_id", "grp").agg(F.sum(F.col("val") * F.col("weight")).alias("total"))
    return sums.join(F.broadcast(sizes), "grp").select("row_id", "grp", "total", "n", ((F.lit(a0) + F.col("total")) / (F.lit(b0) + F.col("n"))).alias("rate"))


@register("pseudobulk_gamma", f"""WITH {X}, n AS (SELECT o_orderstatus AS grp, count(*)::DOUBLE AS n FROM orders GROUP BY 1)
SELECT row_id, n.grp, sum(val) AS total, any_value(n.n) AS n, round((1 + sum(val)) / (1 + any_value(n.n)), 8) AS rate FROM x JOIN orders ON o_orderkey = col_id JOIN n ON n.grp = o_orderstatus GROUP BY row_id, n.grp""")
def _pseudobulk(spark, d):
    groups = table(spark, d, "orders").select(F.col("o_orderkey").alias("col_id"), F.col("o_orderstatus").alias("grp"))
    return rounded(pseudobulk(part_by_order(spark, d), groups), "rate", digits=8)


@register("pseudobulk_weighted", f"""WITH {X}, g AS (SELECT o_orderkey, o_orderstatus AS grp, (o_orderkey % 3 + 1)::DOUBLE AS w FROM orders), n AS (SELECT grp, sum(w) AS n FROM g GROUP BY 1)
SELECT row_id, n.grp, sum(val * w) AS total, any_value(n.n) AS n, round((1 + sum(val * w)) / (1 + any_value(n.n)), 8) AS rate FROM x JOIN g ON o_orderkey = col_id JOIN n ON n.grp = g.grp GROUP BY row_id, n.grp""")
def _pseudobulk_weighted(spark, d):
    groups = table(spark, d, "orders").select(F.col("o_orderkey").alias("col_id"), F.col("o_orderstatus").alias("grp"), (F.col("o_orderkey") % 3 + 1).alias("weight"))
    return rounded(pseudobulk(part_by_order(spark, d), groups), "rate", digits=8)


def sum_to_one(cells: DataFrame) -> DataFrame:
    """Values as shares of their column; columns that sum to zero stay."""
    totals = cells.groupBy("col_id").agg(F.sum("val").alias("__t"))
    return cells.join(totals, "col_id").select("row_id", "col_id", F.when(F.col("__t") == 0, F.col("val")).otherwise(F.col("val") / F.col("__t")).alias("val"))


@register("normalize_sum_to_one", f"WITH {X}, t AS (SELECT col_id, sum(val) AS t FROM x GROUP BY 1) SELECT row_id, col_id, round(val / t, 8) AS val FROM x JOIN t USING (col_id)")
def _sum_to_one(spark, d):
    return rounded(sum_to_one(part_by_order(spark, d).cells), "val", digits=8)


def scale_stored(cells: DataFrame) -> DataFrame:
    """z-scores per column over stored entries (population deviation); constant columns are only centred."""
    s = cells.groupBy("col_id").agg(F.avg("val").alias("__mu"), F.when(F.min("val") == F.max("val"), 0.0).otherwise(F.stddev_pop("val")).alias("__sd"))
    centred = F.col("val") - F.col("__mu")
    return cells.join(s, "col_id").select("row_id", "col_id", F.when(F.col("__sd") == 0, F.lit(0.0)).otherwise(centred / F.col("__sd")).alias("val"))


@register("normalize_scale_columns", f"""WITH {X}, s AS (SELECT col_id, avg(val) AS mu, CASE WHEN min(val) = max(val) THEN 0 ELSE stddev_pop(val) END AS sd FROM x GROUP BY 1)
SELECT row_id, col_id, round(CASE WHEN sd = 0 THEN 0 ELSE (val - mu) / sd END, 4) + 0.0::DOUBLE AS val FROM x JOIN s USING (col_id)""")
def _scale(spark, d):
    return rounded(scale_stored(part_by_order(spark, d).cells), "val", digits=4)


def tfidf(m: Matrix) -> DataFrame:
    """x ln(N / (df + 1)) with df the columns in which a row is positive."""
    df = m.cells.where("val > 0").groupBy("row_id").agg(F.count("*").alias("__df"))
    return m.cells.join(df, "row_id").select("row_id", "col_id", (F.col("val") * F.log(F.lit(float(m.n_cols)) / (F.col("__df") + 1))).alias("val"))


@register("normalize_tfidf", f"""WITH {X}, f AS (SELECT row_id, count(*) AS df FROM x WHERE val > 0 GROUP BY 1), n AS (SELECT count(*)::DOUBLE AS n FROM orders)
SELECT row_id, col_id, round(val * ln(n / (df + 1)), 6) AS val FROM x JOIN f USING (row_id) CROSS JOIN n""")
def _tfidf(spark, d):
    return rounded(tfidf(part_by_order(spark, d)), "val")


def softmax_columns(cells: DataFrame) -> DataFrame:
    """Softmax over the stored entries of each column, shifted by the largest."""
    top = cells.groupBy("col_id").agg(F.max("val").alias("__top"))
    e = cells.join(top, "col_id").withColumn("__e", F.exp(F.col("val") - F.col("__top")))
    total = e.groupBy("col_id").agg(F.sum("__e").alias("__z"))
    return e.join(total, "col_id").select("row_id", "col_id", (F.col("__e") / F.col("__z")).alias("val"))


@register("normalize_softmax", f"""WITH {X}, t AS (SELECT col_id, max(val / 10) AS top FROM x GROUP BY 1), e AS (SELECT row_id, col_id, exp(val / 10 - top) AS e FROM x JOIN t USING (col_id)), z AS (SELECT col_id, sum(e) AS z FROM e GROUP BY 1)
SELECT row_id, col_id, round(e / z, 8) AS val FROM e JOIN z USING (col_id)""")
def _softmax(spark, d):
    return rounded(softmax_columns(part_by_order(spark, d).cells.withColumn("val", F.col("val") / 10)), "val", digits=8)


@register("column_entropy", f"""WITH {X}, t AS (SELECT col_id, sum(val) AS t FROM x GROUP BY 1) SELECT col_id, round(-sum(val / t * ln(val / t)), 6) + 0.0::DOUBLE AS entropy FROM x JOIN t USING (col_id) WHERE val > 0 GROUP BY col_id""")
def _entropy(spark, d):
    """Shannon entropy (nats) of each column's shares."""
    p = sum_to_one(part_by_order(spark, d).cells).where("val > 0")
    return p.groupBy("col_id").agg((F.round(-F.sum(F.col("val") * F.log("val")), 6) + F.lit(0.0)).alias("entropy"))


def top_k_weighted(cells: DataFrame, weights: DataFrame, k: int) -> DataFrame:
    """Per column the k rows with the largest positive log1p(val) * weight, ties by row. weights: (row_id, weight)."""
    scored = cells.join(weights, "row_id").withColumn("score", F.log1p("val") * F.col("weight")).where("score > 0")
    rank = F.row_number().over(Window.partitionBy("col_id").orderBy(F.desc(F.round("score", 9)), "row_id"))
    return scored.withColumn("__r", rank).where(F.col("__r") <= k).select("col_id", "row_id", "score")


@register("top_k_weighted", f"""WITH {X}, s AS (SELECT col_id, row_id, ln(1 + val) * (p_size % 5) AS score FROM x JOIN part ON p_partkey = row_id)
SELECT col_id, row_id, round(score, 6) AS score FROM s WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY col_id ORDER BY round(score, 9) DESC, row_id) <= 2""")
def _top_k(spark, d):
    weights = table(spark, d, "part").select(F.col("p_partkey").alias("row_id"), (F.col("p_size") % 5).alias("weight"))
    return rounded(top_k_weighted(part_by_order(spark, d).cells, weights, 2), "score")


def select_hvg(stats: DataFrame, n: int) -> DataFrame:
    """The n rows with the largest excess dispersion over the trend ln phi = a + b ln mu, weighted by mu. stats: row_id, mu, sig."""
    s = stats.where("mu >= 1e-4").withColumn("phi", (F.col("sig") * F.col("sig") - F.col("mu")) / (F.col("mu") * F.col("mu")))
    fit = s.where("phi > 0").select(F.col("mu").alias("w"), F.log("mu").alias("x"), F.log("phi").alias("y"))
    t = fit.agg(*(F.sum(F.expr(e)).alias(a) for a, e in (("sw", "w"), ("sx", "w*x"), ("sy", "w*y"), ("sxx", "w*x*x"), ("sxy", "w*x*y"))))
    t = t.selectExpr("(sw*sxy - sx*sy) / (sw*sxx - sx*sx) AS b", "sw", "sx", "sy").selectExpr("b", "(sy - b*sx) / sw AS a")
    scored = s.join(F.broadcast(t)).withColumn("excess", F.col("phi") - F.exp(F.col("a") + F.col("b") * F.log("mu")))
    return scored.orderBy(F.desc(F.round("excess", 9)), "row_id").limit(n).select("row_id", F.round("excess", 5).alias("excess"))


@register("select_hvg", f"""WITH {X}, n AS (SELECT count(*)::DOUBLE AS n FROM orders), st AS (SELECT row_id, sum(val * val) / any_value(n) AS m2, sum(val) / any_value(n) AS mu FROM x CROSS JOIN n GROUP BY 1),
s AS (SELECT row_id, mu, (greatest(0, m2 - mu * mu) - mu) / (mu * mu) AS phi FROM st WHERE mu >= 1e-4), f AS (SELECT mu AS w, ln(mu) AS x, ln(phi) AS y FROM s WHERE phi > 0),
t AS (SELECT (sum(w) * sum(w*x*y) - sum(w*x) * sum(w*y)) / (sum(w) * sum(w*x*x) - sum(w*x) ** 2) AS b, sum(w) AS sw, sum(w*x) AS sx, sum(w*y) AS sy FROM f)
SELECT row_id, round(phi - exp((sy - b * sx) / sw + b * ln(mu)), 5) AS excess FROM s CROSS JOIN t ORDER BY round(phi - exp((sy - b * sx) / sw + b * ln(mu)), 9) DESC, row_id LIMIT 100""")
def _hvg(spark, d):
    return select_hvg(row_stats(part_by_order(spark, d)), 100)


def subsample(ids: DataFrame, column: str, n: int, seed: int) -> DataFrame:
    """Exactly n ids (all if fewer), chosen by a keyed hash, the same in any partitioning."""
    return ids.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(column).cast("string"))), column).limit(n)


@register("subsample_columns", "SELECT o_orderkey AS col_id FROM orders ORDER BY md5('7:' || o_orderkey::VARCHAR), o_orderkey LIMIT 500")
def _subsample(spark, d):
    return subsample(table(spark, d, "orders").select(F.col("o_orderkey").alias("col_id")), "col_id", 500, 7)


@register("subsample_per_group", "SELECT o_orderkey AS col_id, o_orderstatus AS grp FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5('7:' || o_orderkey::VARCHAR), o_orderkey) <= 100")
def _subsample_groups(spark, d):
    """Groups of columns, each capped by a keyed shuffle: a sampling operator."""
    rank = F.row_number().over(Window.partitionBy("grp").orderBy(F.md5(F.concat_ws(":", F.lit("7"), F.col("col_id").cast("string"))), "col_id"))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("col_id"), F.col("o_orderstatus").alias("grp")).withColumn("r", rank).where("r <= 100").drop("r")
