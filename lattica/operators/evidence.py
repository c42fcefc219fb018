"""Tail probabilities, odds, permutations and sums by several groupings at once."""

from __future__ import annotations

from math import pi, sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalog import register
from ..matrix import Matrix, X, part_by_order, table
from ..plans.ranking import global_position
from ..plans.spread import spread

_TABLE = """SELECT l_partkey AS part, count(*) FILTER (l_returnflag = 'R' AND l_linestatus = 'F') AS a, count(*) FILTER (l_returnflag = 'R' AND l_linestatus <> 'F') AS b,
count(*) FILTER (l_returnflag <> 'R' AND l_linestatus = 'F') AS c, count(*) FILTER (l_returnflag <> 'R' AND l_linestatus <> 'F') AS d FROM lineitem GROUP BY 1"""


def _two_by_two(spark, d) -> DataFrame:
    r, f = F.col("l_returnflag") == "R", F.col("l_linestatus") == "F"
    return table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("part")).agg(*(F.count_if(x).alias(n) for n, x in (("a", r & f), ("b", r & ~f), ("c", ~r & f), ("d", ~r & ~f))))


def log_odds_ratio(a: Column, b: Column, c: Column, d: Column) -> Column:
    """ln(a d) - ln(b c) of a two by two table without correction: 0 where both products are 0, else minus or plus infinity where one is."""
    num, den = (x.cast("double") * y.cast("double") for x, y in ((a, d), (b, c)))
    infinite = lambda s: F.lit(float(f"{s}inf"))
    return F.when((num == 0) & (den == 0), 0.0).when(num == 0, infinite("-")).when(den == 0, infinite("")).otherwise(F.log(num) - F.log(den))


@register("log_odds_raw", f"""WITH t AS ({_TABLE}), p AS (SELECT part, 1.0::DOUBLE * a * d AS num, 1.0::DOUBLE * b * c AS den FROM t)
SELECT part, CASE WHEN num = 0 AND den = 0 THEN 0 WHEN num = 0 THEN '-inf'::DOUBLE WHEN den = 0 THEN 'inf'::DOUBLE ELSE round(ln(num) - ln(den), 8) + 0.0::DOUBLE END AS odds FROM p""")
def _log_odds(spark, d):
    odds = log_odds_ratio(*map(F.col, "abcd"))
    return _two_by_two(spark, d).select("part", F.when(F.abs(odds) == float("inf"), odds).otherwise(F.round(odds, 8) + F.lit(0.0)).alias("odds"))


def two_sided_p(z: Column) -> Column:
    """erfc(|z| / sqrt(2)): a series of positive terms in the middle, a continued fraction in the tail, where a difference from 1 would lose its digits."""
    x = F.abs(z) / sqrt(2)
    n = F.sequence(F.lit(0), F.lit(60))
    series = F.aggregate(n, F.struct((2 * x / sqrt(pi)).alias("term"), F.lit(0.0).alias("sum")), lambda s, i: F.struct((s["term"] * x * x / (i + 1.5)).alias("term"), (s["sum"] + s["term"]).alias("sum")))["sum"]
    fraction = F.aggregate(F.sequence(F.lit(60), F.lit(1)), x, lambda t, i: x + i / 2 / t)
    density = F.exp(-x * x)
    return F.when(x < 2, 1 - density * series).otherwise(density / sqrt(pi) / fraction)


_Z = "z AS (SELECT l_partkey AS part, (avg(l_discount) - 0.05) / (0.03 / sqrt(count(*))) AS z FROM lineitem GROUP BY 1)"


@register("z_to_pvalue", f"""WITH {_Z}, x AS (SELECT part, greatest(abs(z) / sqrt(2), 1e-300) AS x FROM z)
SELECT part, round(greatest(0, 1 - exp(-x * x) * list_sum(list_transform(range(0, 150), lambda n: exp((2 * n + 1) * ln(x) - lgamma(n + 1.5))))), 7) + 0.0::DOUBLE AS p FROM x""")
def _z_to_p(spark, d):
    z = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("part")).agg(((F.avg("l_discount") - 0.05) / (0.03 / F.sqrt(F.count("*")))).alias("z"))
    return z.select("part", (F.round(two_sided_p(F.col("z")), 7) + F.lit(0.0)).alias("p"))


def beta_binomial_greater(k: Column, n: Column, rate: float, rho: float) -> Column:
    """P(K >= k) of n trials at a rate with overdispersion rho (0 or less: binomial); 1 for k or n of 0, 0 for k > n. The chance of k by ratios from that of 0, in logarithms; the tail by ratios from there."""
    e = min(max(rate, 1e-9), 1 - 1e-9)
    if rho <= 0:
        none = n * F.log1p(F.lit(-e))
        ratio = lambda i: (n - i) / (i + 1) * (e / (1 - e))
    else:
        size = (1 - min(rho, 1 - 1e-9)) / min(rho, 1 - 1e-9)
        a, b = e * size, (1 - e) * size
        none = F.aggregate(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)).cast("int")), F.lit(0.0), lambda s, i: s + F.log((b + i) / (size + i)))
        ratio = lambda i: (n - i) / (i + 1) * (a + i) / (b + n - i - 1)
    at_k = F.aggregate(F.sequence(F.lit(0), F.greatest(k - 1, F.lit(0)).cast("int")), none, lambda s, i: s + F.log(ratio(i)))
    steps = F.sequence(F.least(k, n).cast("int"), n.cast("int"))
    tail = F.aggregate(steps, F.struct(F.lit(1.0).alias("term"), F.lit(0.0).alias("sum")), lambda s, i: F.struct((s["term"] * ratio(i)).alias("term"), (s["sum"] + s["term"]).alias("sum")))["sum"]
    return F.when((n == 0) | (k == 0), 1.0).when(k > n, 0.0).otherwise(F.least(F.lit(1.0), F.exp(at_k) * tail))


_LB = "lgamma({0}) + lgamma({1}) - lgamma(({0}) + ({1}))"
_TAIL = "CASE WHEN k = 0 THEN 1 ELSE least(1, list_sum(list_transform(range(k, n + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + {0})))) END"


@register("beta_binomial_greater", f"""WITH t AS (SELECT l_partkey AS part, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS k FROM lineitem GROUP BY 1)
SELECT part, round({_TAIL.format(f"({_LB.format('i + 2.25', 'n - i + 6.75')}) - ({_LB.format('2.25', '6.75')})")}, 8) AS over, round({_TAIL.format('i * ln(0.25) + (n - i) * ln(0.75)')}, 8) AS plain FROM t""")
def _beta_binomial(spark, d):
    t = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("part")).agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("k"))
    return t.select("part", *(F.round(beta_binomial_greater(F.col("k"), F.col("n"), 0.25, rho), 8).alias(c) for c, rho in (("over", 0.1), ("plain", 0.0))))


def significant_shares(scores: DataFrame, row: str, alpha: float, temperature: float) -> DataFrame:
    """scores with share: softmax at a temperature over a row's entries with q < alpha and es > 0; the others have none and go. scores: (row, ..., es, q)."""
    kept = scores.where((F.col("q") < alpha) & (F.col("es") > 0)).withColumn("v", F.col("es") / max(temperature, 1e-6))
    top = kept.groupBy(row).agg(F.max("v").alias("top"))
    e = kept.join(top, row).withColumn("e", F.exp(F.col("v") - F.col("top")))
    return e.join(e.groupBy(row).agg(F.sum("e").alias("total")), row).withColumn("share", F.col("e") / F.col("total")).drop("v", "top", "e", "total")


@register("significant_shares", """WITH s AS (SELECT l_suppkey AS s, l_linenumber AS c, avg(l_discount) - 0.04 AS es, count(*) % 10 / 10.0::DOUBLE AS q FROM lineitem GROUP BY ALL), k AS (SELECT s, c, exp(es / 0.02) AS e FROM s WHERE q < 0.55 AND round(es, 9) > 0)
SELECT s, c, round(e / sum(e) OVER (PARTITION BY s), 7) AS share FROM k""")
def _shares(spark, d):
    es = F.avg("l_discount") - 0.04
    s = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("s"), F.col("l_linenumber").alias("c")).agg(F.when(F.round(es, 9) > 0, es).otherwise(0.0).alias("es"), (F.count("*") % 10 / 10.0).alias("q"))
    return significant_shares(s, "s", 0.55, 0.02).select("s", "c", F.round("share", 7).alias("share"))


def permuted_within(df: DataFrame, batch: str, id_: str, seed: int) -> DataFrame:
    """(id, batch, drawn): a permutation of the ids inside each batch, fixed by the seed. Batches lie together in both orders, so positions in the whole table pair the rows and no batch has to fit a task."""
    rows = df.select(id_, batch, F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_).cast("string"))).alias("__h"))
    here = global_position(rows.select(batch, id_), batch, id_)
    there = global_position(rows, batch, "__h", id_).select("position", F.col(id_).alias("drawn"))
    return here.join(there, "position").select(id_, batch, "drawn")


@register("permute_within_batch", """WITH o AS (SELECT o_orderkey AS id, o_orderpriority AS batch FROM orders), a AS (SELECT id, batch, row_number() OVER (PARTITION BY batch ORDER BY id) AS r FROM o),
b AS (SELECT id AS drawn, batch, row_number() OVER (PARTITION BY batch ORDER BY md5('7:' || id), id) AS r FROM o) SELECT id, batch, drawn FROM a JOIN b USING (batch, r)""")
def _permuted(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("batch"))
    return permuted_within(o, "batch", "id", 7)


@register("posterior_quantiles", "SELECT l_partkey AS part, round(quantile_cont(l_extendedprice, 0.05), 4) AS low, round(quantile_cont(l_extendedprice, 0.5), 4) AS middle, round(quantile_cont(l_extendedprice, 0.95), 4) AS high FROM lineitem GROUP BY 1")
def _quantiles(spark, d):
    """Quantiles of draws per element, linear between the two nearest."""
    q = (("low", 0.05), ("middle", 0.5), ("high", 0.95))
    return table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("part")).agg(*(F.round(F.percentile("l_extendedprice", p), 4).alias(c) for c, p in q))


def score_intercepts(df: DataFrame, trait: str, x: str, y: str) -> DataFrame:
    """(trait, intercept, slope) of the least-squares line of y squared on x; slope 0 where x does not vary, the intercept 1 at least."""
    y2 = F.col(y) * F.col(y)
    line = df.groupBy(trait).agg(F.covar_pop(F.col(x), y2).alias("c"), F.var_pop(x).alias("v"), F.count("*").alias("n"), F.avg(x).alias("mx"), F.avg(y2).alias("my"))
    line = line.withColumn("slope", F.when(F.col("v") * F.col("n") > 1e-12, F.col("c") / F.col("v")).otherwise(0.0))
    return line.select(trait, F.greatest(F.lit(1.0), F.col("my") - F.col("slope") * F.col("mx")).alias("intercept"), "slope")


@register("score_intercepts", """SELECT l_suppkey AS trait, round(greatest(1, regr_intercept(y * y, l_quantity)), 5) AS intercept, round(regr_slope(y * y, l_quantity), 5) AS slope FROM (SELECT l_suppkey, l_quantity, l_extendedprice / 10000 AS y FROM lineitem) GROUP BY 1 HAVING var_pop(l_quantity) > 0""")
def _intercepts(spark, d):
    l = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("trait"), "l_quantity", (F.col("l_extendedprice") / 10000).alias("y"))
    varied = l.groupBy("trait").agg(F.var_pop("l_quantity").alias("v")).where("v > 0")
    return score_intercepts(l.join(varied, "trait", "left_semi"), "trait", "l_quantity", "y").select("trait", F.round("intercept", 5).alias("intercept"), F.round("slope", 5).alias("slope"))


def sums_by_groupings(m: Matrix, labels: DataFrame, groupings: list[str]) -> DataFrame:
    """(grouping, label, row_id, total): sums of rows over the columns of each label, for several groupings in one shuffle; null and negative labels take no part. labels: (col_id, a column for each grouping)."""
    long = labels.unpivot(["col_id"], groupings, "grouping", "label").where("label >= 0")
    keys = ["grouping", "label", "row_id"]
    joined = m.cells.join(long, "col_id")
    if m.most is not None:
        joined = spread(joined, m.most * len(groupings), *keys)
    return joined.groupBy(*keys).agg(F.sum("val").alias("total"))


@register("sums_by_groupings", f"""WITH {X}, g AS (SELECT o_orderkey AS col_id, o_custkey % 4 AS g, (o_orderkey % 7 - 1) AS h FROM orders), l AS (SELECT col_id, 'g' AS grouping, g AS label FROM g UNION ALL SELECT col_id, 'h', h FROM g)
SELECT grouping, label::BIGINT AS label, row_id, sum(val) AS total FROM x JOIN l USING (col_id) WHERE label >= 0 GROUP BY ALL""")
def _groupings(spark, d):
    labels = table(spark, d, "orders").selectExpr("o_orderkey AS col_id", "cast(o_custkey % 4 AS long) AS g", "cast(o_orderkey % 7 - 1 AS long) AS h")
    return sums_by_groupings(part_by_order(spark, d), labels, ["g", "h"])


def batch_sums(cells: DataFrame, columns: DataFrame) -> DataFrame:
    """(row_id, batch, total): sums of val * weight over the columns of a batch. columns: (col_id, batch, weight)."""
    return cells.join(columns, "col_id").groupBy("row_id", "batch").agg(F.sum(F.col("val") * F.col("weight")).alias("total"))


@register("batch_row_sums", f"WITH {X} SELECT row_id, o_orderpriority AS batch, sum(val * (1 + o_custkey % 3)) AS total FROM x JOIN orders ON o_orderkey = col_id GROUP BY ALL")
def _batch_sums(spark, d):
    columns = table(spark, d, "orders").select(F.col("o_orderkey").alias("col_id"), F.col("o_orderpriority").alias("batch"), (1 + F.col("o_custkey") % 3).alias("weight"))
    return batch_sums(part_by_order(spark, d).cells, columns)


@register("batch_group_sizes", "SELECT o_orderpriority AS batch, o_orderstatus AS grp, sum(1 + o_custkey % 3)::BIGINT AS n FROM orders GROUP BY ALL")
def _batch_sizes(spark, d):
    """Weighted number of columns per batch and group."""
    return table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("batch"), F.col("o_orderstatus").alias("grp")).agg(F.sum(1 + F.col("o_custkey") % 3).cast("long").alias("n"))


def first_occurrences(df: DataFrame, name: str, at: str) -> DataFrame:
    """(name, at, dropped): each name once, where it first stands, and how many repeats went."""
    return df.groupBy(name).agg(F.min(at).alias(at), (F.count("*") - 1).alias("dropped"))


@register("first_occurrences", "SELECT p_type AS name, min(p_partkey) AS at, count(*) - 1 AS dropped FROM part GROUP BY 1")
def _first(spark, d):
    return first_occurrences(table(spark, d, "part").select(F.col("p_type").alias("name"), F.col("p_partkey").alias("at")), "name", "at")


def agreed(left: DataFrame | None, right: DataFrame | None, key: list[str]) -> DataFrame | None:
    """Distinct keys that both sets hold; a set that is not given restricts nothing."""
    if left is None or right is None:
        given = right if left is None else left
        return None if given is None else given.select(*key).distinct()
    return left.select(*key).distinct().join(right.select(*key), key, "left_semi")


@register("agreed_keys", "SELECT l_orderkey AS col_id FROM lineitem WHERE l_quantity > 40 INTERSECT SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P'")
def _agreed(spark, d):
    a = table(spark, d, "lineitem").where("l_quantity > 40").select(F.col("l_orderkey").alias("col_id"))
    return agreed(a, table(spark, d, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("col_id")), ["col_id"])


def restricted(cells: DataFrame, competent: DataFrame, called: DataFrame, file: str = "file") -> DataFrame:
    """The cells of files with a call that the call names, and all cells of files without one. cells and competent: (file, cell); called: (file), also of calls that name no cell."""
    files = called.select(F.col(file).alias("__called")).distinct()
    marked = cells.join(files, F.col(file) == F.col("__called"), "left")
    kept = competent.select(file, "cell").distinct().withColumn("__kept", F.lit(True))
    return marked.join(kept, [file, "cell"], "left").where("__called IS NULL OR __kept").select(file, "cell")


@register("cells_for_quantification", "SELECT substr(l_shipdate::VARCHAR, 1, 7) AS file, l_orderkey AS cell FROM lineitem WHERE substr(l_shipdate::VARCHAR, 1, 4) NOT IN ('1994', '1996') OR l_quantity > 40")
def _quantified(spark, d):
    """Months as files: those of two years have a call, of orders with a large line."""
    l = table(spark, d, "lineitem").select(F.substring(F.col("l_shipdate").cast("string"), 1, 7).alias("file"), F.col("l_orderkey").alias("cell"), "l_quantity", "l_linenumber", "l_partkey")
    rows = l.withColumn("cell", F.struct("cell", "l_linenumber", "l_partkey"))
    called = rows.where("file LIKE '1994%' OR file LIKE '1996%'")
    return restricted(rows.select("file", "cell"), called.where("l_quantity > 40").select("file", "cell"), called.select("file")).select("file", F.col("cell.cell").alias("cell"))
