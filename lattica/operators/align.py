"""Alignment of matrices by name, and tiered name lookups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import register
from ..functions import names as N
from ..matrix import table
from ..plans.ranking import global_position
from ..plans.scratch import materialize
from ..plans.spread import spread


def row_dictionary(backends: DataFrame, how: str = "union", at_least: int = 1) -> DataFrame:
    """(name, row_id): rows present in one (union), every (intersect) or at least so many backends, numbered in name order.

    backends: (backend, name). A name counts once per backend. Names are ranked
    within the distinct names, not over cells.
    """
    present = backends.select("backend", "name").distinct().groupBy("name").agg(F.count("*").alias("n"))
    if how == "intersect":
        at_least = backends.select("backend").distinct().count()
    kept = present.where(F.col("n") >= at_least).select("name")
    return global_position(kept, "name").select("name", (F.col("position") - 1).alias("row_id"))


def align(cells: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(backend, row_id, col_id, val): cells (backend, name, col_id, val) renumbered by the dictionary; rows of one backend that share a name are summed, others go."""
    return cells.join(dictionary, "name").groupBy("backend", "row_id", "col_id").agg(F.sum("val").alias("val"))


def _backends(spark, d):
    l = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("p_partkey") == F.col("l_partkey"))
    return l.where("l_shipdate < '1994-01-01' OR l_returnflag <> 'R'").select(F.col("l_returnflag").alias("backend"), F.concat_ws("-", "p_type", "p_size").alias("name"), F.col("l_orderkey").alias("col_id"), F.col("l_quantity").alias("val"))


_B = "b AS (SELECT l_returnflag AS backend, p_type || '-' || p_size AS name, l_orderkey AS col_id, l_quantity AS val FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_shipdate < '1994-01-01' OR l_returnflag <> 'R')"
for _how, _having in (("union", ">= 1"), ("intersect", ">= (SELECT count(DISTINCT backend) FROM b)"), ("two", ">= 2")):

    @register(f"align_rows_{_how}", f"""WITH {_B}, d AS (SELECT name, row_number() OVER (ORDER BY name) - 1 AS row_id FROM b GROUP BY name HAVING count(DISTINCT backend) {_having})
SELECT backend, row_id, col_id, sum(val) AS val FROM b JOIN d USING (name) GROUP BY ALL""")
    def _align(spark, d, how=_how):
        b = _backends(spark, d)
        return align(b, row_dictionary(b, how, 2 if how == "two" else 1))


def merge_columns(cells: DataFrame, batches: DataFrame) -> DataFrame:
    """Horizontal merge: columns become name@batch. cells: (row_id, col_id, batch, val). batches: (batch, label)."""
    return cells.join(F.broadcast(batches), "batch").select("row_id", F.concat_ws("@", F.col("col_id").cast("string"), "label").alias("column_name"), "val")


@register("merge_columns_suffixed", "SELECT l_partkey AS row_id, l_orderkey || '@' || CASE l_linestatus WHEN 'O' THEN 'open' ELSE 'filled' END AS column_name, sum(l_quantity) AS val FROM lineitem GROUP BY ALL")
def _merge(spark, d):
    batches = spark.createDataFrame([("O", "open"), ("F", "filled")], "batch string, label string")
    cells = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("row_id"), F.col("l_orderkey").alias("col_id"), F.col("l_linestatus").alias("batch")).agg(F.sum("l_quantity").alias("val"))
    return merge_columns(cells, batches)


@register("align_backends_grid", """WITH c AS (SELECT l_returnflag AS modality, l_linestatus AS batch, l_partkey AS row_id, l_orderkey AS col_id, sum(l_quantity) AS val FROM lineitem WHERE l_returnflag <> 'R' GROUP BY ALL),
r AS (SELECT modality, row_id FROM c GROUP BY ALL HAVING count(DISTINCT batch) = (SELECT count(DISTINCT batch) FROM c)), k AS (SELECT batch, col_id FROM c GROUP BY ALL HAVING count(DISTINCT modality) = (SELECT count(DISTINCT modality) FROM c))
SELECT modality, batch, row_id, col_id, val FROM c SEMI JOIN r USING (modality, row_id) SEMI JOIN k USING (batch, col_id)""")
def _grid(spark, d):
    """Rows intersected per modality over batches, columns per batch over modalities; batches without shared columns drop out."""
    c = table(spark, d, "lineitem").where("l_returnflag <> 'R'").groupBy(F.col("l_returnflag").alias("modality"), F.col("l_linestatus").alias("batch"), F.col("l_partkey").alias("row_id"), F.col("l_orderkey").alias("col_id")).agg(F.sum("l_quantity").alias("val"))
    n = c.agg(F.count_distinct("batch").alias("b"), F.count_distinct("modality").alias("m")).first()
    rows = c.select("modality", "row_id", "batch").distinct().groupBy("modality", "row_id").count().where(F.col("count") == n.b)
    cols = c.select("batch", "col_id", "modality").distinct().groupBy("batch", "col_id").count().where(F.col("count") == n.m)
    return c.join(rows, ["modality", "row_id"], "left_semi").join(cols, ["batch", "col_id"], "left_semi").select("modality", "batch", "row_id", "col_id", "val")


def match_keys(queries: DataFrame, keys: DataFrame, delimiter: str = "@") -> DataFrame:
    """(query, key, tier): 1 exact, 2 text before the delimiter equal, 3 a key that starts with the query, 4 a key that the query starts with; the first tier that matches wins, in it the smallest key.

    queries: (query). keys: (key). Tiers 3 and 4 join on every prefix length that occurs, as
    equi-joins. Keys that share a prefix are one row, the smallest of them, before they are
    joined, so a prefix of all keys costs no task more; prefixes are made in tasks of a
    bounded number of rows.
    """
    q, k = (materialize(df.select(c).where(F.col(c).isNotNull()).distinct(), c) for df, c in ((queries, "query"), (keys, "key")))
    base = lambda c: F.substring_index(c, delimiter, 1).alias("start")

    def starts(long: DataFrame, text: str, short: DataFrame, name: str) -> DataFrame:
        """(text, l, start) for the lengths that the shorter side has."""
        lengths = [r[0] for r in short.select(F.length(name).alias("l")).where("l > 0").distinct().collect()]
        of = F.filter(F.array(*map(F.lit, sorted(lengths))), lambda l: l <= F.length(text)) if lengths else F.array().cast("array<int>")
        dealt = spread(long, long.count() * max(1, len(lengths)), text)
        return dealt.withColumn("l", F.explode(of)).withColumn("start", F.expr(f"substring({text}, 1, l)"))

    least = lambda df: df.groupBy("start").agg(F.min("key").alias("key"))
    out, left = [], q
    for tier in (1, 2, 3, 4):
        if tier == 1:
            hit = left.join(k, F.col("query") == F.col("key"))
        elif tier == 2:
            hit = left.withColumn("start", base("query")).join(least(k.withColumn("start", base("key"))), "start")
        elif tier == 3:
            hit = left.join(least(starts(k, "key", left, "query")), F.col("query") == F.col("start"))
        else:
            # Of the keys that a query starts with, the shortest is the smallest.
            found = starts(left, "query", k, "key").join(k.withColumnRenamed("key", "start"), "start").groupBy("query").agg(F.min("l").alias("l"))
            hit = found.withColumn("key", F.expr("substring(query, 1, l)"))
        out.append(materialize(hit.select("query", "key", F.lit(tier).alias("tier")), "hits"))
        left = materialize(left.join(out[-1].select("query"), "query", "left_anti"), "left")
    return reduce(DataFrame.unionAll, out)


@register("match_keys_tiered", """WITH q AS (SELECT DISTINCT CASE c_custkey % 5 WHEN 0 THEN c_name WHEN 1 THEN c_name || '@x' WHEN 2 THEN left(c_name, 16) WHEN 3 THEN c_name || 'zz' ELSE 'none' || c_custkey END AS query FROM customer),
k AS (SELECT DISTINCT CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE c_name || '@' || c_mktsegment END AS key FROM customer),
h AS (SELECT query, key, CASE WHEN query = key THEN 1 WHEN string_split(query, '@')[1] = string_split(key, '@')[1] THEN 2 WHEN starts_with(key, query) THEN 3 WHEN starts_with(query, key) THEN 4 END AS tier FROM q, k)
SELECT query, min(key) AS key, tier FROM h JOIN (SELECT query, min(tier) AS tier FROM h GROUP BY 1) USING (query, tier) GROUP BY query, tier""")
def _match(spark, d):
    c = table(spark, d, "customer")
    k = F.col("c_custkey") % 5
    q = F.when(k == 0, F.col("c_name")).when(k == 1, F.concat(F.col("c_name"), F.lit("@x"))).when(k == 2, F.substring("c_name", 1, 16)).when(k == 3, F.concat(F.col("c_name"), F.lit("zz"))).otherwise(F.concat(F.lit("none"), F.col("c_custkey").cast("string")))
    keys = F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).otherwise(F.concat_ws("@", "c_name", "c_mktsegment"))
    return match_keys(c.select(q.alias("query")), c.select(keys.alias("key")))


@register("match_by_substring", "SELECT q.query, p_partkey FROM (VALUES ('ring'), ('bolt'), ('nothing')) q(query) JOIN part ON contains(p_name, q.query)")
def _substring(spark, d):
    """Every (query, name) pair where the name holds the query. The queries are a short list of the caller's."""
    queries = ["ring", "bolt", "nothing"]
    hits = F.filter(F.array(*map(F.lit, queries)), lambda q: F.contains(F.col("p_name"), q))
    return table(spark, d, "part").select(F.explode(hits).alias("query"), "p_partkey")


@register("match_flexible", "SELECT p_partkey, q.query FROM (VALUES ('brand#12'), ('X')) q(query) JOIN part ON contains('_' || lower(CASE WHEN p_partkey % 2 = 0 THEN p_brand || '_x' ELSE 'a_' || p_brand END) || '_', '_' || lower(q.query) || '_')")
def _flexible(spark, d):
    from .gene_index import flexible_pairs

    queries = spark.createDataFrame([("brand#12",), ("X",)], "query string")
    p = table(spark, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, F.concat(F.col("p_brand"), F.lit("_x"))).otherwise(F.concat(F.lit("a_"), F.col("p_brand"))).alias("name"))
    return flexible_pairs(queries, p.withColumnRenamed("p_partkey", "row_id")).select(F.col("row_id").alias("p_partkey"), "query")


@register("labels_to_columns", """SELECT o_orderkey AS col_id, coalesce(label, 'none') AS label FROM orders LEFT JOIN (SELECT l_orderkey, arg_max(l_returnflag, (l_linenumber, l_partkey, l_returnflag)) AS label FROM lineitem WHERE l_quantity > 25 GROUP BY 1) ON l_orderkey = o_orderkey""")
def _labels(spark, d):
    """Labels in column order with a default; a later duplicate overwrites an earlier one."""
    last = table(spark, d, "lineitem").where("l_quantity > 25").groupBy(F.col("l_orderkey").alias("col_id")).agg(F.max_by("l_returnflag", F.struct("l_linenumber", "l_partkey", "l_returnflag")).alias("label"))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("col_id")).join(last, "col_id", "left").na.fill("none", ["label"])


@register("union_names", "SELECT name, row_number() OVER (ORDER BY name) - 1 AS idx FROM (SELECT n_name AS name FROM nation UNION SELECT r_name FROM region UNION SELECT p_brand FROM part)")
def _union_names(spark, d):
    """Union of name lists (vocabularies), sorted and numbered from 0."""
    names = table(spark, d, "nation").select(F.col("n_name").alias("name")).union(table(spark, d, "region").select("r_name")).union(table(spark, d, "part").select("p_brand")).distinct()
    return global_position(names, "name").select("name", (F.col("position") - 1).alias("idx"))
