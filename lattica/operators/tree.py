"""Tests on trees and acyclic graphs: p-values combined upwards, families tested downwards, ancestors.

Trees are tables of (parent, child). Both directions go level by level: upwards a family
is combined once all its children are, downwards only rejected nodes open their families.
Families are ranked by range-dealt windows, so one of any size is spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import register
from ..matrix import table
from ..plans.scratch import forget, materialize
from .windows import bh_reject, scaled_pvalues


def combine_bottom_up(edges: DataFrame, leaves: DataFrame) -> DataFrame:
    """(node, p) of every node: the given p within [0, 1] for nodes in leaves (node, p), else Simes over the children, 1 without any.

    Repeated edges count once. A node with several parents counts in each. Cycles are an error.
    """
    edges = materialize(edges.where("parent IS NOT NULL AND child IS NOT NULL").select("parent", "child").distinct(), "edges")
    leaves = leaves.where("node IS NOT NULL AND p IS NOT NULL").groupBy("node").agg(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.min("p"))).alias("p"))
    bare = edges.select(F.col("child").alias("node")).join(edges.select(F.col("parent").alias("node")), "node", "left_anti").distinct()
    bare = bare.join(leaves.select("node"), "node", "left_anti").withColumn("p", F.lit(1.0))
    done = new = materialize(leaves.unionByName(bare), "done")
    waiting = materialize(edges.join(leaves.select(F.col("node").alias("parent")), "parent", "left_anti").withColumn("p", F.lit(None).cast("double")), "waiting")
    while not waiting.isEmpty():
        fresh = new.select(F.col("node").alias("child"), F.col("p").alias("__new"))
        filled = materialize(waiting.join(fresh, "child", "left").select("parent", "child", F.coalesce("p", "__new").alias("p")), "waiting")
        ready = filled.groupBy("parent").agg(F.count_if(F.col("p").isNull()).alias("open")).where("open = 0").select("parent")
        family = filled.join(ready, "parent", "left_semi")
        new = materialize(scaled_pvalues(family, "parent", "p", "child").groupBy("parent").agg(F.least(F.lit(1.0), F.min("raw")).alias("p")).withColumnRenamed("parent", "node"), "combined")
        if new.isEmpty():
            raise ValueError("the edges hold a cycle")
        rest = materialize(filled.join(ready, "parent", "left_anti"), "waiting")
        forget(waiting)
        forget(filled)
        waiting, done = rest, done.unionByName(new)
    return done


def descend(edges: DataFrame, combined: DataFrame, root: str, q: float, by: bool = False) -> DataFrame:
    """(node, level) of the rejected nodes below the root, which counts as rejected, by levels from 1.

    Each rejected node's children are tested by BH (BY) at q times the product, over its path, of the
    shares of families that were rejected. A node that several paths reach is tested at the largest
    target of these, which rejects what any of the others would.
    """
    edges = materialize(edges.where("parent IS NOT NULL AND child IS NOT NULL").select("parent", "child").distinct().join(combined.select(F.col("node").alias("child"), "p"), "child"), "edges")
    spark = edges.sparkSession
    kind = dict(edges.dtypes)["parent"]
    front = spark.createDataFrame([(root, 1.0)], f"node {kind}, gamma double")
    seen, levels, level = front, [], 0
    while True:
        level += 1
        family = materialize(edges.join(front.withColumnRenamed("node", "parent"), "parent").select("parent", F.col("child").alias("id"), "p", "gamma"), "families")
        if family.isEmpty():
            break
        hit = materialize(bh_reject(family, "parent", F.lit(q) * F.col("gamma"), by), "rejected")
        sizes = family.groupBy("parent").agg(F.count("*").alias("n"))
        share = hit.groupBy("parent").agg(F.count("*").alias("r")).join(sizes, "parent").select("parent", (F.col("r") / F.col("n")).alias("share"))
        reached = hit.join(share, "parent").groupBy(F.col("id").alias("node")).agg(F.max(F.col("gamma") * F.col("share")).alias("gamma"))
        better = reached.join(seen.groupBy("node").agg(F.max("gamma").alias("__was")), "node", "left").where("__was IS NULL OR gamma > __was").drop("__was")
        front = materialize(better, "front")
        levels.append(front.select("node", F.lit(level).alias("level")))
        seen = seen.unionByName(front)
        forget(family)
    found = levels[0] if levels else spark.createDataFrame([], f"node {kind}, level int")
    for more in levels[1:]:
        found = found.unionByName(more)
    return found.groupBy("node").agg(F.min("level").alias("level"))


def ancestors(edges: DataFrame) -> DataFrame:
    """(node, ancestor, steps): every node of the edges with itself and all that lie above it, at the least number of steps."""
    edges = materialize(edges.select("parent", "child").distinct(), "edges")
    nodes = edges.select(F.col("child").alias("node")).unionAll(edges.select("parent")).distinct()
    found = front = materialize(nodes.select("node", F.col("node").alias("ancestor"), F.lit(0).alias("steps")), "reached")
    while True:
        up = front.join(edges, F.col("ancestor") == F.col("child")).select("node", F.col("parent").alias("ancestor"), (F.col("steps") + 1).alias("steps")).distinct()
        front = materialize(up.join(found.select("node", "ancestor"), ["node", "ancestor"], "left_anti"), "reached")
        if front.isEmpty():
            return found
        found = found.unionByName(front)


_P = "cast(conv(substr(md5(concat('t', cast(p_partkey as string))), 1, 8), 16, 10) as double) / 4294967296.0"
_PATH = ["p_type", "concat_ws('/', p_type, p_brand)", "concat_ws('/', p_type, p_brand, cast(p_size as string))", "concat_ws('/', p_type, p_brand, cast(p_size as string), cast(p_partkey as string))"]


def _tree(spark, d) -> tuple[DataFrame, DataFrame]:
    """Parts below their size, brand and type, with a p-value for each part."""
    p = table(spark, d, "part")
    levels = [F.lit("all"), *map(F.expr, _PATH)]
    edges = p.select(F.explode(F.array(*(F.struct(a.alias("parent"), b.alias("child")) for a, b in zip(levels, levels[1:])))).alias("e")).select("e.*").distinct()
    value = F.expr(_P)
    strong = F.expr("p_brand like '%1'")
    return edges, p.select(levels[-1].alias("node"), F.when(strong, value * value * value * value).otherwise(value).alias("p"))


_T = """t AS (SELECT p_type AS a, p_type || '/' || p_brand AS b, p_type || '/' || p_brand || '/' || p_size AS c, p_type || '/' || p_brand || '/' || p_size || '/' || p_partkey AS leaf,
  CASE WHEN p_brand LIKE '%1' THEN v * v * v * v ELSE v END AS p FROM (SELECT *, ('0x' || substr(md5('t' || p_partkey), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS v FROM part)),
n4 AS (SELECT leaf AS node, c AS parent, p FROM t),
""" + ",\n".join(
    f"n{i} AS (SELECT x.parent AS node, any_value(t.{up}) AS parent, least(1, min(s)) AS p FROM (SELECT parent, p * count(*) OVER (PARTITION BY parent) / row_number() OVER (PARTITION BY parent ORDER BY p, node) AS s FROM n{i + 1}) x JOIN (SELECT DISTINCT {own} AS own, {up} FROM t) t ON t.own = x.parent GROUP BY x.parent)"
    for i, own, up in ((3, "c", "b"), (2, "b", "a"))
) + """,
n1 AS (SELECT parent AS node, 'all' AS parent, least(1, min(s)) AS p FROM (SELECT parent, p * count(*) OVER (PARTITION BY parent) / row_number() OVER (PARTITION BY parent ORDER BY p, node) AS s FROM n2) GROUP BY parent),
n0 AS (SELECT 'all' AS node, least(1, min(s)) AS p FROM (SELECT p * count(*) OVER () / row_number() OVER (ORDER BY p, node) AS s FROM n1))"""


@register("tree_combined_p", f"WITH {_T} SELECT node, round(p, 9) AS p FROM n0 UNION ALL " + " UNION ALL ".join(f"SELECT node, round(p, 9) FROM n{i}" for i in range(1, 5)))
def _combined(spark, d):
    return combine_bottom_up(*_tree(spark, d)).select("node", F.round("p", 9).alias("p"))


@register("tree_rejections", f"WITH {_T}, g0 AS (SELECT 'all' AS node, 1.0::DOUBLE AS gamma),\n" + ",\n".join(
    f"f{i} AS (SELECT n.node, n.parent, n.p, g.gamma, count(*) OVER (PARTITION BY n.parent) AS m, row_number() OVER (PARTITION BY n.parent ORDER BY n.p, n.node) AS r FROM n{i} n JOIN g{i - 1} g ON g.node = n.parent),\n"
    f"r{i} AS (SELECT f.node, f.parent, f.gamma, f.m FROM f{i} f JOIN (SELECT parent, max(p) AS cut FROM f{i} WHERE p <= 0.3 * gamma * r / m GROUP BY parent) c ON c.parent = f.parent AND f.p <= c.cut),\n"
    f"g{i} AS (SELECT node, gamma * (count(*) OVER (PARTITION BY parent) / m::DOUBLE) AS gamma FROM r{i})"
    for i in range(1, 5)
) + " " + " UNION ALL ".join(f"SELECT node, {i} AS level FROM g{i}" for i in range(1, 5)))
def _rejections(spark, d):
    edges, leaves = _tree(spark, d)
    return descend(edges, combine_bottom_up(edges, leaves), "all", 0.3)
