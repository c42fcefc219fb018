"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import forget, materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges: (u, v) with u > v. Joins each vertex's neighbours to their smallest: the larger neighbours (large) or the smaller ones and the vertex itself."""
    if large:
        around = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        around = edges
    least = around.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
    moved = around.join(least, F.col("u") == F.col("w"))
    if large:
        out = moved.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select(F.col("w").alias("u"), F.col("m").alias("v")))
    return out.where("u > v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges: (a, b), longs, in any direction. Returns (vertex, component), the smallest vertex reachable, for each vertex with an edge to another.

    Nulls and self-loops are no edges; repeated edges count once; an empty table gives no rows.
    """
    edges = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = materialize(edges, "edges")
    before = None
    while True:
        old, edges = edges, materialize(_star(_star(edges, True), False), "edges")
        forget(old)
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.max("v")).first()
        if state[0] == 0 or state == before:
            break
        before = state
    return edges.select(F.col("u").alias("vertex"), F.col("v").alias("component")).unionAll(edges.select(F.col("v"), F.col("v")).distinct())
