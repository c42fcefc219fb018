"""Fuzzy weights of neighbour graphs, and tests of means by flipped signs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalog import register
from ..matrix import table
from ..plans.scratch import materialize
from .clustering import matrix

_STEPS, _NEAR = 64, 1e-5


def smooth_scale(distances: Column, nearest: Column) -> Column:
    """The scale s at which sum(exp(-(d - nearest) / s)) over an array of distances is the logarithm to base 2 of their number, by bisection from 1; a thousandth of their mean at least."""
    n = F.size(distances)
    total = lambda s: F.aggregate(distances, F.lit(0.0), lambda a, d: a + F.when(d > nearest, F.exp(-(d - nearest) / s)).otherwise(1.0))
    target = F.log2(n.cast("double"))

    def step(state: Column, _: Column) -> Column:
        low, high, mid = state["low"], state["high"], state["mid"]
        here = total(mid)
        near, over = F.abs(here - target) < _NEAR, here > target
        new_low, new_high = F.when(over, low).otherwise(mid), F.when(over, mid).otherwise(high)
        new_mid = F.when(~over & (high == float("inf")), mid * 2).otherwise((new_low + new_high) / 2)
        return F.when(state["done"] | near, F.struct(low.alias("low"), high.alias("high"), mid.alias("mid"), F.lit(True).alias("done"))).otherwise(F.struct(new_low.alias("low"), new_high.alias("high"), new_mid.alias("mid"), F.lit(False).alias("done")))

    start = F.struct(F.lit(0.0).alias("low"), F.lit(float("inf")).alias("high"), F.lit(1.0).alias("mid"), F.lit(False).alias("done"))
    found = F.aggregate(F.sequence(F.lit(1), F.lit(_STEPS)), start, step, lambda s: s["mid"])
    return F.greatest(found, F.aggregate(distances, F.lit(0.0), lambda a, d: a + d) / n * 1e-3)


def fuzzy_weights(neighbours: DataFrame) -> DataFrame:
    """(u, v, weight), u < v, of every pair in which one names the other: a + b - a * b of the two directions' weights exp(-(d - nearest) / scale), 0 for a direction that is missing.

    neighbours: (query, id, distance), the k nearest of each query; self pairs go. Nearest and scale are the query's own.
    """
    known = neighbours.where("query <> id AND distance IS NOT NULL").groupBy("query", "id").agg(F.min(F.col("distance").cast("double")).alias("distance"))
    own = known.groupBy("query").agg(F.min("distance").alias("nearest"), F.array_sort(F.collect_list("distance")).alias("distances"))  # k distances
    own = own.select("query", "nearest", smooth_scale(F.col("distances"), F.col("nearest")).alias("scale"))
    gap = F.col("distance") - F.col("nearest")
    ways = known.join(own, "query").select(F.least("query", "id").alias("u"), F.greatest("query", "id").alias("v"), F.when(gap <= 0, 1.0).when(F.col("scale") <= 0, 0.0).otherwise(F.exp(-gap / F.col("scale"))).alias("w"))
    return ways.groupBy("u", "v").agg((1 - F.product(1 - F.col("w"))).alias("weight"))


_NN = "g AS (SELECT l_partkey AS q, l_suppkey AS i, min(l_extendedprice) AS distance FROM lineitem WHERE l_partkey <> l_suppkey GROUP BY ALL), n AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY q ORDER BY distance, i) <= 5)"


@register("fuzzy_weights", f"""WITH RECURSIVE {_NN}, o AS (SELECT q, min(distance) AS nearest, list(distance ORDER BY distance) AS ds FROM n GROUP BY q),
b AS (SELECT q, nearest, ds, 0.0::DOUBLE AS low, 'inf'::DOUBLE AS high, 1.0::DOUBLE AS mid, false AS done, 0 AS k FROM o
  UNION ALL SELECT q, nearest, ds, CASE WHEN done OR near OR over THEN low ELSE mid END, CASE WHEN done OR near OR NOT over THEN high ELSE mid END,
    CASE WHEN done OR near THEN mid WHEN NOT over AND high = 'inf'::DOUBLE THEN mid * 2 WHEN over THEN (low + mid) / 2 ELSE (mid + high) / 2 END, done OR near, k + 1
  FROM (SELECT *, abs(total - log2(len(ds))) < {_NEAR} AS near, total > log2(len(ds)) AS over FROM (SELECT *, list_sum(list_transform(ds, lambda d: CASE WHEN d > nearest THEN exp(-(d - nearest) / mid) ELSE 1.0 END)) AS total FROM b WHERE k < {_STEPS}))),
s AS (SELECT q, nearest, greatest(mid, list_avg(ds) * 1e-3) AS scale FROM b WHERE k = {_STEPS}),
w AS (SELECT least(n.q, n.i) AS u, greatest(n.q, n.i) AS v, CASE WHEN distance <= nearest THEN 1 ELSE exp(-(distance - nearest) / scale) END AS w FROM n JOIN s ON s.q = n.q)
SELECT u, v, round(1 - product(1 - w), 5) AS weight FROM w GROUP BY u, v""")
def _fuzzy(spark, d):
    """Weights of the graph of parts and the five suppliers nearest to them."""
    from pyspark.sql import Window

    g = table(spark, d, "lineitem").where("l_partkey <> l_suppkey").groupBy(F.col("l_partkey").alias("query"), F.col("l_suppkey").alias("id")).agg(F.min("l_extendedprice").alias("distance"))
    near = g.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy("distance", "id"))).where("r <= 5")
    return fuzzy_weights(near).select("u", "v", F.round("weight", 5).alias("weight"))


def flips(ids: np.ndarray, draws: int, seed: int) -> np.ndarray:
    """Signs of 1 and -1 for each row (hashed ids) and draw, bits of a hash of both."""
    words = -(-draws // 64)
    with np.errstate(over="ignore"):
        h = ids.view(np.uint64)[:, None] + (np.arange(1, words + 1, dtype=np.uint64) + np.uint64(seed) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
        for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            h = (h ^ (h >> np.uint64(shift))) * np.uint64(by)
        h ^= h >> np.uint64(31)
    bits = np.unpackbits(h.view(np.uint8).reshape(len(ids), -1), axis=1, bitorder="little")[:, :draws]
    return bits.astype(np.float64) * 2 - 1


#: Rows of a group that one task sums, on average.
SHARE = 2_000_000


def sign_flip_pvalues(df: DataFrame, group: str, draws: int = 1000, seed: int = 0) -> DataFrame:
    """(group, n, mean, p): two-sided p-values of a mean of 0: one more than the draws of random signs whose mean is as far from 0, over one more than the draws. df: (group, id, x); rows without x are left out.

    A row's signs come from a hash of its id, so sums are additive. Rows are shuffled, not arrays of draws: a task sums the groups that
    it was dealt, one after the other; a group of more than SHARE rows is dealt to several, whose arrays are added up.
    """
    kind = dict(df.dtypes)[group]
    rows = df.where(F.col("x").isNotNull()).select(F.col(group).alias("__g"), F.xxhash64(F.lit(seed), "id").alias("h"), F.col("x").cast("double").alias("x"))
    schema = f"__g {kind}, n long, total double, sums array<double>"

    def run(batches):
        # Rows of one share of a group follow one another.
        held = None

        def out(parts: list) -> pa.RecordBatch:
            g, n, total, sums = zip(*parts)
            return pa.record_batch([pa.array(g, names), pa.array(n, pa.int64()), pa.array(total, pa.float64()), pa.array(sums, pa.list_(pa.float64()))], names=["__g", "n", "total", "sums"])

        for batch in batches:
            if not batch.num_rows:
                continue
            names = batch.column(0).type
            coded = batch.column(0).dictionary_encode()
            at = coded.indices.fill_null(len(coded.dictionary)).to_numpy(zero_copy_only=False)
            share, x = batch.column(1).to_numpy(), batch.column(3).to_numpy()
            first = np.flatnonzero((np.diff(at, prepend=-1) != 0) | (np.diff(share, prepend=-1) != 0))
            sums = np.add.reduceat(x[:, None] * flips(batch.column(2).to_numpy(), draws, seed), first, axis=0)
            keys = list(zip(batch.column(0).take(pa.array(first)).to_pylist(), share[first].tolist()))
            found = [[k[0], n, t, v] for k, n, t, v in zip(keys, np.diff([*first, len(x)]).tolist(), np.add.reduceat(x, first).tolist(), sums)]
            if held is not None and held[0] == keys[0]:
                found[0] = [keys[0][0], *(a + b for a, b in zip(held[1][1:], found[0][1:]))]
            elif held is not None:
                yield out([held[1]])
            held = keys[-1], found[-1]
            if len(found) > 1:
                yield out(found[:-1])
        if held is not None:
            yield out([held[1]])

    def add(part: pa.Table) -> pa.Table:
        sums = matrix(part.column("sums").combine_chunks()).sum(axis=0)
        return pa.table({"__g": part.column("__g")[:1], "n": pa.array([pa.compute.sum(part.column("n")).as_py()]), "total": pa.array([pa.compute.sum(part.column("total")).as_py()]), "sums": pa.array([sums.tolist()], pa.list_(pa.float64()))})

    def summed(some: DataFrame) -> DataFrame:
        dealt = some.select("__g", "share", "h", "x").repartition("__g", "share").sortWithinPartitions("__g", "share")
        return dealt.mapInArrow(run, schema)

    crowds = rows.groupBy("__g").agg(F.ceil(F.count("*") / SHARE).cast("int").alias("shares")).where("shares > 1")
    crowds = materialize(crowds.withColumnRenamed("__g", "__c"), "crowds")
    if crowds.isEmpty():
        found = summed(rows.withColumn("share", F.lit(0)))
    else:
        rows = rows.join(F.broadcast(crowds), F.col("__g").eqNullSafe(F.col("__c")), "left").withColumn("share", F.coalesce(F.pmod(F.xxhash64("h"), F.col("shares")), F.lit(0)).cast("int"))
        found = summed(rows.where("shares IS NULL")).unionAll(summed(rows.where("shares > 1")).groupBy("__g").applyInArrow(add, schema))
    # Sums of the same numbers in another order differ in the last bits.
    far = F.size(F.filter("sums", lambda s: F.abs(s) >= F.abs(F.col("total")) - 1e-9 * F.abs(F.col("total"))))
    return found.select(F.col("__g").alias(group), "n", (F.col("total") / F.col("n")).alias("mean"), ((far + 1) / F.lit(draws + 1.0)).alias("p"))


@register("sign_flip_pvalues")
def _flips(spark, d):
    """Whether a supplier's discounts lie around the middle of their range."""
    l = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("grp"), F.concat_ws(":", "l_orderkey", "l_linenumber", "l_partkey").alias("id"), (F.col("l_discount") - 0.05).alias("x"))
    return sign_flip_pvalues(l, "grp", 500, 3).select("grp", "n", F.round("mean", 9).alias("mean"), F.round("p", 9).alias("p"))
