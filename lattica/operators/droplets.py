"""Calling columns whose counts are unlike the ambient ones (empty droplets).

The ambient profile is the sum of a window of low-count columns, smoothed by simple
Good-Turing. All features of one ambient count share one probability, so the profile is a
table of classes, one for each distinct count, which is small however many features there
are. Null likelihoods come from paths of draws: one path, read off at every total that a
column has, serves all of them. Paths are dealt over tasks and met by columns of the same
totals; columns of a common total are split.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import register
from ..matrix import part_by_order
from ..plans.ranking import global_position
from ..plans.scratch import broadcast_small, materialize
from .qc import call_columns_ordmag
from .windows import benjamini_hochberg

#: Totals whose null values travel together, and columns of these in a task, on average.
TOTALS, COLUMNS = 32, 100_000


def good_turing(counts: np.ndarray, sizes: np.ndarray, unseen: int) -> np.ndarray:
    """The probability of one feature of each class, the unseen ones first: sizes[i] features have counts[i] > 0, rising; unseen have none.

    Simple Good-Turing: counts are moved to Turing's estimate while that differs significantly from the one on the
    fitted line of log frequency by log count, and to the line's from there on; unseen features share the mass
    of the singletons. Where this gives no positive finite probabilities, one is added to each count.
    """
    counts, sizes = counts.astype(float), sizes.astype(float)
    total, features = float((counts * sizes).sum()), float(sizes.sum() + unseen)
    if total <= 0:
        return np.array([1 / max(features, 1)])
    single = float(sizes[counts == 1].sum())
    reserve = single / total if unseen else 0.0
    moved = np.full(len(counts), np.nan)
    if len(counts) > 1:
        left = np.concatenate([[0.0], counts[:-1]])
        right = np.concatenate([counts[1:], [2 * counts[-1] - left[-1]]])
        slope, _ = np.polyfit(np.log(counts), np.log(2 * sizes / (right - left)), 1)
        line = (counts + 1) * np.exp(slope * (np.log(counts + 1) - np.log(counts)))
        follows = np.concatenate([np.diff(counts) == 1, [False]])
        above = np.where(follows, np.concatenate([sizes[1:], [0.0]]), 0.0)
        turing = (counts + 1) * above / sizes
        error = np.sqrt((counts + 1) ** 2 * above / sizes**2 * (1 + above / sizes))
        on_line = np.logical_or.accumulate(~follows | (np.abs(turing - line) <= 1.96 * error))
        moved = np.where(on_line, line, turing)
    if np.isfinite(moved).all() and (moved > 0).all():
        seen = moved * (1 - reserve) / (moved * sizes).sum()
        none = reserve / unseen if unseen else 0.0
    else:
        seen, none = (counts + 1) / (total + features), 1 / (total + features)
    p = np.maximum(np.nan_to_num(np.concatenate([[none], seen])), 1e-12 / features)
    return p / (p * np.concatenate([[unseen], sizes])).sum()


def path(seed: int, draw: int, p: np.ndarray, sizes: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """The running log-likelihood of one path of draws from the profile, at each of the rising totals."""
    rng = np.random.default_rng([seed, draw])
    mass = np.cumsum(p * sizes)
    classes = np.minimum(np.searchsorted(mass, rng.random(int(totals[-1])) * mass[-1], "right"), len(p) - 1)
    return np.cumsum(np.log(p)[classes])[totals - 1]


def empty_drops(cells: DataFrame, features: int, expected: int, quantile: float = 0.99, fraction: float = 0.1, window: tuple[int, int] = (45_000, 90_000), least: int = 500, draws: int = 10_000, fdr: float = 0.01, seed: int = 0) -> DataFrame:
    """(col_id, tot, p, q): columns at or above the knee (p and q null), and those from `least` up to it whose likelihood under the ambient profile is low at this false discovery rate.

    cells: (row_id, col_id, val), whole counts; features: how many rows the matrix has. The ambient window is of ranks by
    falling total, ties by col_id. Where it is empty or without counts, only the knee counts.
    """
    spark = cells.sparkSession
    cells = materialize(cells.where("val > 0"), "cells")
    stats = materialize(column_stats_of(cells), "totals")
    called = materialize(call_columns_ordmag(stats, expected, quantile, fraction), "knee")
    knee = called.withColumns({"p": F.lit(None).cast("double"), "q": F.lit(None).cast("double")})
    ranked = global_position(stats.withColumn("__down", -F.col("tot")), "__down", "col_id")
    low = ranked.where((F.col("position") > window[0]) & (F.col("position") <= window[1])).select("col_id")
    ambient = materialize(cells.join(low, "col_id", "left_semi").groupBy("row_id").agg(F.sum(F.round("val")).cast("long").alias("c")).where("c > 0"), "ambient")
    classes = ambient.groupBy("c").agg(F.count("*").alias("n")).orderBy("c").toArrow()  # at most the root of twice the ambient total
    if not classes.num_rows:
        return knee
    counts, sizes = classes.column("c").to_numpy(), classes.column("n").to_numpy()
    unseen = max(0, features - int(sizes.sum()))
    p, sizes = good_turing(counts, sizes, unseen), np.concatenate([[unseen], sizes])
    below = stats.join(called.select("col_id"), "col_id", "left_anti").where(F.col("tot") >= least)
    log_p = broadcast_small(spark.createDataFrame([(int(c), float(x)) for c, x in zip([0, *counts], np.log(p))], "c long, log_p double"))
    rows = cells.join(below.select("col_id"), "col_id", "left_semi").join(ambient, "row_id", "left").withColumn("c", F.coalesce("c", F.lit(0).cast("long")))
    seen = rows.join(log_p, "c").groupBy("col_id").agg(F.sum(F.col("val") * F.col("log_p")).alias("obs"))
    asked = materialize(below.join(seen, "col_id").select("col_id", "tot", F.greatest(F.round("tot").cast("long"), F.lit(1).cast("long")).alias("t"), "obs"), "asked")
    if asked.isEmpty():
        return knee
    totals = np.array([r.t for r in asked.select("t").distinct().orderBy("t").collect()])  # below the knee, so few
    blocks = -(-len(totals) // TOTALS)

    def walk(batches):
        for batch in batches:
            for draw in batch.column(0).to_pylist():
                at = path(seed, draw, p, sizes, totals)
                yield pa.record_batch([pa.array(np.arange(blocks, dtype=np.int64)), pa.array([at[i : i + TOTALS] for i in range(0, len(at), TOTALS)], pa.list_(pa.float64()))], names=["block", "null"])

    nulls = materialize(spark.range(0, draws, numPartitions=max(1, min(draws // 50, 4 * spark.sparkContext.defaultParallelism))).mapInArrow(walk, "block long, null array<double>"), "nulls")
    slots = broadcast_small(spark.createDataFrame([(int(t), i // TOTALS, i % TOTALS) for i, t in enumerate(totals)], "t long, block long, slot long"))
    placed = materialize(asked.join(slots, "t"), "placed")
    crowds = broadcast_small(placed.groupBy("block").agg(F.ceil(F.count("*") / COLUMNS).cast("long").alias("shares")))
    placed = placed.join(crowds, "block").withColumn("share", F.pmod(F.xxhash64("col_id"), F.col("shares")))
    copied = nulls.join(crowds, "block").withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1)))

    def compare(column: pa.Table, null: pa.Table) -> pa.Table:
        values = np.sort(np.stack(null.column("null").to_numpy()), axis=0)
        obs, slot = column.column("obs").to_numpy(), column.column("slot").to_numpy()
        le = np.zeros(len(obs), dtype=np.int64)
        for s in np.unique(slot).tolist():
            le[slot == s] = np.searchsorted(values[:, s], obs[slot == s], "right")
        return pa.table({"col_id": column.column("col_id"), "tot": column.column("tot"), "p": pa.array((1.0 + le) / (len(values) + 1.0))})

    kinds = dict(asked.dtypes)
    tested = placed.select("block", "share", "slot", "col_id", "tot", "obs").groupBy("block", "share").cogroup(copied.select("block", "share", "null").groupBy("block", "share"))
    tested = materialize(tested.applyInArrow(compare, f"col_id {kinds['col_id']}, tot {kinds['tot']}, p double"), "tested")
    found = benjamini_hochberg(tested, "p", "col_id").where(F.col("q") < fdr)
    return knee.select("col_id", "tot", "p", "q").unionByName(found.select("col_id", "tot", "p", "q"))


def column_stats_of(cells: DataFrame) -> DataFrame:
    return cells.groupBy("col_id").agg(F.sum("val").alias("tot"))


@register("qc_empty_drops")
def _empty_drops(spark, d):
    """Orders unlike the smaller ones in what they hold."""
    m = part_by_order(spark, d)
    found = empty_drops(m.cells, m.n_rows, 300, 0.99, 0.8, (m.n_cols // 2, m.n_cols), 60, 500, 0.2, 7)
    return found.select("col_id", "tot", F.round("p", 9).alias("p"), F.round("q", 9).alias("q"))
