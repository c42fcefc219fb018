"""Random projections of columns, singular vectors and sign codes.

The basis of a projection is implicit: its entries are signs, read off a hash of seed and
feature, so a projection is one aggregate over cells and nothing is broadcast. A matrix is
multiplied by a tall table of vectors in joins and sums by key; tall tables are made
orthonormal by a tree of QR steps, whose triangles of k by k numbers alone reach the driver.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..catalog import register
from ..matrix import X, part_by_order, table
from ..plans.scratch import materialize
from .clustering import matrix

#: Signs that one hash gives.
_SIGNS = 60
#: Sums of vectors that a task holds before it passes them on.
_HELD = 100_000


def _word(key: Column, seed: int, i: int) -> Column:
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(str(i)), key.cast("string"))), 1, 15), 16, 10).cast("long")


def _bit(word: Column, k: int) -> Column:
    return F.shiftright(word, k % _SIGNS).bitwiseAND(1) * 2 - 1


def sign(key: Column, seed: int, k: int) -> Column:
    """The k-th entry of the key's row of the basis: 1 or -1."""
    return _bit(_word(key, seed, k // _SIGNS), k)


@F.arrow_udf(DoubleType())
def ln(x: pa.Array) -> pa.Array:
    """The C library's natural logarithm, whose last bit the JVM's own does not always share; null where there is none."""
    known = x.dictionary_encode()
    logs = pa.array([math.log(v) if v is not None and v > 0 else None for v in known.dictionary.to_pylist()], pa.float64())
    return logs.take(known.indices)


def project_columns(cells: DataFrame, dims: int, seed: int = 1, weights: DataFrame | None = None, batches: DataFrame | None = None, clip: float = 4.0) -> DataFrame:
    """(col_id, vector): the columns of ln(1 + val), each scaled to length 1, times a basis of random signs; centred in each batch (col_id, batch) if given, scaled per column to mean 0 and variance 1, and clipped.

    weights: (row_id, weight) of the basis' rows; rows of weight 0 or without one count nothing. Columns without cells have no vector.
    A column of any number of cells is summed in parts before the shuffle. A column whose sums agree in all dimensions has no
    variance but that of rounding, by which it is divided if there is any: hence the logarithm of the C library, as in SQL.
    """
    value = F.col("__ln")
    weight = F.lit(1.0)
    if weights is not None:
        cells, weight = cells.join(weights, "row_id"), F.col("weight")
    words = [_word(F.col("row_id"), seed, i).alias(f"__w{i}") for i in range(-(-dims // _SIGNS))]
    cells = cells.select("col_id", ln(1 + F.col("val").cast("double")).alias("__ln"), weight.alias("weight"), *words)
    signs = [F.sum(value * F.col("weight") * _bit(F.col(f"__w{k // _SIGNS}"), k)).alias(f"s{k}") for k in range(dims)]
    norm = F.greatest(F.sqrt(F.sum(value * value)), F.lit(1e-8)).alias("norm")
    out = cells.groupBy("col_id").agg(norm, *signs)
    out = out.select("col_id", F.array(*(F.col(f"s{k}") / F.col("norm") for k in range(dims))).alias("vector"))
    if batches is not None:
        known = materialize(out.join(batches.select("col_id", "batch"), "col_id"), "projected")
        means = known.groupBy("batch").agg(F.array(*(F.avg(F.col("vector")[k]) for k in range(dims))).alias("__mean"))
        out = known.join(means, "batch").select("col_id", F.zip_with("vector", "__mean", lambda x, m: x - m).alias("vector"))
    # Mean and spread stand beside the vector, once a row: inside a lambda they would be worked out again for every element.
    mean = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x) / dims
    out = out.select("col_id", F.zip_with("vector", F.array_repeat(mean, dims), lambda x, m: x - m).alias("__apart"))
    spread = F.sqrt(F.aggregate("__apart", F.lit(0.0), lambda s, x: s + x * x) / dims)
    spread = F.array_repeat(F.coalesce(F.nullif(spread, F.lit(0.0)), F.lit(1.0)), dims)
    return out.select("col_id", F.zip_with("__apart", spread, lambda x, s: F.greatest(F.lit(-clip), F.least(F.lit(clip), x / s))).alias("vector"))


def triangle(rows: DataFrame) -> np.ndarray:
    """The k by k triangle R of a tall table's QR, by a tree: a triangle for each task, then for each of at most 64 groups of these, then one. rows: (id, vector)."""

    def reduced(blocks: list[np.ndarray]) -> np.ndarray:
        return np.linalg.qr(np.concatenate(blocks), mode="r")

    def leaf(batches):
        held = None
        for batch in batches:
            if batch.num_rows:
                held = reduced([matrix(batch.column(0))] if held is None else [held, matrix(batch.column(0))])
        if held is not None:
            yield pa.record_batch([pa.array(range(len(held)), pa.int32()), pa.array(list(held), pa.list_(pa.float64()))], names=["i", "r"])

    def join(part: pa.Table) -> pa.Table:
        r = reduced([matrix(part.column("r").combine_chunks())])
        return pa.table({"i": pa.array(range(len(r)), pa.int32()), "r": pa.array(list(r), pa.list_(pa.float64()))})

    leaves = rows.select("vector").mapInArrow(leaf, "i int, r array<double>").withColumn("g", F.pmod(F.spark_partition_id(), F.lit(64)))
    tops = leaves.groupBy("g").applyInArrow(lambda t: join(t.select(["i", "r"])), "i int, r array<double>").toArrow()
    return np.linalg.qr(matrix(tops.column("r").combine_chunks()), mode="r") if tops.num_rows else np.zeros((0, 0))


def rotated(rows: DataFrame, by: np.ndarray) -> DataFrame:
    """(id, vector): the vectors times a small matrix."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.record_batch([batch.column(0), pa.array(list(matrix(batch.column(1)) @ by), pa.list_(pa.float64()))], names=["id", "vector"])

    return rows.select("id", "vector").mapInArrow(run, f"id {dict(rows.dtypes)['id']}, vector array<double>")


def orthonormal(rows: DataFrame, name: str, rank: int | None = None) -> DataFrame:
    """An orthonormal basis of the columns of a tall table, as many as are independent, written. rows: materialised."""
    _, s, vt = np.linalg.svd(triangle(rows))
    keep = int((s > 1e-10 * s[0]).sum()) if len(s) and s[0] > 0 else 0
    return materialize(rotated(rows, vt[: min(keep, rank or keep)].T / s[: min(keep, rank or keep)]), name)


def tall_svd(rows: DataFrame, rank: int) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """(left vectors (id, vector), singular values, right vectors) of a tall table: exact, by one QR and one pass. The largest component of a right vector is positive. rows: materialised."""
    _, s, vt = np.linalg.svd(triangle(rows), full_matrices=False)
    keep = min(rank, int((s > 1e-10 * s[0]).sum()) if len(s) and s[0] > 0 else 0)
    v = vt[:keep].T
    v = v * np.where(v[np.abs(v).argmax(axis=0), np.arange(keep)] < 0, -1.0, 1.0)
    return rotated(rows, v / s[:keep]), s[:keep], v


def multiplied(cells: DataFrame, side: DataFrame, key: str, to: str) -> DataFrame:
    """(id, vector): for each `to` the sum of val * vector over its cells, the vectors found by `key`. Sums are begun in each task before the shuffle."""

    def run(batches):
        held, totals = {}, None
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, at = np.unique(batch.column(0).to_numpy(), return_inverse=True)
            part = np.zeros((len(ids), len(batch.column(2)[0])))
            np.add.at(part, at, batch.column(1).to_numpy()[:, None] * matrix(batch.column(2)))
            for i, row in zip(ids.tolist(), part):
                if i in held:
                    held[i] += row
                else:
                    held[i] = row
            if len(held) >= _HELD:
                yield out(held)
                held = {}
        if held:
            yield out(held)

    def out(held: dict) -> pa.RecordBatch:
        return pa.record_batch([pa.array(list(held), pa.int64()), pa.array(list(held.values()), pa.list_(pa.float64()))], names=["id", "vector"])

    def add(batches):
        # Rows of one id follow one another.
        last, total = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, x = batch.column(0).to_numpy(), matrix(batch.column(1))
            first = np.flatnonzero(np.diff(ids, prepend=ids[0] - 1))
            sums, names = np.add.reduceat(x, first, axis=0), ids[first]
            if last == names[0]:
                sums[0] += total
            elif last is not None:
                yield out({last: total})
            if len(names) > 1:
                yield out(dict(zip(names[:-1].tolist(), sums[:-1])))
            last, total = int(names[-1]), sums[-1]
        if last is not None:
            yield out({last: total})

    joined = cells.join(side.withColumnRenamed("id", key), key).select(F.col(to).cast("long").alias("id"), F.col("val").cast("double").alias("val"), "vector")
    parts = joined.mapInArrow(run, "id long, vector array<double>")
    return parts.repartition("id").sortWithinPartitions("id").mapInArrow(add, "id long, vector array<double>")


def rsvd(cells: DataFrame, rank: int, seed: int = 1, oversample: int = 5, rounds: int = 5) -> tuple[DataFrame, np.ndarray, DataFrame]:
    """(row vectors (id, vector), singular values, column vectors (id, vector)) of a matrix of cells (row_id, col_id, val), by randomised subspace iteration.

    Rows and columns without cells have no vector (theirs is zero). As many values as the matrix has, `rank` at most.
    """
    wide = rank + oversample
    start = cells.select(F.col("col_id").cast("long").alias("id")).distinct().select("id", F.array(*(sign(F.col("id"), seed, k).cast("double") for k in range(wide))).alias("vector"))
    side = materialize(start, "start")
    if side.isEmpty():
        return side.where("false"), np.zeros(0), side
    left = orthonormal(materialize(multiplied(cells, side, "col_id", "row_id"), "product"), "left")
    for _ in range(rounds - 1):
        right = orthonormal(materialize(multiplied(cells, left, "row_id", "col_id"), "product"), "right")
        left = orthonormal(materialize(multiplied(cells, right, "col_id", "row_id"), "product"), "left")
    right = materialize(multiplied(cells, left, "row_id", "col_id"), "product")
    v, s, u = tall_svd(right, rank)
    return rotated(left, u), s, v


def sign_codes(rows: DataFrame, k: int) -> DataFrame:
    """(id, code): bit j is set where the j-th left singular vector, centred, is positive: columns fall into at most 2**k groups. rows: (id, vector), materialised."""
    left, s, _ = tall_svd(rows, k)
    left = materialize(left, "singular")
    if not len(s):
        return rows.select("id", F.lit(0).cast("long").alias("code"))
    means = left.agg(*(F.avg(F.col("vector")[j]).alias(f"m{j}") for j in range(len(s)))).first()
    bit = [F.when(F.col("vector")[j] - means[j] > 0, 1 << j).otherwise(0) for j in range(len(s))]
    code = bit[0]
    for b in bit[1:]:
        code = code + b
    return left.select("id", code.cast("long").alias("code"))


_DIMS = 6


@register("project_columns", f"""WITH {X}, h AS (SELECT p_partkey AS row_id, ('0x' || substr(md5('1:0:' || p_partkey), 1, 15))::BIGINT AS w FROM part),
s AS (SELECT col_id, greatest(sqrt(sum(ln(1 + val) ** 2)), 1e-8) AS norm, {', '.join(f"sum(ln(1 + val) * (((w >> {k}) & 1) * 2 - 1)) AS s{k}" for k in range(_DIMS))} FROM x JOIN h USING (row_id) GROUP BY 1),
v AS (SELECT col_id, [{', '.join(f's{k} / norm' for k in range(_DIMS))}] AS v FROM s), m AS (SELECT col_id, v, list_sum(v) / {_DIMS} AS mu FROM v),
p AS (SELECT col_id, v, mu, sqrt(list_sum(list_transform(v, lambda z: (z - mu) ** 2)) / {_DIMS}) AS sd FROM m)
SELECT col_id, {', '.join(f"round(greatest(-4, least(4, (v[{k + 1}] - mu) / CASE WHEN sd > 0 THEN sd ELSE 1 END)), 6) + 0.0::DOUBLE AS v{k}" for k in range(_DIMS))} FROM p""")
def _project(spark, d):
    """Orders as random projections of their parts."""
    p = project_columns(part_by_order(spark, d).cells, _DIMS)
    return p.select("col_id", *((F.round(F.col("vector")[k], 6) + 0.0).alias(f"v{k}") for k in range(_DIMS)))


@register("projection_codes")
def _codes(spark, d):
    """Orders grouped by the signs of the leading singular vectors of their projections."""
    rows = materialize(project_columns(part_by_order(spark, d).cells, 10).withColumnRenamed("col_id", "id"), "projected")
    return sign_codes(rows, 4).withColumnRenamed("id", "col_id")


@register("matrix_rsvd")
def _rsvd(spark, d):
    """The suppliers' coordinates on the leading singular vectors of quantities by brand."""
    l = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("p_partkey") == F.col("l_partkey"))
    cells = l.groupBy(F.col("l_suppkey").alias("row_id"), F.crc32("p_brand").alias("col_id")).agg(F.sum("l_quantity").alias("val"))
    u, s, _ = rsvd(materialize(cells, "cells"), 5)
    return u.select(F.col("id").alias("row_id"), F.explode(F.arrays_zip("vector", F.array(*(F.lit(float(x)) for x in s)).alias("values"))).alias("x")).select("row_id", F.round("x.vector", 6).alias("coordinate"), F.round("x.values", 6).alias("singular_value"))
