"""Labelled rows for training: which may be learned from, and a bounded sample of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(doc_id: Column) -> Column:
    """crc32(doc_id as text) mod 5; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def held_out(doc_id: Column) -> Column:
    return F.coalesce(remainder(doc_id) == 0, F.lit(False))


def sample(labels: DataFrame, column: str, most: int) -> DataFrame:
    """(doc_id, label, fold) of rows outside the held-out fold: per label at most `most` rows, those with the smallest hash of the id.

    Rows without an id or label are left out; an id with several labels counts as its largest.
    """
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("label"))
    rows = rows.where("doc_id IS NOT NULL AND label IN (0, 1)").groupBy("doc_id").agg(F.max("label").alias("label"))
    rows = rows.withColumn("fold", remainder(F.col("doc_id"))).where("fold <> 0")
    some = lambda label: rows.where(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return some(0).unionAll(some(1))


def one_row(rows: DataFrame, *values: str) -> DataFrame:
    """doc_id, label, fold and the values of one row for each id, that of the least values in order: rows that repeat an id do not add to a bounded sample. rows: documents joined with sample()."""
    least = F.min(F.struct(*values)).alias("__least")
    return rows.groupBy("doc_id").agg(F.first("label").alias("label"), F.first("fold").alias("fold"), least).select("doc_id", "label", "fold", "__least.*")
