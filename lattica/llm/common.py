"""What the operators share: reading tables, durable intermediate tables, id filters."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.scratch import forget, materialize  # noqa: F401

#: Rows handed to a Python worker at once; documents may be long, so far fewer than Spark's 10,000.
ARROW_ROWS = 1000

#: A set of ids is broadcast only if it has at most this many rows (8 bytes each); beyond it, the join shuffles.
BROADCAST_IDS = 2_000_000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def prepare(spark: SparkSession) -> None:
    """Bounds the rows of a Python batch, unless the session already asks for fewer, and lets workers on this machine import the package from where the driver has it."""
    root = str(Path(__file__).resolve().parents[2])
    environment = spark.sparkContext.environment
    if root not in environment.get("PYTHONPATH", "").split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(filter(None, [environment.get("PYTHONPATH"), root]))
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))


def per_batch(fn: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch] | pa.RecordBatch | None]) -> Callable:
    """mapInArrow function that applies fn to each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = fn(batch)
            if isinstance(out, pa.RecordBatch):
                yield out
            elif out is not None:
                yield from out

    return run


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str | None]:
    return batch.column(batch.schema.get_field_index(column)).to_pylist()


def ids(batch: pa.RecordBatch, column: str = "doc_id") -> pa.Array:
    return batch.column(batch.schema.get_field_index(column))


def fresh(taken: list[str], name: str) -> str:
    """name, with underscores after it until no column is called so, in any letter case."""
    lower = {c.lower() for c in taken}
    while name in lower:
        name += "_"
    return name


def documents(docs: DataFrame) -> DataFrame:
    """doc_id as long and text as string; other columns are not read."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def keep_ids(docs: DataFrame, wanted: DataFrame, how: str = "left_semi", bound: int = BROADCAST_IDS) -> DataFrame:
    """Semi or anti join of docs with a table of doc_id. wanted is counted first (it should be materialised): a small one is broadcast, a large one joined by a shuffle."""
    key = "__keep_id"
    wanted = wanted.select(F.col("doc_id").alias(key))
    if wanted.count() <= bound:
        wanted = F.broadcast(wanted)
    return docs.join(wanted, docs["doc_id"] == wanted[key], how)


def with_ids(docs: DataFrame, rows: DataFrame, bound: int = BROADCAST_IDS) -> DataFrame:
    """docs joined with the rows of a materialised table by doc_id. Where these are few, a broadcast of their ids keeps the texts of other documents out of the shuffle."""
    if rows.count() <= bound:
        docs = keep_ids(docs, rows.select("doc_id").distinct())
    return docs.join(rows, "doc_id")
