"""Streaming twins of the batch statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def running_row_stats(cells: DataFrame, n: int) -> DataFrame:
    """Per-row nnz, total, mean and deviation over a stream of cells (row_id, col_id, val); n columns, stored or not. Use output mode complete or update."""
    from ..operators.stats import moments

    return cells.groupBy("row_id").agg(*moments(n))


def windowed_counts(events: DataFrame, width: str, late: str) -> DataFrame:
    """Counts and sums per event type and time window of a stream (ts, event_type, value); rows later than `late` are dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def drain(stream: DataFrame, name: str, mode: str) -> DataFrame:
    """Runs a stream over what is available into a memory table and returns it; for tests and backfills of aggregates."""
    spark: SparkSession = stream.sparkSession
    query = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name)
