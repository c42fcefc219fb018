"""Shuffles into as many tasks as the rows ask for, where a session's number of partitions would let tasks grow with the data."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Rows of a task, on average.
TASK_ROWS = 250_000


def spread(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """df dealt by its keys into tasks of about TASK_ROWS rows, no fewer than the cluster runs at once. Groups and joins by these keys follow without another shuffle, and so without sums begun before it."""
    least = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(least, -(-rows // TASK_ROWS)), *keys)
