"""Sparse matrices as coordinate tables: cells(row_id, col_id, val) beside dimensions that know the empty rows and columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .plans.spread import spread


@dataclass
class Matrix:
    """cells: (row_id, col_id, val), one row per stored entry. features: (row_id, name). samples: (col_id, name). most: no more cells than this, where known."""

    cells: DataFrame
    features: DataFrame
    samples: DataFrame
    most: int | None = None

    def dealt(self, df: DataFrame, *keys: str) -> DataFrame:
        """df, with no more rows than there are cells, in tasks of a bounded number of rows; as it is where the number is not known."""
        return df if self.most is None else spread(df, self.most, *keys)

    @property
    def n_rows(self) -> int:
        return self.features.count()

    @property
    def n_cols(self) -> int:
        return self.samples.count()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def part_by_order(spark: SparkSession, sf_dir: str) -> Matrix:
    """The test binding: quantities of parts (features) in orders (samples), repeated pairs summed. Hardly a pair repeats, so lines are dealt by order, and joins and sums by column need no other shuffle."""
    lines = table(spark, sf_dir, "lineitem")
    most = lines.count()
    dealt = spread(lines.select(F.col("l_partkey").alias("row_id"), F.col("l_orderkey").alias("col_id"), "l_quantity"), most, "col_id")
    cells = dealt.groupBy("row_id", "col_id").agg(F.sum("l_quantity").alias("val"))
    features = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("row_id"), F.col("p_name").alias("name"))
    samples = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("col_id"), F.col("o_orderkey").cast("string").alias("name"))
    return Matrix(cells, features, samples, most)


#: The same binding for DuckDB.
X = "x AS (SELECT l_partkey AS row_id, l_orderkey AS col_id, sum(l_quantity) AS val FROM lineitem GROUP BY ALL)"
