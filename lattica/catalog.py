"""The registered queries: name -> (callable on (spark, sf_dir), DuckDB SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
#: Modules whose import registers queries.
MODULES = ("stats", "qc", "names", "align", "windows", "intervals", "graph", "genetics", "annotate", "access", "evidence", "hmm", "clustering", "tree", "paths", "projection", "communities", "neighbours", "droplets", "gene_index", "collapse", "agglomerate", "mixtures", "kernels")
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def load() -> None:
    """Imports the modules that register queries."""
    from importlib import import_module

    for name in MODULES:
        import_module(f"lattica.operators.{name}")
