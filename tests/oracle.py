"""Compares a query's rows with those of its SQL in DuckDB."""

import decimal
import glob
import os

import duckdb


def tables(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, float):
        return round(value, 9)
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return value


def rows_of(df):
    columns = sorted(df.columns)
    return columns, sorted((repr(tuple(plain(r[c]) for c in columns)) for r in df.collect()))


def rows_of_sql(con, sql):
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    columns = sorted(names)
    order = [names.index(c) for c in columns]
    return columns, sorted(repr(tuple(plain(r[i]) for i in order)) for r in found.fetchall())
