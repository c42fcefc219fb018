"""Positions and running aggregates over a whole table or its groups, without a window in one task.

Rows are dealt by range of (group, order) into as many buckets as they need, which are
written with their number. Windows run inside (bucket, group); what a bucket's part of a
group takes over from earlier buckets is a prefix of the parts' own sums and extremes. At
every border between buckets one group at most is cut, so no more than two rows a bucket
carry over, however many groups there are, and a group with most of all rows is worked on
by as many tasks as it fills buckets. Equal values are split by the tie columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import forget, materialize

#: Rows of a bucket at most, on average, and least that are worth one.
MOST, LEAST = 4_000_000, 10_000
_KINDS = {"sum": F.sum, "min": F.min, "max": F.max}


def _sorted(order, reverse: bool = False) -> list[Column]:
    """Columns of an order in which a name after a minus descends; reversed on demand, nulls included."""
    return [F.desc(c.removeprefix("-")) if c.startswith("-") != reverse else F.asc(c.removeprefix("-")) for c in order]


def ranged(df: DataFrame, *order: str, most: int | None = None) -> DataFrame:
    """df with __bucket, rising with the order (nulls first), of at most so many rows (MOST) on average. df is computed once and written, then counted, sampled and dealt from that table."""
    df = materialize(df, "unsorted")
    n, most = df.count(), most or MOST
    parts = max(min(df.sparkSession.sparkContext.defaultParallelism, n // LEAST), -(-n // most), 1)
    out = materialize(df.repartitionByRange(parts, *_sorted(order)).withColumn("__bucket", F.spark_partition_id()), "ranged")
    forget(df)
    return out


def running(rows: DataFrame, group: list[str], order: list[str], measures: dict[str, tuple[str, Column]], totals: dict[str, tuple[str, Column]] | None = None, reverse: bool = False, before: bool = False) -> DataFrame:
    """Rows of ranged(df, *group, *order) with running measures and totals of their group.

    measures, totals: name -> (sum, min or max, expression). A measure covers the rows of the
    group up to this one in the order (reverse: from this one on), without this one if before.
    Sums of nothing are 0, extremes of nothing null. Rows may have several columns of the
    order only if these were given to ranged() in the same order.
    """
    totals, keys = totals or {}, ["__bucket", *group]
    names = {n: f"__c{i}" for i, n in enumerate([*measures, *totals])}
    parts = rows.groupBy(*keys).agg(*(_KINDS[k](e).alias(names[n]) for n, (k, e) in {**measures, **totals}.items()))
    whole = Window.partitionBy(*group)
    earlier = whole.orderBy(F.desc("__bucket") if reverse else F.asc("__bucket")).rowsBetween(Window.unboundedPreceding, -1)
    carry = parts.select(
        *(F.col(c).alias(f"__k{i}") for i, c in enumerate(keys)),
        *(_KINDS[k](names[n]).over(earlier).alias(names[n]) for n, (k, _) in measures.items()),
        *(_KINDS[k](names[n]).over(whole).alias(names[n]) for n, (k, _) in totals.items()),
        F.count("*").over(whole).alias("__parts"),
    ).where("__parts > 1")  # at most two rows a bucket
    same = F.lit(True)
    for i, c in enumerate(keys):
        same &= F.col(c).eqNullSafe(F.col(f"__k{i}"))
    out = rows.join(F.broadcast(carry), same, "left")
    alone = Window.partitionBy(*keys)
    inside = alone.orderBy(*_sorted(order, reverse)).rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    add = {}
    for n, (k, e) in measures.items():
        own, carried = _KINDS[k](e).over(inside), F.col(names[n])
        add[n] = F.coalesce(own, F.lit(0)) + F.coalesce(carried, F.lit(0)) if k == "sum" else (F.least if k == "min" else F.greatest)(own, carried)
    for n, (k, e) in totals.items():
        add[n] = F.coalesce(F.col(names[n]), _KINDS[k](e).over(alone))
        if k == "sum":
            add[n] = F.coalesce(add[n], F.lit(0))
    return out.withColumns(add).drop(*(f"__k{i}" for i in range(len(keys))), *names.values(), "__parts")


def positions(df: DataFrame, group: list[str], order: list[str], position: str = "position", size: str | None = None) -> DataFrame:
    """df with its position in the group, from 1, and the group's size if named; __bucket goes with it, for running()."""
    one = ("sum", F.lit(1).cast("long"))
    return running(ranged(df, *group, *order), group, order, {position: one}, {size: one} if size else None)


def global_position(df: DataFrame, value: str, *ties: str, dealt: bool = False) -> DataFrame:
    """df with position, 1 for the smallest value; equal values are told apart by ties. dealt: df comes from ranged() and keeps its bucket."""
    rows = df if dealt else ranged(df, value, *ties)
    out = running(rows, [], [value, *ties], {"position": ("sum", F.lit(1).cast("long"))})
    return out if dealt else out.drop("__bucket")


def suffix_min(rows: DataFrame, value: str, measure: Column, out: str, *ties: str) -> DataFrame:
    """Rows of ranged() with the least measure among their own and all larger values; the bucket goes."""
    rows = materialize(rows.withColumn("__m", measure), "measured")
    return running(rows, [], [value, *ties], {out: ("min", F.col("__m"))}, reverse=True).drop("__m", "__bucket")


def medians(df: DataFrame, group: list[str], value: str, *ties: str) -> DataFrame:
    """group, median: the middle value of each group, or the mean of the two middle ones; null values are left out."""
    rows = positions(df.where(F.col(value).isNotNull()), group, [value, *ties], "__at", "__n")
    middle = rows.where("2 * __at BETWEEN __n AND __n + 2")
    return middle.groupBy(*group).agg(F.avg(value).alias("median"))
