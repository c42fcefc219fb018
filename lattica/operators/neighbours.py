"""Exact nearest neighbours by pivots, over all points or in each batch of them.

Points are dealt into cells by the nearest of a bounded number of pivots, and a cell is known
by its pivot, size and radius. A query first meets the nearest cells that together hold k
points; the k-th distance found bounds the rest, and by the triangle inequality only cells
whose pivot is no farther than this distance and their radius are met in the second round.
Where queries meet most cells, as far points in many dimensions do, neighbouring cells are met
as one, so that a query is sent to few places. Cells are cut into chunks of points and a
chunk's queries into blocks, so neither a crowded cell nor a popular one fills a task, and each
of these returns k rows a query. In a block a matrix product leaves the few points that may be
among the nearest, whose distances are then worked out as differences. Only pivots, a row for
each cell and batch and a few queries reach the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..catalog import register
from ..matrix import table
from ..plans.scratch import broadcast_small, materialize
from .clustering import matrix, nearest

#: Pivots at most, points of a cell that are worth one, bytes of a chunk's points, queries of a block.
PIVOTS, WORTH, CHUNK_BYTES, BLOCK = 512, 256, 16_000_000, 8192
#: Distances that a task holds at once, queries dealt at once, visits of a record batch.
HELD, SLICE, VISITS = 1_000_000, 1024, 4096
#: Places where a query meets cells in the second round, about, and queries that tell how many cells are met.
PLACES, ASKED = 8, 256


def _squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances, a row for each of x."""
    out = np.empty((len(x), len(y)))
    step = max(1, HELD // (max(1, len(y)) * max(1, y.shape[1])))
    for i in range(0, len(x), step):
        out[i : i + step] = ((x[i : i + step, None, :] - y[None]) ** 2).sum(axis=2)
    return out


def _near(x: np.ndarray, y: np.ndarray, k: int, same: dict[int, list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of x, row of y, squared distance) of the k nearest of y, ties at nine digits to the first; same: rows of y that do not count, for a row of x."""
    mine, theirs, wide = (x * x).sum(axis=1), (y * y).sum(axis=1), max(1, y.shape[1])
    about, gone = mine[:, None] + theirs[None] - 2 * (x @ y.T), np.zeros((len(x), len(y) if same else 0), dtype=bool)
    for i, out in same.items():
        about[i, out], gone[i, out] = np.inf, True
    kth = np.partition(about, k - 1, axis=1)[:, k - 1] if k < len(y) else np.full(len(x), np.inf)
    # What rounding may take from the product, twice, and from the ninth digit. Numbers that are none are looked at, too.
    slack = 8 * (wide + 4) * np.finfo(float).eps * (mine + theirs.max(initial=0.0)) + 2e-9
    row, at = np.nonzero(~(about > (kth + slack)[:, None]) & ~gone if same else ~(about > (kth + slack)[:, None]))
    far, step = np.empty(len(row)), max(1, HELD // wide)
    for i in range(0, len(row), step):
        far[i : i + step] = ((x[row[i : i + step]] - y[at[i : i + step]]) ** 2).sum(axis=1)
    real = np.isfinite(far)
    row, at, far = row[real], at[real], far[real]
    order = np.lexsort((at, np.round(far, 9), row))
    row, at, far = row[order], at[order], far[order]
    nearest_ = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[nearest_], at[nearest_], far[nearest_]


def _places(cells: tuple[np.ndarray, np.ndarray, np.ndarray], pivots: np.ndarray, met: float, room: int) -> np.ndarray:
    """The place of each cell, named by its first one: neighbours along the pivots' longest axis, so many together that a query which meets `met` cells goes to about PLACES, with no more points than room unless of one cell."""
    cell, size, _ = cells
    together = max(1, int(np.ceil(met / PLACES)))
    apart = pivots[cell] - pivots[cell].mean(axis=0)
    order = np.argsort(apart @ np.linalg.svd(apart, full_matrices=False)[2][0], kind="stable") if together > 1 and np.isfinite(apart).all() else np.arange(len(cell))
    out, first, n, points = np.empty(len(cell), dtype=np.int64), 0, 0, 0
    for i in order:
        if not n or n == together or points + size[i] > room:
            first, n, points = i, 0, 0
        out[i], n, points = first, n + 1, points + size[i]
    return out


def _vectors(df: DataFrame, *more: str) -> DataFrame:
    known = df.where(F.col("id").isNotNull() & F.col("vector").isNotNull() & ~F.exists("vector", lambda x: x.isNull()))
    return known.select("id", F.col("vector").cast("array<double>").alias("vector"), *more)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    by = Window.partitionBy("query", "batch").orderBy(F.round("distance", 9), "id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def knn(queries: DataFrame, points: DataFrame, k: int, others: bool = False, batch: str | None = None) -> DataFrame:
    """(query, id, rank, distance), with batch its values too: for each query the k nearest points by squared L2, of each batch if named; ties by id.

    queries: (id, vector); points: (id, vector[, batch]). others: a point with the query's id is no neighbour of it.
    Rows without an id or a number are left out; fewer points than k give all of them.
    """
    spark = points.sparkSession
    named = points.withColumn("batch", F.col(batch).cast("string") if batch else F.lit("")).where("batch IS NOT NULL")
    points = materialize(_vectors(named, "batch"), "points")
    queries = materialize(_vectors(queries), "queries")
    kind, named_kind = dict(points.dtypes)["id"], dict(queries.dtypes)["id"]
    empty = spark.createDataFrame([], f"query {named_kind}, batch string, id {kind}, distance double, rank int")
    n = points.count()
    if not n or queries.isEmpty():
        return _shown(empty, batch)
    wanted = min(PIVOTS, max(1, n // WORTH))
    pivots = np.array([r.vector for r in points.orderBy(F.xxhash64("id"), "id").limit(wanted).collect()])
    pivots = np.unique(pivots, axis=0)

    def deal(batches):
        for b in batches:
            if b.num_rows:
                cell, far = nearest(matrix(b.column(1)), pivots)
                yield pa.record_batch([b.column(0), b.column(1), b.column(2), pa.array(cell.astype(np.int32)), pa.array(np.sqrt(far))], names=["id", "vector", "batch", "cell", "far"])

    dealt = materialize(points.mapInArrow(deal, f"id {kind}, vector array<double>, batch string, cell int, far double"), "dealt")
    cells = dealt.groupBy("batch", "cell").agg(F.count("*").alias("n"), F.max("far").alias("radius")).orderBy("batch", "cell").collect()
    room = max(1, CHUNK_BYTES // (8 * max(1, pivots.shape[1])))
    known: dict = {}
    for r in cells:
        known.setdefault(r.batch, []).append((r.cell, r.n, r.radius))
    known = {b: tuple(map(np.array, zip(*rows))) for b, rows in known.items()}

    def visits(places: dict[str, np.ndarray] | None = None):
        """The cells of the first round, or the places of the second."""

        def run(batches):
            for b in (whole.slice(i, SLICE) for whole in batches for i in range(0, whole.num_rows, SLICE)):
                x = matrix(b.column(1))
                away = np.sqrt(_squared(x, pivots))
                for name, (cell, size, radius) in known.items():
                    d = away[:, cell]
                    if places is None:
                        order = np.argsort(d, axis=1, kind="stable")
                        held = np.cumsum(size[order], axis=1) - size[order]
                        meets = np.zeros(d.shape, dtype=bool)
                        np.put_along_axis(meets, order, held < k + others, axis=1)
                    else:
                        row, at = np.nonzero(reached(d, radius, b.column(2).to_pylist(), name))
                        meets = np.zeros(d.shape, dtype=bool)
                        meets[row, places[name][at]] = True
                    rows, ats = np.nonzero(meets)
                    # A query may visit every cell, so visits leave in pieces.
                    for i in range(0, len(rows), VISITS):
                        row, at = rows[i : i + VISITS], ats[i : i + VISITS]
                        yield pa.record_batch([b.column(0).take(pa.array(row)), b.column(1).take(pa.array(row)), pa.array([name] * len(row)), pa.array(cell[at].astype(np.int32))], names=["query", "q", "batch", "cell"])

        return run

    def reached(d: np.ndarray, radius: np.ndarray, bounds: list, name: str) -> np.ndarray:
        bound = np.array([dict(v or ()).get(name, np.inf) for v in bounds])
        # Rounding must not lose a point on the border.
        return d - radius <= np.sqrt(bound)[:, None] * (1 + 1e-9) + 1e-9

    def met(asked: DataFrame, places: dict[str, np.ndarray] | None = None) -> DataFrame:
        at = [(b, int(c), int(cell[places[b][i]] if places else c), int(n)) for b, (cell, size, _) in known.items() for i, (c, n) in enumerate(zip(cell, size))]
        held: dict = {}
        for b, _, place, n in at:
            held[b, place] = held.get((b, place), 0) + n
        chunks = spark.createDataFrame([(b, c, -(-n // room)) for (b, c), n in held.items()], "batch string, cell int, chunks long")
        there = dealt.join(broadcast_small(spark.createDataFrame([x[:3] for x in at], "batch string, cell int, place int")), ["batch", "cell"]).select("batch", F.col("place").alias("cell"), "id", "vector")
        there = there.join(broadcast_small(chunks), ["batch", "cell"]).withColumn("chunk", F.pmod(F.xxhash64("id", F.lit(3)), F.col("chunks"))).drop("chunks")
        asked = materialize(asked, "visits")
        crowd = materialize(asked.groupBy("batch", "cell").agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("blocks")), "crowds")
        asked = asked.join(broadcast_small(crowd), ["batch", "cell"]).join(broadcast_small(chunks), ["batch", "cell"])
        asked = asked.withColumn("block", F.pmod(F.xxhash64("query"), F.col("blocks"))).withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
        there = there.join(broadcast_small(crowd), ["batch", "cell"]).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        keys = ["batch", "cell", "chunk", "block"]

        def compare(q: pa.Table, p: pa.Table) -> pa.Table:
            p = p.sort_by("id")
            x, y = matrix(q.column("q").combine_chunks()), matrix(p.column("vector").combine_chunks())
            own, asking = {}, q.column("query").to_pylist() if others else []
            for i, name in enumerate(p.column("id").to_pylist() if others else []):
                own.setdefault(name, []).append(i)
            rows, ids, fars = [], [], []
            step = max(1, HELD // max(1, len(y)))
            for i in range(0, len(x) if len(y) else 0, step):  # a few queries at a time, so a task holds no matrix of a block by a chunk
                row, at, far = _near(x[i : i + step], y, k, {j: own[name] for j, name in enumerate(asking[i : i + step]) if name in own})
                rows.append(row + i)
                ids.append(at)
                fars.append(far)
            row, near, far = (np.concatenate(v) if v else np.zeros(0, dtype=np.int64) for v in (rows, ids, fars))
            return pa.table({"query": q.column("query").take(pa.array(row)), "batch": q.column("batch").take(pa.array(row)), "id": p.column("id").take(pa.array(near)), "distance": pa.array(far, pa.float64())})

        both = asked.select(*keys, "query", "q").groupBy(*keys).cogroup(there.select(*keys, "id", "vector").groupBy(*keys))
        return both.applyInArrow(compare, f"query {named_kind}, batch string, id {kind}, distance double")

    shape = f"query {named_kind}, q array<double>, batch string, cell int"
    early = materialize(_ranked(met(queries.mapInArrow(visits(), shape)), k), "near")
    bounds = early.where(F.col("rank") == k).groupBy(F.col("query").alias("id")).agg(F.map_from_entries(F.collect_list(F.struct("batch", "distance"))).alias("bounds"))
    asked = queries.join(bounds, "id", "left").select("id", "vector", F.coalesce("bounds", F.create_map().cast("map<string,double>")).alias("bounds"))
    some = asked.limit(ASKED).toArrow()
    away = np.sqrt(_squared(matrix(some.column("vector").combine_chunks()), pivots))
    places = {}
    for name, cells_ in known.items():
        count = reached(away[:, cells_[0]], cells_[2], some.column("bounds").to_pylist(), name).sum(axis=1).mean()
        places[name] = _places(cells_, pivots, count, room)
    # Cells of the first round are met again with their places.
    return _shown(_ranked(met(asked.mapInArrow(visits(places), shape), places), k), batch)


def _shown(found: DataFrame, batch: str | None) -> DataFrame:
    return found.select("query", *([F.col("batch").alias(batch)] if batch else []), "id", "rank", "distance")


def _embeddings(spark, d) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


_D = "d AS (SELECT q.vec_id AS query, p.vec_id AS id, p.label, list_sum(list_transform(list_zip(q.embedding, p.embedding), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) ** 2)) AS distance FROM embeddings q, embeddings p WHERE q.vec_id % 100 = 0)"


@register("knn_others", f"WITH {_D}, r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(distance, 9), id) AS rank FROM d WHERE id <> query) SELECT query, id, rank, round(distance, 5) AS distance FROM r WHERE rank <= 5")
def _others(spark, d):
    """The five nearest others of every embedding whose id is divisible by 100."""
    v = _embeddings(spark, d)
    return knn(v.where("id % 100 = 0"), v, 5, others=True).select("query", "id", F.col("rank").cast("long").alias("rank"), F.round("distance", 5).alias("distance"))


@register("knn_by_batch", f"WITH {_D}, r AS (SELECT *, row_number() OVER (PARTITION BY query, label ORDER BY round(distance, 9), id) AS rank FROM d) SELECT query, label::VARCHAR AS label, id, rank, round(distance, 5) AS distance FROM r WHERE rank <= 3")
def _by_batch(spark, d):
    """The three nearest embeddings of each label, as batches that must all be matched."""
    v = _embeddings(spark, d)
    return knn(v.where("id % 100 = 0"), v, 3, batch="label").select("query", "label", "id", F.col("rank").cast("long").alias("rank"), F.round("distance", 5).alias("distance"))


def matched_columns(cells: DataFrame, neighbours: DataFrame) -> DataFrame:
    """(col_id, neighbour, row_id, val): the cells of every column's matched ones, as found by knn(). cells: (row_id, col_id, val)."""
    pairs = neighbours.select(F.col("query").alias("col_id"), F.col("id").alias("neighbour"))
    return pairs.join(cells.withColumnRenamed("col_id", "neighbour"), "neighbour").select("col_id", "neighbour", "row_id", "val")
