"""k-means over any number of rows, with the choice of k for one-dimensional values.

Seeding is k-means||: in a few rounds every row is taken as a candidate with a probability
in proportion to its squared distance from the candidates so far, about 2 * k rows a round;
candidates are weighed by the rows nearest to them and reduced to k by weighted k-means++.
Rows are drawn by a hash of (seed, round, id), so a run is repeatable however rows are dealt.
Lloyd steps send k centres to the tasks; each task returns a sum and a count for each, which
are added on Spark. What comes to the driver are candidates and centres, never rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import register
from ..matrix import table
from ..plans.scratch import materialize

ROUNDS = 5
#: Numbers in a block of distances.
_BLOCK = 4_000_000


def matrix(column: pa.Array) -> np.ndarray:
    """A list column without nulls as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each row (the first of equals) and its squared distance."""
    label, far = np.zeros(len(x), dtype=np.int64), np.zeros(len(x))
    step = max(1, _BLOCK // (len(centres) * max(1, centres.shape[1])))
    for i in range(0, len(x), step):
        d = ((x[i : i + step, None, :] - centres[None]) ** 2).sum(axis=2)
        label[i : i + step] = d.argmin(axis=1)
        far[i : i + step] = d[np.arange(len(d)), label[i : i + step]]
    return label, far


def _cost(points: DataFrame, centres: np.ndarray) -> float:
    def run(batches):
        total = 0.0
        for batch in batches:
            if batch.num_rows:
                total += float(nearest(matrix(batch.column(0)), centres)[1].sum())
        yield pa.record_batch([pa.array([total])], names=["cost"])

    return points.select("vector").mapInArrow(run, "cost double").agg(F.sum("cost")).first()[0] or 0.0


def _candidates(points: DataFrame, centres: np.ndarray, wanted: float, cost: float, seed: int, turn: int) -> np.ndarray:
    """About `wanted` rows, each with a probability in proportion to its squared distance."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                far = nearest(matrix(batch.column(0)), centres)[1]
                yield batch.select([0]).filter(pa.array(batch.column(1).to_numpy() * cost < wanted * far))

    drawn = F.pmod(F.xxhash64(F.lit(seed), F.lit(turn), "id"), F.lit(1 << 50)) / F.lit(float(1 << 50))
    rows = points.select("vector", drawn.alias("u")).mapInArrow(run, "vector array<double>").toArrow()
    return matrix(rows.column("vector").combine_chunks()) if rows.num_rows else centres[:0]


def _tallies(points: DataFrame, centres: np.ndarray, before: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, int]:
    """Per centre the number and the sum of the rows nearest to it, and how many rows had another nearest one before (None: any but the first)."""
    k, width = centres.shape

    def run(batches):
        n, total, moved = np.zeros(k, dtype=np.int64), np.zeros((k, width)), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column(0))
            label = nearest(x, centres)[0]
            was = np.zeros(len(x), dtype=np.int64) if before is None else nearest(x, before)[0]
            n += np.bincount(label, minlength=k)
            np.add.at(total, label, x)
            moved += int((label != was).sum())
        some = np.flatnonzero(n)
        yield pa.record_batch([pa.array(some), pa.array(n[some]), pa.array(list(total[some]), pa.list_(pa.float64())), pa.array(np.where(np.arange(len(some)) == 0, moved, 0))], names=["cluster", "n", "total", "moved"])

    def add(rows: pa.Table) -> pa.Table:
        total = matrix(rows.column("total").combine_chunks()).sum(axis=0)
        return pa.table({"cluster": rows.column("cluster")[:1], "n": pa.array([pa.compute.sum(rows.column("n")).as_py()]), "total": pa.array([total.tolist()]), "moved": pa.array([pa.compute.sum(rows.column("moved")).as_py()])})

    schema = "cluster long, n long, total array<double>, moved long"
    n, total, moved = np.zeros(k, dtype=np.int64), np.zeros((k, width)), 0
    for r in points.select("vector").mapInArrow(run, schema).groupBy("cluster").applyInArrow(add, schema).collect():  # a row for each centre
        n[r.cluster], total[r.cluster] = r.n, r.total
        moved += r.moved
    return n, total, moved


def _farthest(points: DataFrame, centres: np.ndarray, most: int) -> np.ndarray:
    """The rows farthest from their centre, at most `most`, ties by the smaller id."""

    def run(batches):
        held = None
        for batch in batches:
            if batch.num_rows:
                far = nearest(matrix(batch.column(1)), centres)[1]
                both = pa.table([batch.column(0), batch.column(1), pa.array(far)], names=["id", "vector", "far"])
                held = both if held is None else pa.concat_tables([held, both])
                held = held.sort_by([("far", "descending"), ("id", "ascending")]).slice(0, most)
        if held is not None:
            yield from held.to_batches()

    kind = dict(points.dtypes)["id"]
    rows = points.select("id", "vector").mapInArrow(run, f"id {kind}, vector array<double>, far double").orderBy(F.desc("far"), "id").limit(most).collect()
    return np.array([r.vector for r in rows])


def seeds(points: DataFrame, k: int, seed: int, rounds: int = ROUNDS) -> np.ndarray:
    """k starting centres by k-means||."""
    first = points.agg(F.min_by("vector", F.struct(F.xxhash64(F.lit(seed), "id"), "id"))).first()[0]
    found = np.array([first], dtype=np.float64)
    for turn in range(rounds):
        cost = _cost(points, found)
        if cost <= 0:
            break
        found = np.concatenate([found, _candidates(points, found, 2.0 * k, cost, seed, turn)])
    found = np.unique(found, axis=0)
    weight = _tallies(points, found, None)[0].astype(np.float64)
    rng = np.random.default_rng(seed)
    picked = [int(rng.choice(len(found), p=weight / weight.sum()))]
    far = ((found - found[picked[0]]) ** 2).sum(axis=1)
    while len(picked) < k:
        mass = far * weight
        picked.append(int(rng.choice(len(found), p=mass / mass.sum())) if mass.sum() > 0 else picked[-1])  # fewer different rows than k
        far = np.minimum(far, ((found - found[picked[-1]]) ** 2).sum(axis=1))
    return found[picked]


def labelled(points: DataFrame, centres: np.ndarray) -> DataFrame:
    """id, cluster and the squared distance from its centre."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                label, far = nearest(matrix(batch.column(1)), centres)
                yield pa.record_batch([batch.column(0), pa.array(label), pa.array(far)], names=["id", "cluster", "distance"])

    return points.select("id", "vector").mapInArrow(run, f"id {dict(points.dtypes)['id']}, cluster long, distance double")


def lloyd(points: DataFrame, centres: np.ndarray, max_iter: int) -> tuple[np.ndarray, np.ndarray]:
    """(centres, the centres by which rows were last assigned) after at most so many steps, or when no row moves.

    A centre without rows becomes the row farthest from its own centre, each another one.
    """
    before, by = None, centres
    for _ in range(max(1, max_iter)):
        n, total, moved = _tallies(points, centres, before)
        following = total / np.maximum(n, 1)[:, None]
        if (n == 0).any():
            spare = _farthest(points, centres, int((n == 0).sum()))
            empty = np.flatnonzero(n == 0)
            following[empty] = spare[np.arange(len(empty)) % len(spare)]
        before = by = centres
        centres = following
        if moved == 0:
            break
    return centres, by


def prepared(df: DataFrame) -> DataFrame:
    """id and vector of the rows that have a vector without nulls, written once for all steps."""
    rows = df.where(F.col("vector").isNotNull() & ~F.exists("vector", lambda x: x.isNull())).select("id", F.col("vector").cast("array<double>").alias("vector"))
    return materialize(rows, "points")


def kmeans(df: DataFrame, k: int, max_iter: int = 100, seed: int = 42) -> tuple[np.ndarray, DataFrame]:
    """(centres, rows id, cluster, distance). df: (id, vector), vectors of one length.

    k of 1 or less: the mean, and all rows in cluster 0. Without rows: no centres, no rows.
    """
    points = prepared(df)
    if points.isEmpty():
        return np.zeros((0, 0)), labelled(points, np.zeros((1, 1)))
    start = seeds(points, k, seed) if k > 1 else seeds(points, 1, seed, 0)
    centres, by = lloyd(points, start, max_iter if k > 1 else 1)
    return centres, labelled(points, by)


@register("kmeans_lloyd", """WITH x AS MATERIALIZED (SELECT vec_id AS id, unnest(embedding)::DOUBLE AS v, unnest(range(len(embedding))) AS i FROM embeddings),
c0 AS MATERIALIZED (SELECT (row_number() OVER (PARTITION BY i ORDER BY id) - 1) AS c, i, v FROM x WHERE id IN (SELECT vec_id FROM embeddings ORDER BY vec_id LIMIT 8)),
""" + ",\n".join(
    f"d{t} AS MATERIALIZED (SELECT id, arg_min(c, (d, c)) AS cluster, min(d) AS distance FROM (SELECT x.id, c, sum((x.v - c{t}.v) ** 2) AS d FROM x JOIN c{t} ON c{t}.i = x.i GROUP BY ALL) GROUP BY id),\n"
    f"c{t + 1} AS MATERIALIZED (SELECT cluster AS c, i, avg(v) AS v FROM x JOIN d{t} ON d{t}.id = x.id GROUP BY ALL)"
    for t in range(3)
) + " SELECT id, cluster, round(distance, 6) AS distance FROM d2")
def _lloyd(spark, d):
    """Three Lloyd steps from the eight smallest ids."""
    points = prepared(table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")))
    start = np.array([r.vector for r in points.orderBy("id").limit(8).collect()])
    return labelled(points, lloyd(points, start, 3)[1]).select("id", "cluster", F.round("distance", 6).alias("distance"))


@register("kmeans_embeddings")
def _kmeans(spark, d):
    return kmeans(table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), 8)[1]


def mixture_fit(df: DataFrame, k: int, seed: int = 42, max_iter: int = 200) -> dict:
    """Means, variances and weights of k clusters of `value`, the Gaussian-mixture log-likelihood at these and its BIC. Variances are 1e-4 at least (1e-6 for k = 1)."""
    values = df.where("value IS NOT NULL").select("id", F.array(F.col("value").cast("double")).alias("vector"))
    rows = materialize(kmeans(values, k, max_iter, seed)[1].join(df.select("id", F.col("value").cast("double").alias("value")), "id"), "clustered")
    stats = rows.groupBy("cluster").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.var_pop("value").alias("variance")).orderBy("cluster").collect()
    n = sum(r.n for r in stats)
    means, weights = np.zeros(k), np.full(k, 1e-30)
    variances = np.full(k, 1e-4)
    for r in stats:
        means[r.cluster], weights[r.cluster], variances[r.cluster] = r["mean"], r.n / n, max(r.variance, 1e-4 if k > 1 else 1e-6)
    each = F.array(*(F.lit(float(np.log(w) - 0.5 * np.log(2 * np.pi * v))) - 0.5 * F.pow(F.col("value") - float(m), F.lit(2)) / float(v) for m, v, w in zip(means, variances, weights)))
    top = F.array_max("each")
    density = top + F.log(F.aggregate(F.transform("each", lambda x: F.exp(x - top)), F.lit(0.0), lambda a, x: a + x))
    likelihood = rows.withColumn("each", each).agg(F.sum(density)).first()[0] or 0.0
    return {"k": k, "means": means, "variances": variances, "weights": weights, "log_likelihood": likelihood, "bic": -2 * likelihood + (3 * k - 1) * float(np.log(max(n, 1)))}


def select_k(df: DataFrame, ks: list[int], seed: int = 42) -> dict:
    """The mixture_fit() of the smallest BIC, the first of equals. df: (id, value)."""
    return min((mixture_fit(df, k, seed) for k in ks), key=lambda fit: fit["bic"])


@register("kmeans_select_k")
def _select(spark, d):
    """The chosen number of clusters of account balances, with the components in order of their mean and which is nearest to 0."""
    found = select_k(table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("value")), [1, 2, 3, 4])
    order = np.argsort(found["means"], kind="stable")
    neutral = int(np.argmin(np.abs(found["means"][order])))
    rows = [(found["k"], i, float(found["means"][j]), float(found["variances"][j]), float(found["weights"][j]), i == neutral) for i, j in enumerate(order.tolist())]
    return spark.createDataFrame(rows, "k long, component long, mean double, variance double, weight double, neutral boolean")
