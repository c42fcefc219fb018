"""Clusters merged bottom-up by Bayes factors of their feature masses, and the tree cut to labels.

The evidence of a cluster under a Dirichlet-multinomial model with a prior at the pooled
profile is a sum over features, so blocks of features are dealt to tasks, each returns one
partial sum for each pair that is asked for, and these are added on Spark. A merge asks for
the pairs of the new cluster only; those between older ones stand. The driver holds the
Bayes factors of k clusters, never their masses.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import register
from ..matrix import table
from ..plans.scratch import materialize

#: Features of a block, on average, and the least share of the pooled mass that a feature counts with.
FEATURES, LEAST = 2_000, 1e-9


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln Gamma of positive numbers: Stirling's series from 8 up, below by the recurrence."""
    x = np.asarray(x, dtype=np.float64)
    y = np.where(x < 8, x + 8, x)
    far = (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7) + 1 / (1188 * y**9) - 691 / (360360 * y**11)
    down = np.zeros_like(x)
    for i in range(8):
        down += np.log(np.where(x < 8, x + i, 1.0))
    return far - down


def _blocked(mass: DataFrame, scale: DataFrame, total: float, gamma: float) -> DataFrame:
    """(prior, rows, columns, values): blocks of features as sparse masses of the clusters, scaled to their effective sizes, with the prior mass of each feature."""
    n = mass.select("feature").distinct().count()
    blocks = max(1, -(-n // FEATURES))
    pooled = mass.groupBy("feature").agg((F.lit(gamma) * F.greatest(F.sum("val") / total, F.lit(LEAST))).alias("prior"))
    rows = mass.join(F.broadcast(scale), "cluster").select("feature", "cluster", (F.col("val") * F.col("scale")).alias("val"))
    each = rows.groupBy("feature").agg(F.collect_list(F.struct("cluster", "val")).alias("held")).join(pooled, "feature")  # at most k values a feature
    block = F.pmod(F.xxhash64("feature"), F.lit(blocks))

    def pack(part: pa.Table) -> pa.Table:
        held = part.column("held").combine_chunks()
        at = np.repeat(np.arange(len(held)), np.diff(held.offsets.to_numpy()))
        cluster, val = (held.flatten().field(c).to_numpy() for c in ("cluster", "val"))
        lists = lambda x, kind: pa.array([x.tolist()], pa.list_(kind))
        return pa.table({"prior": lists(part.column("prior").to_numpy(), pa.float64()), "at": lists(at, pa.int32()), "cluster": lists(cluster, pa.int32()), "val": lists(val, pa.float64())})

    return materialize(each.withColumn("block", block).groupBy("block").applyInArrow(pack, "prior array<double>, at array<int>, cluster array<int>, val array<double>"), "blocks")


def _sums(blocks: DataFrame, leaves: list[list[int]], k: int) -> np.ndarray:
    """For each set of first clusters the sum over features of ln Gamma(prior + its mass), less that of the prior."""

    def run(batches):
        total = np.zeros(len(leaves))
        for batch in batches:
            for prior, at, cluster, val in zip(*(batch.column(i) for i in range(4))):
                p = prior.values.to_numpy()
                held = np.zeros((k, len(p)))
                np.add.at(held, (cluster.values.to_numpy(), at.values.to_numpy()), val.values.to_numpy())
                base = log_gamma(p).sum()
                for i, members in enumerate(leaves):
                    total[i] += log_gamma(p + held[members].sum(axis=0)).sum() - base
        yield pa.record_batch([pa.array(np.arange(len(leaves))), pa.array(total)], names=["i", "s"])

    out = np.zeros(len(leaves))
    for r in blocks.mapInArrow(run, "i long, s double").groupBy("i").agg(F.sum("s").alias("s")).collect():
        out[r.i] = r.s
    return out


def agglomerate(mass: DataFrame, sizes: DataFrame, gamma: float = 1.0) -> list[tuple[int, int, int, float, int]]:
    """(id, left, right, log_bf, n) of each merge in order: of all pairs the one with the largest log Bayes factor of one profile against two, ties to the smaller ids.

    mass: (cluster, feature, val), clusters 0 to k - 1; sizes: (cluster, size, effective), the summed mass that proportions refer to
    and the effective number of samples, a row for each cluster. Clusters of no effective size take no part; merged ones are k, k + 1, ...
    """
    gamma = max(gamma, 1e-6)
    known = {r.cluster: (float(r["size"]), int(r.effective)) for r in sizes.collect()}  # k rows
    active = sorted(c for c, (_, n) in known.items() if n > 0)
    if len(active) < 2:
        return []
    k = max(known) + 1
    spark = mass.sparkSession
    scale = spark.createDataFrame([(c, known[c][1] / known[c][0] if known[c][0] > 0 else 0.0) for c in active], "cluster int, scale double")
    mass = mass.select(F.col("cluster").cast("int").alias("cluster"), "feature", F.col("val").cast("double").alias("val")).where(F.col("cluster").isin(active) & (F.col("val") > 0))
    mass = materialize(mass.groupBy("cluster", "feature").agg(F.sum("val").alias("val")), "mass")
    blocks = _blocked(mass, scale, max(sum(known[c][0] for c in active), LEAST), gamma)
    leaves, n = {c: [c] for c in active}, {c: known[c][1] for c in active}

    def evidence(nodes: list[tuple[int, ...]]) -> np.ndarray:
        size = np.array([sum(n[x] for x in node) for node in nodes], dtype=float)
        return float(log_gamma(np.array([gamma]))[0]) - log_gamma(gamma + size) + _sums(blocks, [[c for x in node for c in leaves[x]] for node in nodes], k)

    alone = dict(zip(active, evidence([(c,) for c in active])))
    pairs = [(a, b) for i, a in enumerate(active) for b in active[i + 1 :]]
    factor = {p: e - alone[p[0]] - alone[p[1]] for p, e in zip(pairs, evidence(pairs))}
    merges, new = [], k
    while len(active) > 1:
        left, right = min(factor, key=lambda p: (-factor[p], p))
        merges.append((new, left, right, float(factor[left, right]), n[left] + n[right]))
        alone[new] = factor[left, right] + alone[left] + alone[right]
        leaves[new], n[new] = leaves[left] + leaves[right], n[left] + n[right]
        active = [c for c in active if c not in (left, right)]
        factor = {p: f for p, f in factor.items() if left not in p and right not in p}
        if active:
            for c, e in zip(active, evidence([(c, new) for c in active])):
                factor[c, new] = e - alone[c] - alone[new]
        active.append(new)
        new += 1
    return merges


def cut(merges: list[tuple[int, int, int, float, int]], k: int, cutoff: float = 0.0) -> list[int]:
    """A label for each of k clusters: merges at or above the cutoff join the first clusters that stand for their sides; labels from 0 in order, -1 for clusters that took no part."""
    up, first = list(range(k)), {c: c for c in range(k)}

    def root(c: int) -> int:
        while up[c] != c:
            c = up[c]
        return c

    seen = {c for _, a, b, *_ in merges for c in (a, b) if c < k}
    for new, a, b, log_bf, _ in merges:
        if log_bf >= cutoff:
            x, y = sorted((root(first[a]), root(first[b])))
            up[y] = x
        first[new] = min(first[a], first[b])
    names: dict[int, int] = {}
    return [names.setdefault(root(c), len(names)) if c in seen else -1 for c in range(k)]


def _brands(spark, d) -> tuple[DataFrame, DataFrame]:
    """Thirty sizes of parts as clusters over suppliers."""
    p = table(spark, d, "part").select("p_partkey", F.pmod("p_size", F.lit(30)).cast("int").alias("cluster"))
    l = table(spark, d, "lineitem").join(p, F.col("p_partkey") == F.col("l_partkey"))
    mass = l.groupBy("cluster", F.col("l_suppkey").alias("feature")).agg(F.sum("l_quantity").cast("double").alias("val"))
    sizes = p.groupBy("cluster").agg(F.count("*").alias("effective")).join(mass.groupBy("cluster").agg(F.sum("val").alias("size")), "cluster")
    return mass, sizes


@register("bhc_merges")
def _merges(spark, d):
    """The tree of merges of part sizes."""
    rows = [(*m[:3], round(m[3], 6), m[4]) for m in agglomerate(*_brands(spark, d))]
    return spark.createDataFrame(rows, "id long, left long, right long, log_bf double, n long")


@register("bhc_labels")
def _labels(spark, d):
    """Part sizes by the cut of their tree."""
    mass, sizes = _brands(spark, d)
    label = cut(agglomerate(mass, sizes), 30)
    return spark.createDataFrame(list(enumerate(label)), "cluster long, label long")
