"""Sites of a gene chosen by EM over fixed components and BIC.

A gene's items (distinct fragments with their number) have a log-likelihood under each
candidate site, in order of rank, and under noise. Models of the first 1, 2, ... sites are
fitted by EM of their weights; the one with the smallest BIC stays, and sites that lie too
close in it are merged and fitted again. Items that are alike are counted first; genes are
dealt to tasks by the bytes of their items, and a task works gene by gene in matrices.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..catalog import register
from ..matrix import table
from ..plans.scratch import materialize
from ..plans.spread import spread
from .access import merge_nearby
from .clustering import matrix

#: Bytes of items in a task, on average.
TASK_BYTES = 16_000_000


def fit_weights(logs: np.ndarray, counts: np.ndarray, n: float, max_iter: int = 40, tol: float = 1e-4, least: float = 0.01) -> tuple[np.ndarray, float, float]:
    """(weights, log-likelihood, BIC) of the components in the columns of logs, the first of which is noise.

    Weights start equal; one below `least` goes for good, but that of noise. All on noise if nothing is left.
    """
    k = logs.shape[1]
    weights, before = np.full(k, 1.0 / k), -np.inf
    top = logs.max(axis=1)
    share = np.exp(logs - top[:, None])
    for turn in range(1, max_iter + 1):
        norm = share @ weights
        if norm.min() < 1e-200:  # what an item was measured by has gone
            live = weights > 0
            top = logs[:, live].max(axis=1)
            share = np.where(live, np.exp(np.minimum(logs - top[:, None], 0)), 0)
            norm = share @ weights
        total = float(counts @ (np.log(norm) + top))
        if turn > 1 and (abs(total - before) < tol or turn >= max_iter):
            break
        before = total
        weights = weights * ((counts / norm) @ share) / counts.sum()
        weights[1:][weights[1:] < least] = 0.0
        weights = weights / weights.sum() if weights.sum() > 0 else np.eye(1, k)[0]
    return weights, total, -2 * total + (k - 1) * float(np.log(n))


def choose(noise: np.ndarray, sites: np.ndarray, counts: np.ndarray, places: np.ndarray, spreads: np.ndarray, apart: float = 2.0) -> tuple[list[int], np.ndarray, float, float]:
    """(sites, weights with that of noise first, log-likelihood, BIC): of the models of the first sites the one of the smallest BIC, tried until two in a row are no better; then sites nearer than `apart` spreads to one of a larger weight go, and the rest are fitted again, by place."""
    n = float(counts.sum())
    fit = lambda chosen: (chosen, *fit_weights(np.column_stack([noise, sites[:, chosen]]), counts, n))
    best, worse = None, 0
    for k in range(1, sites.shape[1] + 1):
        found = fit(list(range(k)))
        if best is None or found[3] < best[3]:
            best, worse = found, 0
        else:
            worse += 1
            if worse == 2:
                break
    if sites.shape[1] < 2 or apart <= 0:
        return best
    chosen, weights = best[:2]
    live = [i for i in range(len(chosen)) if weights[i + 1] > 0]
    kept: list[int] = []
    for i in sorted(live, key=lambda i: (-weights[i + 1], places[i])):
        if not any(abs(places[i] - places[j]) < apart * max(spreads[i], spreads[j]) for j in kept):
            kept.append(i)
    return best if len(kept) == len(live) else fit(sorted(kept, key=lambda i: places[i]))


def select_sites(items: DataFrame, candidates: DataFrame, apart: float = 2.0, density: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """(gene, site, place, weight, log_lik, bic) of the sites chosen for each gene; site is the rank of the candidate, from 0.

    items: (gene, n, noise, sites), sites the log-likelihoods of the candidates in order of rank; candidates: (gene, places,
    spreads), arrays in that order. With density, a function of positions, places and spreads that gives a row of
    log-likelihoods for each position, items are (gene, n, noise, pos), and no array is shuffled. Genes without candidates
    or items have no rows; sites whose weight fell to 0 are left out.
    """
    kind = dict(items.dtypes)["gene"]
    by = "pos" if density else "sites"
    alike = materialize(items.where("n > 0").groupBy("gene", "noise", by).agg(F.sum("n").cast("double").alias("n")), "items")
    total = alike.agg(F.sum(F.lit(100) if density else 8 * F.size("sites") + 24)).first()[0] or 0
    parts = max(1, -(-int(total) // TASK_BYTES))
    dealt = lambda df: df.withColumn("part", F.pmod(F.xxhash64("gene"), F.lit(parts))).groupBy("part")

    def run(part: pa.Table, known: pa.Table) -> pa.Table:
        part = part.sort_by("gene").combine_chunks()
        at = {g: i for i, g in enumerate(known.column("gene").to_pylist())}
        names = part.column("gene").to_pylist()
        cuts = [0, *(i for i in range(1, len(names)) if names[i] != names[i - 1]), len(names)]
        out = {c: [] for c in ("gene", "site", "place", "weight", "log_lik", "bic")}
        for a, b in zip(cuts[:-1], cuts[1:]):
            if a == b or names[a] not in at:
                continue
            own = part.slice(a, b - a)
            places, spreads = (np.array(known.column(c)[at[names[a]]].as_py(), dtype=float) for c in ("places", "spreads"))
            logs = density(own.column("pos").to_numpy(), places, spreads) if density else matrix(own.column("sites").combine_chunks())
            chosen, weights, log_lik, bic = choose(own.column("noise").to_numpy(), logs, own.column("n").to_numpy(), places, spreads, apart)
            for i, w in zip(chosen, weights[1:].tolist()):
                if w > 0:
                    for c, v in zip(out, (names[a], i, float(places[i]), w, log_lik, bic)):
                        out[c].append(v)
        kinds = (part.schema.field("gene").type, pa.int32(), *[pa.float64()] * 4)
        return pa.table({c: pa.array(v, t) for (c, v), t in zip(out.items(), kinds)})

    both = dealt(alike).cogroup(dealt(candidates.where("size(places) > 0").select("gene", "places", "spreads")))
    return both.applyInArrow(run, f"gene {kind}, site int, place double, weight double, log_lik double, bic double")


@register("select_sites_bic")
def _select(spark, d):
    """Days on which a supplier's shipments cluster, out of those of its dense spells."""
    lines = table(spark, d, "lineitem")
    l = lines.select(F.col("l_suppkey").alias("gene"), F.expr("cast(datediff(l_shipdate, DATE'1970-01-01') AS bigint)").alias("pos"))
    counts = spread(l, lines.count(), "gene").groupBy("gene", "pos").agg(F.count("*").alias("n"))
    spells = merge_nearby(counts, "gene", 120)
    rank = F.row_number().over(Window.partitionBy("gene").orderBy(F.desc("n"), "site"))
    ranked = spells.withColumn("r", rank).groupBy("gene").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "site"))), lambda x: x["site"].cast("double")).alias("places"))
    ranked = ranked.withColumn("spreads", F.transform("places", lambda p: F.lit(20.0)))

    def density(pos: np.ndarray, places: np.ndarray, spreads: np.ndarray) -> np.ndarray:
        return -0.5 * ((pos[:, None] - places) / spreads) ** 2 - np.log(spreads * np.sqrt(2 * np.pi))

    found = select_sites(counts.withColumn("noise", F.lit(float(-np.log(2600.0)))), ranked, density=density)
    return found.select("gene", "site", "place", F.round("weight", 6).alias("weight"), F.round("bic", 4).alias("bic"))
