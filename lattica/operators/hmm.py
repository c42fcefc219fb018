"""Hidden Markov chains of any length: Viterbi paths, posteriors and likelihoods by associative scans.

A step of a chain is a K by K matrix (transition and emission), and a stretch of steps the
product of its matrices, by max and plus for the best path and by log-sum-exp and plus for
probabilities. Rows are dealt by range of (chain, position) into buckets; a first pass
multiplies each bucket's matrices, the driver multiplies these (K * K numbers a bucket)
from both ends, and a second pass starts every bucket from what came before and after it.
A chain's first step forgets what came before, so a bucket may hold many chains, and a
chain may fill many buckets.

Backpointers are maps from a step's state to that of the step before, which compose in
the same way: the second pass composes a bucket's, the driver those of the buckets, and
a third pass reads the states. Inside a bucket, all scans run over blocks side by side.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import register
from ..matrix import table
from ..plans.ranking import ranged
from ..plans.scratch import forget, materialize


#: Rows of a bucket at most, on average: a task holds about a kilobyte for each.
BUCKET = 150_000


def sticky(means: list[float], switch: float = 1e-6, neutral: int = 1) -> tuple[list[float], np.ndarray, np.ndarray]:
    """(means, log transitions, log start): every other state with probability `switch`, the start as a step from the neutral state."""
    k = len(means)
    trans = np.full((k, k), np.log(switch))
    np.fill_diagonal(trans, np.log(1 - (k - 1) * switch))
    return means, trans, trans[neutral].copy()


def gaussian(value: str, means: list[float], alpha: str = "1.0", variance: str = "1.0"):
    """The log densities of a value at alpha * mean for each state, as an array column."""
    log_norm = f"-0.5 * (ln({variance}) + ln(2 * pi()))"
    return F.array(*(F.expr(f"{log_norm} - 0.5 * pow({value} - {alpha} * {m!r}D, 2) / ({variance})") for m in means))


def shared_emissions(rows: DataFrame, chain: str, position: str, weight: str = "1.0") -> DataFrame:
    """One emission array for each position: the weighted sum over the samples that observe it. rows: chain, position, emit."""
    k = len(rows.select("emit").first()[0]) if not rows.isEmpty() else 0
    return rows.groupBy(chain, position).agg(F.array(*(F.sum(F.col("emit")[i] * F.expr(weight)) for i in range(k))).alias("emit"))


def _max(x: np.ndarray, axis: int) -> np.ndarray:
    return x.max(axis=axis)


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    top = np.where(np.isfinite(top), top, 0.0)
    with np.errstate(divide="ignore"):
        return np.log(np.exp(x - top).sum(axis=axis)) + np.squeeze(top, axis)


def _levelled(x: np.ndarray) -> np.ndarray:
    """x less its largest number in the last two axes: only differences matter."""
    top = x.max(axis=(-2, -1), keepdims=True)
    return x - np.where(np.isfinite(top), top, 0.0)


def _blocks(steps: np.ndarray, neutral: np.ndarray) -> np.ndarray:
    """n matrices as (block, step in it, k, k), the last block filled up with neutral ones."""
    n = len(steps)
    length = max(1, int(np.ceil(np.sqrt(n))))
    count = -(-n // length)
    filled = np.concatenate([steps, np.broadcast_to(neutral, (count * length - n, *neutral.shape))]) if count * length > n else steps
    return filled.reshape(count, length, *neutral.shape)


def _one(k: int) -> np.ndarray:
    out = np.full((k, k), -np.inf)
    np.fill_diagonal(out, 0.0)
    return out


def product(steps: np.ndarray, add) -> np.ndarray:
    """The product of n matrices, levelled. add: _max or _lse."""
    k = steps.shape[-1]
    while len(steps) > 1:
        if len(steps) % 2:
            steps = np.concatenate([steps, _one(k)[None]])
        steps = _levelled(add(steps[0::2, :, :, None] + steps[1::2, None, :, :], 2))
    return _levelled(steps)[0] if len(steps) else _one(k)


def vectors(steps: np.ndarray, start: np.ndarray, add) -> np.ndarray:
    """start times the first t + 1 matrices, for each t; each levelled by its largest number."""
    n, k = len(steps), steps.shape[-1]
    blocks = _blocks(steps, _one(k))
    level = lambda v: v - v.max(axis=-1, keepdims=True)
    through = np.broadcast_to(_one(k), (len(blocks), k, k))
    for t in range(blocks.shape[1]):
        through = _levelled(add(through[:, :, :, None] + blocks[:, t, None, :, :], 2))
    into = np.empty((len(blocks), k))
    v = start
    for b in range(len(blocks)):
        into[b] = v
        v = level(add(v[:, None] + through[b], 0))
    out = np.empty((len(blocks), blocks.shape[1], k))
    for t in range(blocks.shape[1]):
        into = level(add(into[:, :, None] + blocks[:, t], 1))
        out[:, t] = into
    return out.reshape(-1, k)[:n]


def composed(maps: np.ndarray, last: np.ndarray) -> np.ndarray:
    """For maps m_0 .. m_(n-1) from the state after each step to the state before it: the states m_t(m_(t+1)(... last)) of each t, for every entry of last."""
    n, k = maps.shape
    length = max(1, int(np.ceil(np.sqrt(n))))
    count = -(-n // length)
    filled = np.concatenate([maps, np.broadcast_to(np.arange(k), (count * length - n, k))]).reshape(count, length, k)
    through = np.broadcast_to(np.arange(k), (count, k))
    rows = np.arange(count)[:, None]
    for t in range(length - 1, -1, -1):
        through = filled[rows, t, through]
    after = np.empty((count, len(last)), dtype=np.int64)
    s = last
    for b in range(count - 1, -1, -1):
        after[b] = s
        s = through[b][s]
    out = np.empty((count, length, len(last)), dtype=np.int64)
    for t in range(length - 1, -1, -1):
        after = filled[rows, t, after]
        out[:, t] = after
    return out.reshape(-1, len(last))[:n]


def _steps(part: pa.Table, trans: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The matrices of a bucket's rows and which rows are the first of their chain, but that of the bucket's first row is not known."""
    k = len(start)
    emit = part.column("emit").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
    first = part.column("__first").to_numpy(zero_copy_only=False)
    return np.where(first[:, None, None], start[None, None, :], trans[None]) + emit[:, None, :], first


def decode(rows: DataFrame, chain: str, position: list[str], trans: np.ndarray, start: np.ndarray) -> DataFrame:
    """rows with state (the best path), posterior (an array) and scale, whose sum over a chain is its log-likelihood.

    rows: chain, the columns of the position, emit (log densities of the K states). Ties: the
    smallest state before a step, and the largest at a chain's end. Rows without a chain or
    position or with null densities are left out; chains of one row and empty tables are no special case.
    """
    k = len(start)
    for c in (chain, *position):
        rows = rows.where(F.col(c).isNotNull())
    rows = rows.where(F.col("emit").isNotNull() & ~F.exists("emit", lambda x: x.isNull()))
    kinds = {f.name: f for f in rows.schema.fields}
    order = [chain, *position]
    dealt = ranged(rows, *order, most=BUCKET)
    # A chain's first row: the bucket where the chain begins is its smallest.
    begins = dealt.groupBy(chain).agg(F.min("__bucket").alias("__begins"))
    marked = materialize(dealt.join(begins, chain), "chains")
    forget(dealt)

    def sorted_part(part: pa.Table) -> pa.Table:
        part = part.sort_by([(c, "ascending") for c in order])
        chains = part.column(chain).combine_chunks()
        new = np.ones(part.num_rows, dtype=bool)
        new[1:] = np.array(pa.compute.not_equal(chains[1:], chains[:-1]).to_pylist(), dtype=bool)
        first = new & (part.column("__begins").to_numpy() == part.column("__bucket").to_numpy())
        return part.append_column("__first", pa.array(first))

    def multiply(part: pa.Table) -> pa.Table:
        steps, _ = _steps(sorted_part(part), trans, start)
        best, sums = product(steps, _max), product(steps, _lse)
        return pa.table({"bucket": part.column("__bucket")[:1], "best": pa.array([best.ravel().tolist()]), "sums": pa.array([sums.ravel().tolist()])})

    found = marked.groupBy("__bucket").applyInArrow(multiply, "bucket int, best array<double>, sums array<double>").orderBy("bucket").collect()
    square = lambda x: np.array(x).reshape(k, k)
    before: dict = {}
    d, a = np.zeros(k), np.zeros(k)
    for r in found:  # one product for each bucket
        before[r.bucket] = [d, a]
        d, a = _levelled(_max(d[:, None] + square(r.best), 0)[None])[0], _levelled(_lse(a[:, None] + square(r.sums), 0)[None])[0]
    b = np.zeros(k)
    for r in reversed(found):
        before[r.bucket].append(b)
        b = _levelled(_lse(square(r.sums) + b[None, :], 1)[None])[0]

    def forward(part: pa.Table) -> pa.Table:
        part = sorted_part(part)
        steps, first = _steps(part, trans, start)
        d0, a0, b0 = before[part.column("__bucket")[0].as_py()]
        delta = vectors(steps, d0, _max)
        earlier = np.concatenate([d0[None], delta[:-1]])
        back = (earlier[:, :, None] + steps).argmax(axis=1)
        # A chain's end, seen from the next chain's first row: the largest of the best states.
        ended = k - 1 - earlier[:, ::-1].argmax(axis=1)
        back[first] = ended[first][:, None]
        alpha = vectors(steps, a0, _lse)
        alpha -= _lse(alpha, 1)[:, None]
        held = np.concatenate([(a0 - _lse(a0, 0))[None], alpha[:-1]])
        scale = _lse(_lse(held[:, :, None] + steps, 1), 1)
        # Backward: the same product from the right, over the transposed steps.
        beta = np.concatenate([vectors(steps[1:][::-1].transpose(0, 2, 1), b0, _lse)[::-1], b0[None]])
        posterior = alpha + beta
        posterior = np.exp(posterior - _lse(posterior, 1)[:, None])
        end = k - 1 - delta[-1, ::-1].argmax()
        into = composed(back, np.arange(k))[0]  # the state before the bucket by the state at its last row
        listed = lambda x, kind: pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * k, pa.int32()), pa.array(x.ravel(), kind))
        out = part.drop_columns(["emit", "__first", "__begins"])
        out = out.append_column("back", listed(back, pa.int16())).append_column("posterior", listed(posterior, pa.float64())).append_column("scale", pa.array(scale))
        once = lambda x, kind: pa.array([x] + [None] * (out.num_rows - 1), kind)
        return out.append_column("into", once(into.tolist(), pa.list_(pa.int16()))).append_column("last", once(int(end), pa.int16()))

    kept = [c for c in rows.columns if c != "emit"]
    schema = ", ".join(f"`{c}` {kinds[c].dataType.simpleString()}" for c in kept)
    scanned = materialize(marked.groupBy("__bucket").applyInArrow(forward, f"{schema}, __bucket int, back array<short>, posterior array<double>, scale double, into array<short>, last short"), "forward")
    forget(marked)
    # The state at each bucket's last row, from the last bucket back: K numbers a bucket.
    ends, state = {}, None
    for r in scanned.groupBy("__bucket").agg(F.any_value("into", True).alias("into"), F.any_value("last", True).alias("last")).orderBy(F.desc("__bucket")).collect():
        ends[r["__bucket"]] = int(r["last"]) if state is None else state
        state = int(r["into"][ends[r["__bucket"]]])

    def read_back(part: pa.Table) -> pa.Table:
        part = part.sort_by([(c, "ascending") for c in order])
        back = part.column("back").combine_chunks().flatten().to_numpy().reshape(-1, k).astype(np.int64)
        last = ends[part.column("__bucket")[0].as_py()]
        states = np.concatenate([composed(back[1:], np.array([last]))[:, 0], [last]])
        return part.drop_columns(["back", "into", "last", "__bucket"]).append_column("state", pa.array(states, pa.int32()))

    return scanned.groupBy("__bucket").applyInArrow(read_back, f"{schema}, posterior array<double>, scale double, state int")


MEANS, SWITCH = [-0.5, 0.0, 0.4], 0.05
_VALUE = "(l_extendedprice / (l_quantity * 1500.0D) - 1.0D)"
_SIGMA = "(0.1D + 0.01D * (l_suppkey % 7))"


def _decoded(spark, d) -> DataFrame:
    """Prices of a supplier's lines in order of the key, as a signal of three levels."""
    means, trans, start = sticky(MEANS, SWITCH)
    keys = ["l_orderkey", "l_linenumber", "l_partkey"]
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("chain"), *keys, gaussian(_VALUE, means, variance=_SIGMA).alias("emit"))
    return decode(rows, "chain", keys, trans, start)


def _sql(select: str) -> str:
    stay, go = f"ln({1 - 2 * SWITCH}::DOUBLE)", f"ln({SWITCH}::DOUBLE)"
    lt = lambda i, j: stay if i == j else go
    value, sigma = "(l_extendedprice / (l_quantity * 1500.0::DOUBLE) - 1.0)", "(0.1::DOUBLE + 0.01::DOUBLE * (l_suppkey % 7))"
    emits = ", ".join(f"-0.5 * (ln({sigma}) + ln(2 * pi())) - 0.5 * pow({value} - ({m}::DOUBLE), 2) / {sigma} AS e{j}" for j, m in enumerate(MEANS))
    best = lambda j: ", ".join(f"d{i} + {lt(i, j)}" for i in range(3))
    lse = lambda xs: f"(greatest({', '.join(xs)}) + ln({' + '.join(f'exp({x} - greatest({', '.join(xs)}))' for x in xs)}))"
    forward = ", ".join(f"greatest({best(j)}) + o.e{j} AS d{j}" for j in range(3))
    back = ", ".join(f"CASE WHEN d0 + {lt(0, j)} >= greatest({best(j)}) THEN 0 WHEN d1 + {lt(1, j)} >= greatest({best(j)}) THEN 1 ELSE 2 END AS b{j}" for j in range(3))
    alpha = ", ".join(f"{lse([f'a{i} + {lt(i, j)}' for i in range(3)])} + o.e{j} AS a{j}" for j in range(3))
    beta = ", ".join(lse([f"{lt(i, j)} + n.e{j} + r.b{j}" for j in range(3)]) + f" AS b{i}" for i in range(3))
    return f"""WITH RECURSIVE o AS MATERIALIZED (SELECT l_suppkey AS chain, l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) AS t, count(*) OVER (PARTITION BY l_suppkey) AS n, {emits} FROM lineitem),
f AS (SELECT chain, t, {', '.join(f'{lt(1, j)} + e{j} AS d{j}' for j in range(3))}, {', '.join(f'{lt(1, j)} + e{j} AS a{j}' for j in range(3))}, 0 AS b0, 0 AS b1, 0 AS b2 FROM o WHERE t = 1
  UNION ALL SELECT o.chain, o.t, {forward}, {alpha}, {back} FROM f JOIN o ON o.chain = f.chain AND o.t = f.t + 1),
fm AS MATERIALIZED (SELECT * FROM f),
p AS (SELECT o.chain, o.t, CASE WHEN d2 >= greatest(d0, d1) THEN 2 WHEN d1 >= d0 THEN 1 ELSE 0 END AS state, b0, b1, b2 FROM fm JOIN o ON o.chain = fm.chain AND o.t = fm.t WHERE o.t = o.n
  UNION ALL SELECT fm.chain, fm.t, CASE p.state WHEN 0 THEN p.b0 WHEN 1 THEN p.b1 ELSE p.b2 END, fm.b0, fm.b1, fm.b2 FROM p JOIN fm ON fm.chain = p.chain AND fm.t = p.t - 1),
r AS (SELECT chain, t, 0.0::DOUBLE AS b0, 0.0::DOUBLE AS b1, 0.0::DOUBLE AS b2 FROM o WHERE t = n
  UNION ALL SELECT r.chain, r.t - 1, {beta} FROM r JOIN o n ON n.chain = r.chain AND n.t = r.t AND r.t > 1)
{select}"""


@register("hmm_viterbi", _sql("SELECT o.chain, l_orderkey, l_linenumber, l_partkey, state FROM p JOIN o ON o.chain = p.chain AND o.t = p.t"))
def _viterbi(spark, d):
    return _decoded(spark, d).select("chain", "l_orderkey", "l_linenumber", "l_partkey", "state")


_W = [f"exp(fm.a{i} + r.b{i} - greatest(fm.a0 + r.b0, fm.a1 + r.b1, fm.a2 + r.b2))" for i in range(3)]


@register("hmm_posteriors", _sql("SELECT o.chain, l_orderkey, l_linenumber, l_partkey, " + ", ".join(f"round({_W[i]} / ({' + '.join(_W)}), 6) AS p{i}" for i in range(3)) + " FROM fm JOIN r ON r.chain = fm.chain AND r.t = fm.t JOIN o ON o.chain = fm.chain AND o.t = fm.t"))
def _posteriors(spark, d):
    return _decoded(spark, d).select("chain", "l_orderkey", "l_linenumber", "l_partkey", *(F.round(F.col("posterior")[i], 6).alias(f"p{i}") for i in range(3)))


@register("hmm_likelihood", _sql("SELECT o.chain, o.n AS steps, round(greatest(a0, a1, a2) + ln(exp(a0 - greatest(a0, a1, a2)) + exp(a1 - greatest(a0, a1, a2)) + exp(a2 - greatest(a0, a1, a2))), 4) AS log_likelihood FROM fm JOIN o ON o.chain = fm.chain AND o.t = fm.t WHERE o.t = o.n"))
def _likelihood(spark, d):
    return _decoded(spark, d).groupBy("chain").agg(F.count("*").alias("steps"), F.round(F.sum("scale"), 4).alias("log_likelihood"))
