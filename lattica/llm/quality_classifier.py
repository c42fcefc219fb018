"""Quality by histogram gradient-boosted trees over document statistics (operator 9).

One pass turns each text into STATISTICS, which are written; trees are grown on
the statistics of a bounded sample of labelled rows (SAMPLE rows of each label):
values are binned at quantiles, and a level of a tree at a time picks for every
node the split with the largest gain from histograms of gradients. All trees are
full to their depth and lie flattened in arrays (feature, threshold, leaf), so a
batch of documents descends all trees together in numpy.

The sample's statistics, a table of at most 2 * SAMPLE rows of a few numbers, is
the only thing the driver holds; texts never leave their tasks and nothing is
shuffled but that sample.

Defined cases: null text counts as empty and is scored; a null doc_id is scored
and not held out; repeated rows are scored each, and one of an id, that of the least statistics, is learned from. If the sample lacks either
label, every score is the share of label 1 in it (0 without any). Empty tables
give no rows; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, ids, materialize, prepare, texts
from .labelled import held_out, one_row, sample

SAMPLE = 20_000
TREES, DEPTH, BINS, RATE, RIDGE, LEAST = 80, 4, 64, 0.15, 2.0, 8
THRESHOLD = 0.3

STATISTICS = (
    "words", "chars", "mean_word", "longest_word", "short_words", "distinct_words", "top_word", "repeated_next", "top_pair", "distinct_pairs",
    "lines", "duplicate_lines", "mean_line", "ended_lines", "symbols", "digits", "upper", "marks", "pipes", "exclamations", "spaces", "non_ascii", "alone_marks",
)
_SPACES = b" \t\n\x0b\x0c\r"


def statistics(text: str | None) -> list[float]:
    """The values of STATISTICS; shares are of characters, words, pairs or lines."""
    raw = (text or "").encode()
    found = raw.split()
    n, size = max(1, len(found)), max(1, len(raw))
    drop = lambda chars: len(raw) - len(raw.translate(None, chars))
    lengths = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
    kinds = Counter(found)
    pairs = Counter(zip(found, found[1:]))
    lines = [x for x in raw.split(b"\n") if x.strip(_SPACES)]
    m, p = max(1, len(lines)), max(1, len(found) - 1)
    return [
        len(found), len(raw), lengths.sum() / n, int(lengths.max()) if found else 0, (lengths <= 3).sum() / n, len(kinds) / n, max(kinds.values(), default=0) / n,
        sum(c for (a, b), c in pairs.items() if a == b) / p, max(pairs.values(), default=0) / p, len(pairs) / p,
        len(lines), (len(lines) - len(set(lines))) / m, len(raw) / m, sum(x.rstrip(_SPACES)[-1:] in b".!?" for x in lines) / m,
        drop(b"#*$%&|<>") / size, drop(b"0123456789") / size, drop(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ") / size, drop(b".,;:!?") / size, drop(b"|") / n, drop(b"!") / n,
        drop(_SPACES) / size, (len(raw) - len(raw.translate(None, bytes(range(128, 256))))) / size, sum(kinds[k] for k in (b"|", b"-", b"*", b".", b",")) / n,
    ]


class Trees:
    """Boosted trees for the logistic loss, flattened: node i of a tree has the children 2i + 1 and 2i + 2."""

    def __init__(self, trees: int = TREES, depth: int = DEPTH, bins: int = BINS, rate: float = RATE, ridge: float = RIDGE, least: int = LEAST):
        self.trees, self.depth, self.bins, self.rate, self.ridge, self.least = trees, depth, bins, rate, ridge, least
        inner = 2**depth - 1
        self.feature = np.zeros((trees, inner), dtype=np.int64)
        self.threshold = np.full((trees, inner), np.inf)
        self.leaf = np.zeros((trees, inner + 1))
        self.base = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        n, columns = x.shape
        share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
        self.base = float(np.log(share / (1 - share)))
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1], method="lower")) for j in range(columns)]
        binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
        raw = np.full(n, self.base)
        for t in range(self.trees):
            p = 1 / (1 + np.exp(-raw))
            gradient, hessian = p - y, p * (1 - p)
            at = np.zeros(n, dtype=np.int64)  # the node in its level
            for level in range(self.depth):
                nodes = 2**level
                gain, pick, cut = np.zeros(nodes), np.zeros(nodes, dtype=np.int64), np.full(nodes, -1)
                for j in range(columns):
                    where = at * self.bins + binned[:, j]
                    g, h, c = (np.bincount(where, weights=v, minlength=nodes * self.bins).reshape(nodes, self.bins).cumsum(axis=1) for v in (gradient, hessian, np.ones(n)))
                    score = lambda a, b: a * a / (b + self.ridge)
                    new = score(g, h) + score(g[:, -1:] - g, h[:, -1:] - h) - score(g[:, -1:], h[:, -1:])
                    new[(c < self.least) | (c[:, -1:] - c < self.least)] = 0
                    new[:, len(cuts[j]) :] = 0
                    best = new.argmax(axis=1)
                    better = new[np.arange(nodes), best] > gain + 1e-9
                    gain[better], pick[better], cut[better] = new[np.arange(nodes), best][better], j, best[better]
                for i in range(nodes):
                    if cut[i] >= 0:
                        self.feature[t, nodes - 1 + i], self.threshold[t, nodes - 1 + i] = pick[i], cuts[pick[i]][cut[i]]
                right = (cut[at] >= 0) & (binned[np.arange(n), pick[at]] > cut[at])
                at = 2 * at + right
            leaves = 2**self.depth
            self.leaf[t] = -self.rate * np.bincount(at, weights=gradient, minlength=leaves) / (np.bincount(at, weights=hessian, minlength=leaves) + self.ridge)
            raw += self.leaf[t][at]
        return self

    def scores(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros((len(x), self.trees), dtype=np.int64)
        tree, row = np.arange(self.trees)[None, :], np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = 2 * at + 1 + (x[row, self.feature[tree, at]] > self.threshold[tree, at])
        return 1 / (1 + np.exp(-(self.base + self.leaf[tree, at - self.feature.shape[1]].sum(axis=1))))


def measured(docs: DataFrame) -> DataFrame:
    """doc_id and the STATISTICS of each row, in columns of their names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = np.array([statistics(t) for t in texts(batch)], dtype=np.float64).reshape(-1, len(STATISTICS))
            yield pa.record_batch([ids(batch).cast(pa.int64()), *(pa.array(table[:, j]) for j in range(len(STATISTICS)))], names=["doc_id", *STATISTICS])

    prepare(docs.sparkSession)
    return documents(docs).mapInArrow(run, "doc_id long, " + ", ".join(f"{s} double" for s in STATISTICS))


def classify(docs: DataFrame, labels: DataFrame, most: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted per row of docs."""
    spark = docs.sparkSession
    known = materialize(measured(docs), "statistics")
    rows = one_row(known.join(F.broadcast(sample(labels, "quality", most)), "doc_id"), *STATISTICS).orderBy("doc_id").select("label", *STATISTICS).toPandas()
    x, y = rows[list(STATISTICS)].to_numpy(dtype=np.float64), rows["label"].to_numpy(dtype=np.float64)
    held = held_out(F.col("doc_id")).alias("held_out")
    if len(set(y.tolist())) < 2:
        score = F.lit(float(y.mean()) if len(y) else 0.0)
        return known.select("doc_id", held, score.alias("score"), (score >= threshold).cast("int").alias("predicted"))
    shared = spark.sparkContext.broadcast(Trees().fit(x, y))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = np.stack([batch.column(j + 1).to_numpy() for j in range(len(STATISTICS))], axis=1)
            yield pa.record_batch([batch.column(0), pa.array(np.round(shared.value.scores(table), 6))], names=["doc_id", "score"])

    scored = known.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held, "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def query(spark, sf_dir: str) -> DataFrame:
    from .common import read

    return classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
