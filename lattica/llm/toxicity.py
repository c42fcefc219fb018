"""Toxicity by class-conditional Kneser-Ney models (operator 6).

Two models, of toxic and of ordinary words, predict a word's characters from the
ones before them and share what they back off to. The class counts condition on
the whole start of the word up to each character and its end mark, with absolute discounting;
the discounted mass goes to shared lower orders of character n-grams, whose
Kneser-Ney continuation counts come from every text of the corpus. So inflected
or rare forms of an expression are told by the start that they share with known
ones, and what neither model knows tells nothing: there both back off to the
same value, and only their backoff weights differ.

A word's evidence is the difference of its toxic and ordinary log-likelihood. A
document's is the mean of its three largest (different words), its largest, and
the difference over the whole text per character; a logistic function fitted on
labelled rows that the models have not seen (fold 4) turns them into a score.

Scale. Only the class counts are fitted on a bounded sample (SAMPLE rows of each
label), and every start of its words counts; the shared counts are summed over all
texts, per task first. Counts, probabilities and their logarithms stay Spark
tables. Starts are told apart by 64-bit hashes, so the driver and the broadcast
hold 16 bytes for each start of the sample and each one that goes on, whatever
their length (two of a million starts meet with a chance of about 3 in 10**8).
Scoring is one pass without a shuffle.

Defined cases: a null, empty or wordless text has no evidence and gets the score
of zero evidence; a null doc_id is scored and not held out; repeated rows are
scored each. If either label is missing from the sample, or the tables are empty,
every score is 0. Other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, ids, materialize, prepare, texts
from .labelled import held_out, one_row, sample
from .words import mix, powers

#: Of the shared model, with the character that is predicted.
ORDER = 5
DISCOUNT = 0.75
SAMPLE = 20_000
#: Words and grams that a task holds before it passes counts on.
HELD = 200_000
#: Characters that a word's likelihood spreads over when nothing is known.
ALPHABET = 200
SCHEMA = "doc_id long, held_out boolean, score double, predicted int"

#: Rows in a batch of counts.
ROWS = 100_000

_WORD = re.compile(r"[^\W\d_]+")
_BASE = 0x9E3779B97F4A7C15
#: The key of the empty start.
EMPTY = 0


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def grams(word: str, order: int = ORDER) -> list[str]:
    padded = "^" * (order - 1) + word + "$"
    return [padded[i : i + order] for i in range(len(word) + 1)]


def starts(found: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The starts of words and their end marks, each character with all before it: their keys word after word, the keys of the starts one character shorter, and how many each word has."""
    wholes = [w + "$" for w in found]
    sizes = np.fromiter(map(len, wholes), dtype=np.int64, count=len(wholes))
    codes = np.frombuffer("".join(wholes).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    first = np.repeat(np.cumsum(sizes) - sizes, sizes)
    at = np.arange(len(codes)) - first
    up, _ = powers(_BASE, int(sizes.max(initial=0)))
    total = np.zeros(len(codes) + 1, dtype=np.uint64)
    np.cumsum(mix(codes + np.uint64(_BASE)) * up[at], out=total[1:])
    keys = mix(total[1:] - total[first]).view(np.int64)
    shorter = np.where(at == 0, EMPTY, np.roll(keys, 1))
    return keys, shorter, sizes


def counted(docs: DataFrame, pieces: Callable[[str], list[str]]) -> DataFrame:
    """(label, gram, n) over the pieces of the words of docs (label, text)."""

    def emit(counts: dict) -> pa.RecordBatch:
        rows = [(label, g, n) for label, c in counts.items() for g, n in c.items()]
        label, gram, n = zip(*rows) if rows else ((), (), ())
        return pa.record_batch([pa.array(label, pa.int32()), pa.array(gram, pa.string()), pa.array(n, pa.int64())], names=["label", "gram", "n"])

    def expand(seen: dict, counts: dict) -> None:
        for label, c in seen.items():
            own = counts.setdefault(label, Counter())
            for word, n in c.items():
                for g in pieces(word):
                    own[g] += n
        seen.clear()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, Counter] = {}
        counts: dict[int, Counter] = {}
        for batch in batches:
            for label, text in zip(batch.column(0).to_pylist(), texts(batch)):
                seen.setdefault(label, Counter()).update(words(text))
                if sum(map(len, seen.values())) > HELD:
                    expand(seen, counts)
                    if sum(map(len, counts.values())) > HELD:
                        yield emit(counts)
                        counts.clear()
        expand(seen, counts)
        yield emit(counts)

    return docs.select("label", "text").mapInArrow(run, "label int, gram string, n long").groupBy("label", "gram").agg(F.sum("n").alias("n"))


def class_counts(docs: DataFrame, order: int) -> DataFrame:
    """(label, key, shorter, tail, n) over the starts of the words of docs (label, text): tail is what the shared model sees of a start, its last order - 1 characters."""

    def expand(seen: dict) -> Iterator[pa.RecordBatch]:
        for label, c in seen.items():
            found = list(c)
            keys, shorter, sizes = starts(found)
            n = np.repeat(np.fromiter(c.values(), dtype=np.int64, count=len(c)), sizes)
            keys, at, of = np.unique(keys, return_index=True, return_inverse=True)
            total = np.zeros(len(keys), dtype=np.int64)
            np.add.at(total, of, n)
            ends = np.cumsum(sizes)
            words_at = np.searchsorted(ends, at, side="right")
            for i in range(0, len(keys), ROWS):
                tails = []
                for w, k in zip(words_at[i : i + ROWS].tolist(), (at - (ends - sizes)[words_at])[i : i + ROWS].tolist()):
                    # The last order - 1 characters up to character k.
                    tail = (found[w] + "$")[max(0, k + 2 - order) : k + 1]
                    tails.append("^" * (order - 1 - len(tail)) + tail)
                rows = slice(i, i + ROWS)
                yield pa.record_batch([pa.array([label] * len(tails), pa.int32()), pa.array(keys[rows]), pa.array(shorter[at[rows]]), pa.array(tails, pa.string()), pa.array(total[rows])], names=["label", "key", "shorter", "tail", "n"])
        seen.clear()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, Counter] = {}
        for batch in batches:
            for label, text in zip(batch.column(0).to_pylist(), texts(batch)):
                seen.setdefault(label, Counter()).update(words(text))
                if sum(map(len, seen.values())) > HELD:
                    yield from expand(seen)
        yield from expand(seen)

    rows = docs.select("label", "text").mapInArrow(run, "label int, key long, shorter long, tail string, n long")
    return rows.groupBy("label", "key").agg(F.min("shorter").alias("shorter"), F.min("tail").alias("tail"), F.sum("n").alias("n"))


def shared_model(corpus: DataFrame, needed: DataFrame, order: int) -> DataFrame:
    """(gram, p): the probabilities of the needed grams' last characters under the shared model.

    corpus: distinct grams of the top order. needed: grams one character shorter.
    """
    levels = []
    types = corpus.select("gram").distinct()
    for k in range(order - 1, 0, -1):
        counts = materialize(types.groupBy(F.expr("substring(gram, 2)").alias("gram")).agg(F.count("*").alias("n")), "continuations")
        levels.append((k, counts))
        types = counts.select("gram")
    p = None
    for k, counts in reversed(levels):
        context = counts.groupBy(F.expr(f"substring(gram, 1, {k - 1})").alias("h")).agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
        wanted = needed.select(F.expr(f"right(gram, {k})").alias("gram")).distinct()
        wanted = wanted.join(counts, "gram", "left").withColumn("h", F.expr(f"substring(gram, 1, {k - 1})")).join(context, "h", "left")
        if p is None:
            wanted = wanted.withColumn("back", F.lit(1 / ALPHABET))
        else:
            wanted = wanted.withColumn("rest", F.expr("substring(gram, 2)")).join(p.select(F.col("gram").alias("rest"), F.col("p").alias("back")), "rest")
        own = F.greatest(F.coalesce("n", F.lit(0)) - DISCOUNT, F.lit(0.0))
        p = materialize(wanted.select("gram", F.when(F.col("total") > 0, (own + DISCOUNT * F.col("kinds") * F.col("back")) / F.col("total")).otherwise(F.col("back")).alias("p")), "shared")
    return p


def keyed(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The keys of df (key, value), sorted, and their values."""
    found = df.toArrow()
    keys, values = found.column("key").to_numpy(), found.column("value").to_numpy()
    order = np.argsort(keys)
    return keys[order], values[order]


def looked_up(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys the table has, and their values, 0 for the rest."""
    have, values = table
    # Words share their starts: each key once, and in order, which the table's pages like.
    each, of = np.unique(keys, return_inverse=True)
    at = np.minimum(np.searchsorted(have, each), len(have) - 1)
    hit = have[at] == each
    return hit[of], np.where(hit, values[at], 0.0)[of]


class Model:
    """Log-likelihood differences of known word starts, and of backing off after known ones."""

    def __init__(self, known: tuple[np.ndarray, np.ndarray], backoff: tuple[np.ndarray, np.ndarray]):
        self.known, self.backoff = known, backoff

    @classmethod
    def of(cls, counts: DataFrame, shared: DataFrame) -> Model:
        """counts: those of class_counts, with both labels. shared: the probabilities of their tails."""
        side = lambda label, value: F.coalesce(F.sum(F.when(F.col("label") == label, value)), F.lit(0))
        pairs = counts.groupBy("key").agg(F.min("shorter").alias("shorter"), F.min("tail").alias("gram"), side(0, F.col("n")).alias("n0"), side(1, F.col("n")).alias("n1"))
        contexts = counts.groupBy("shorter").agg(*(side(label, v).alias(f"{name}{label}") for label in (0, 1) for name, v in (("t", F.col("n")), ("k", F.lit(1)))))
        for label in (0, 1):
            t = F.col(f"t{label}")
            contexts = contexts.withColumn(f"w{label}", F.when(t > 0, DISCOUNT * F.col(f"k{label}") / t).otherwise(1.0))

        def p(label: int) -> Column:
            t = F.col(f"t{label}")
            own = F.when(t > 0, F.greatest(F.col(f"n{label}") - DISCOUNT, F.lit(0.0)) / t).otherwise(0.0)
            return own + F.col(f"w{label}") * F.col("p")

        known = pairs.join(contexts, "shorter").join(shared, "gram").select("key", F.log(p(1) / p(0)).alias("value"))
        return cls(keyed(known), keyed(contexts.select(F.col("shorter").alias("key"), F.log(F.col("w1") / F.col("w0")).alias("value"))))

    def evidence(self, found: list[str]) -> list[float]:
        """A value per word: what its known starts say, and the backoff after the last of them."""
        if not found:
            return []
        keys, shorter, sizes = starts(found)
        hit, value = looked_up(self.known, keys)
        first = np.cumsum(sizes) - sizes
        missed = np.cumsum(~hit)
        inside = missed == np.repeat(missed[first] - ~hit[first], sizes)  # nothing shorter is unknown
        total = np.add.reduceat(np.where(inside, value, 0.0), first)
        length = np.add.reduceat(inside.astype(np.int64), first)
        short = length < sizes
        total[short] += looked_up(self.backoff, shorter[(first + length)[short]])[1]
        return total.tolist()


class Scorer:
    """rows(texts): their features, with a bounded memory of words."""

    def __init__(self, model: Model):
        self.model = model
        self.of: dict[str, float] = {}

    def rows(self, batch: list[str | None]) -> Iterator[tuple[float, float, float]]:
        held: list[list[str]] = []
        size = 0
        for text in batch:
            held.append(words(text))
            size += len(held[-1])
            if size > HELD // 4:
                yield from self._rows(held)
                held, size = [], 0
        yield from self._rows(held)

    def _rows(self, held: list[list[str]]) -> Iterator[tuple[float, float, float]]:
        of = self.of
        if len(of) > HELD:
            of.clear()
        new = list({w for found in held for w in found if w not in of})
        of.update(zip(new, self.model.evidence(new)))
        return map(self.features, held)

    def features(self, found: list[str]) -> tuple[float, float, float]:
        if not found:
            return 0.0, 0.0, 0.0
        of = self.of
        total = [of[w] for w in found]
        chars = sum(map(len, found)) + len(found)
        best = sorted(dict(zip(found, total)).values(), reverse=True)[:3]
        return sum(best) / 3, best[0], sum(total) / chars


def fit_logistic(x: np.ndarray, y: np.ndarray, steps: int = 60, ridge: float = 1e-3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Newton's method on standardised columns, a label's rows weighted by the inverse root of their number: (mean, deviation, weights with the constant last)."""
    mean, deviation = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.hstack([(x - mean) / deviation, np.ones((len(x), 1))])
    share = 1 / np.sqrt(np.where(y == 1, (y == 1).sum(), (y == 0).sum()))
    share /= share.sum()
    w = np.zeros(z.shape[1])
    penalty = np.full(z.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        gradient = z.T @ (share * (p - y)) + penalty * w
        hessian = (z * (share * p * (1 - p))[:, None]).T @ z + np.diag(penalty)
        w -= np.linalg.solve(hessian, gradient)
    return mean, deviation, w


def toxicity(docs: DataFrame, labels: DataFrame, order: int = ORDER, most: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score and predicted per row of docs."""
    spark = docs.sparkSession
    prepare(spark)
    docs = documents(docs)
    chosen = materialize(sample(labels, "toxic", most), "labels")
    known = docs.join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "fold", F.coalesce("text", F.lit("")).alias("text"))
    training = materialize(one_row(known.withColumn("hash", F.xxhash64("text")), "hash", "text").select("label", "fold", "text"), "training")
    counts = materialize(class_counts(training.where("fold <> 4"), order), "counts")
    if counts.select("label").distinct().count() < 2:
        return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    corpus = materialize(counted(docs.withColumn("label", F.lit(0)), lambda w: grams(w, order)), "corpus")
    model = Model.of(counts, shared_model(corpus, counts.select(F.col("tail").alias("gram")).distinct(), order))
    shared = spark.sparkContext.broadcast(model)

    def evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            rows = list(scorer.rows(texts(batch)))
            a, b, c = zip(*rows) if rows else ((), (), ())
            yield pa.record_batch([batch.column(0), pa.array(a, pa.float64()), pa.array(b, pa.float64()), pa.array(c, pa.float64())], names=["key", "a", "b", "c"])

    seen = training.where("fold = 4").select(F.col("label").cast("long").alias("key"), "text").mapInArrow(evidence, "key long, a double, b double, c double").collect()
    x, y = np.array([r[1:] for r in seen], dtype=float).reshape(-1, 3), np.array([r[0] for r in seen])
    if len(set(y.tolist())) < 2:  # too few labelled rows to calibrate on
        x, y = np.array([[0.0] * 3, [0.1] * 3, [1.0] * 3, [0.9] * 3]), np.array([0, 0, 1, 1])
    mean, deviation, w = (v.tolist() for v in fit_logistic(x, y))
    z = F.lit(w[3]) + sum(((F.col(c) - m) / d * k for c, m, d, k in zip("abc", mean, deviation, w)), F.lit(0.0))
    score = F.round(1 / (1 + F.exp(-z)), 6)
    out = docs.mapInArrow(evidence, "key long, a double, b double, c double").withColumn("score", score)
    return out.select(F.col("key").alias("doc_id"), held_out(F.col("key")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def query(spark, sf_dir: str) -> DataFrame:
    from .common import read

    return toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
