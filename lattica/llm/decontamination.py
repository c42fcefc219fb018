"""Benchmark decontamination by size-partitioned MinHash containment (operator 5).

A test item of n distinct shingles counts as contained in a document that has
at least t = 75 per cent of them. Under one random order of the shingles (their
64-bit hash), an item that is contained misses at most n - ceil(t n) shingles,
so the document holds one of the item's n - ceil(t n) + 1 smallest: items are
partitioned by size, and the MinHash sketch of each item keeps as many minima as
its size needs. Unlike signatures of whole documents, whose overlap with a short
item vanishes in a long document, this search loses nothing. Documents with
fewer than ceil(t n) shingles are no candidates of that size partition.
Candidates are verified by exact containment of the shingles' words.

Texts are compared in Unicode lower case and without ASCII punctuation, as words
between white space; shingles have five words. Shorter items are one shingle and
match their whole word sequence anywhere in a document.

Documents are never shuffled. The items are broadcast in blocks of at most
BLOCK_CHARS characters and the table is read once per block, so each task holds
one block whatever the size of the benchmark.

Defined cases: null or empty texts match nothing, nor do items without words;
null doc_ids are passed through; repeated rows and items match each; empty
tables give no rows; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, ids, prepare, texts
from .words import rolling, word_hashes

SHINGLE = 5
#: Per cent of an item's shingles.
CONTAINMENT = 75
BLOCK_CHARS = 8_000_000
SCHEMA = "doc_id long, item_id long, n_common long, n_item long"

_PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def normalized(text: str | None) -> bytes:
    return (text or "").lower().encode().translate(None, _PUNCTUATION)


def needed(n: int, percent: int) -> int:
    return -(-n * percent // 100)


class Items:
    """A block of test items: their shingles as word tuples, and the sketch that finds candidates."""

    def __init__(self, rows: list[tuple[int, str | None]], percent: int):
        self.items: list[tuple[int, frozenset]] = []
        short: dict[int, list[tuple[int, int]]] = {}
        for item_id, text in rows:
            raw = normalized(text)
            words = raw.split()
            if not words:
                continue
            k = min(SHINGLE, len(words))
            hashes = rolling(word_hashes(raw), k)
            distinct = dict(zip(hashes.tolist(), (tuple(words[i : i + k]) for i in range(len(hashes)))))
            minima = sorted(distinct)[: len(distinct) - needed(len(distinct), percent) + 1]
            short.setdefault(k, []).extend((h, len(self.items)) for h in minima)
            self.items.append((item_id, frozenset(distinct.values())))
        #: For each shingle length the sorted minima and, beside them, their items.
        self.sketch = {k: (np.array([h for h, _ in v], dtype=np.uint64), np.array([i for _, i in v])) for k, v in short.items()}
        self.sketch = {k: (h[o], i[o]) for k, (h, i) in self.sketch.items() for o in [np.argsort(h, kind="stable")]}
        #: Tells for the 16 top bits of a hash whether any minimum has them.
        self.seen = {k: np.bincount(h >> np.uint64(48), minlength=1 << 16) > 0 for k, (h, _) in self.sketch.items()}
        self.percent = percent

    def found_in(self, text: str | None) -> list[tuple[int, int, int]]:
        raw = normalized(text)
        words = word_hashes(raw)
        candidates: set[int] = set()
        for k, (minima, item) in self.sketch.items():
            hashes = rolling(words, k)
            hashes = np.unique(hashes[self.seen[k][hashes >> np.uint64(48)]])
            lo, hi = np.searchsorted(minima, hashes, "left"), np.searchsorted(minima, hashes, "right")
            for a, b in zip(lo[lo < hi].tolist(), hi[lo < hi].tolist()):
                candidates.update(item[a:b].tolist())
        candidates = {c for c in candidates if needed(len(self.items[c][1]), self.percent) <= len(words)}
        if not candidates:
            return []
        tokens = raw.split()
        by_length = {k: {tuple(tokens[i : i + k]) for i in range(len(tokens) - k + 1)} for k in {len(next(iter(self.items[c][1]))) for c in candidates}}
        out = []
        for c in sorted(candidates):
            item_id, own = self.items[c]
            common = len(own & by_length[len(next(iter(own)))])
            if common >= needed(len(own), self.percent):
                out.append((item_id, common, len(own)))
        return out


def blocks(benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> Iterator[list[tuple[int, str | None]]]:
    """The items in blocks whose texts have block_chars characters on average; each block comes to the driver on its own."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    total = items.agg(F.sum(F.coalesce(F.length("text"), F.lit(0)) + 64)).first()[0] or 0
    n = max(1, -(-2 * total // block_chars)) if total > block_chars else 1
    for i in range(n):
        yield [tuple(r) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i).collect()]


def contained(docs: DataFrame, benchmark: DataFrame, percent: int = CONTAINMENT, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per document and test item that it contains, with the shingles in common and the item's."""
    spark = docs.sparkSession
    prepare(spark)
    docs = documents(docs)

    def probe(rows: list[tuple[int, str | None]]) -> DataFrame:
        shared = spark.sparkContext.broadcast(rows)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items = Items(shared.value, percent)
            for batch in batches:
                doc, out = [], []
                for i, text in enumerate(texts(batch)):
                    found = items.found_in(text)
                    doc += [i] * len(found)
                    out += found
                item, common, n = zip(*out) if out else ((), (), ())
                yield pa.record_batch([ids(batch).cast(pa.int64()).take(pa.array(doc, pa.int64())), pa.array(item, pa.int64()), pa.array(common, pa.int64()), pa.array(n, pa.int64())], names=["doc_id", "item_id", "n_common", "n_item"])

        return docs.mapInArrow(run, SCHEMA)

    return reduce(DataFrame.unionAll, [probe(rows) for rows in blocks(benchmark, block_chars)])


def keep_clean(docs: DataFrame, benchmark: DataFrame, percent: int = CONTAINMENT, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of docs, with all their columns, that contain no test item. Judged in the pass itself, without a join."""
    spark = docs.sparkSession
    prepare(spark)
    for rows in blocks(benchmark, block_chars):
        shared = spark.sparkContext.broadcast(rows)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items = Items(shared.value, percent)
            for batch in batches:
                yield batch.filter(pa.array([not items.found_in(t) for t in texts(batch)], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def brute_force(docs: list[tuple], items: list[tuple], percent: int = CONTAINMENT) -> list[tuple]:
    """The same rows from plain sets, for tests."""

    def grams(words: list, k: int) -> Counter:
        return Counter(tuple(words[i : i + k]) for i in range(len(words) - k + 1))

    out = []
    for doc_id, text in docs:
        words = normalized(text).split()
        for item_id, item in items:
            own = normalized(item).split()
            k = min(SHINGLE, len(own))
            if own and (n := len(a := grams(own, k))) and 100 * (c := len(a.keys() & grams(words, k).keys())) >= percent * n:
                out.append((doc_id, item_id, c, n))
    return out


ORACLE = rf"""
WITH norm AS (SELECT 0 AS kind, doc_id AS id, lower(coalesce(text, '')) AS t FROM documents UNION ALL SELECT 1, item_id, lower(coalesce(text, '')) FROM benchmark),
w AS (SELECT kind, id, regexp_extract_all(regexp_replace(t, '[!-/:-@\[-`{{-~]', '', 'g'), '[^\x20\x09-\x0D]+') AS ws FROM norm),
g AS (SELECT DISTINCT kind, id, array_to_string(ws[i:i + {SHINGLE - 1}], ' ') AS s FROM w, unnest(range(1, len(ws) - {SHINGLE - 2})) AS r(i) WHERE len(ws) >= {SHINGLE}),
n AS (SELECT id, count(*) AS n_item FROM g WHERE kind = 1 GROUP BY id)
SELECT d.id AS doc_id, b.id AS item_id, count(*)::BIGINT AS n_common, n.n_item::BIGINT AS n_item
FROM g d JOIN g b ON d.kind = 0 AND b.kind = 1 AND d.s = b.s JOIN n ON n.id = b.id
GROUP BY d.id, b.id, n.n_item HAVING 100 * count(*) >= {CONTAINMENT} * n.n_item
"""


def query(spark, sf_dir: str) -> DataFrame:
    from .common import read

    return contained(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
