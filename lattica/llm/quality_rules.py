"""Quality rules with suffix-array repetition (operator 8).

Per document, a suffix array over the words is built by prefix doubling. The
longest common prefixes of neighbours in it are the LCP intervals: a suffix
whose longest common prefix with a neighbour is L >= min_repeat starts a
maximal repeated substring of L words. The spans of all of them are united;
the verdict limits the share of the characters of the words that they cover
and the length of the longest repeat.

A document is judged alone, so the work is one pass of tasks over the table
without a shuffle; a long text costs n log n in its own task.

Defined cases: a null text has no words and counts as empty (it fails the base
rule); a null doc_id is passed through; repeated rows are judged each; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, ids, per_batch, prepare, texts
from .words import word_hashes

MIN_REPEAT = 5
MIN_WORDS = 10
#: Per cent of the words that repeats may cover before the base rule fails.
MAX_REPEAT_WORDS = 20
#: Per cent of the characters of words that repeats may cover.
MAX_COVERED_CHARS = 25
#: Words in the longest repeat that is tolerated.
MAX_LONGEST = 100

_SPACES, _SYMBOLS = b" \t\n\x0b\x0c\r", b"#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_chars", "longest_repeat")
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, covered_chars long, longest_repeat long"


def longest_repeats(tokens: np.ndarray) -> np.ndarray:
    """For each position the length of the longest substring that starts there and occurs elsewhere too (overlaps count)."""
    n = len(tokens)
    if n < 2:
        return np.zeros(n, dtype=np.int64)
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    levels, width = [rank], 1
    while rank.max() < n - 1 and width < n:
        second = np.zeros(n, dtype=np.int64)
        second[: n - width] = rank[width:] + 1
        rank = np.unique(rank * (n + 1) + second, return_inverse=True)[1].astype(np.int64)
        levels.append(rank)
        width *= 2
    order = np.argsort(rank, kind="stable")
    a, b = order[:-1].copy(), order[1:].copy()
    lcp = np.zeros(n - 1, dtype=np.int64)
    for k in range(len(levels) - 1, -1, -1):
        step = 1 << k
        # A suffix shorter than the step has a rank too, so only full steps count.
        at = np.flatnonzero(np.maximum(a, b) + step <= n)
        at = at[levels[k][a[at]] == levels[k][b[at]]]
        lcp[at] += step
        a[at] += step
        b[at] += step
    longest = np.zeros(n, dtype=np.int64)
    longest[order[:-1]] = lcp
    np.maximum.at(longest, order[1:], lcp)
    return longest


def covered(longest: np.ndarray, min_repeat: int = MIN_REPEAT) -> np.ndarray:
    """Which positions lie in a repeat of at least min_repeat words."""
    n = len(longest)
    starts = np.flatnonzero(longest >= min_repeat)
    if not len(starts):
        return np.zeros(n, dtype=bool)
    step = np.zeros(n + 1, dtype=np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + longest[starts], -1)
    return np.cumsum(step[:n]) > 0


def measure(text: str | None) -> tuple[int, ...]:
    """The values of COUNTS for one text."""
    text = text or ""
    raw = text.encode()
    hashes = word_hashes(raw)
    n = len(hashes)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if line in seen:
            dup += 1
        elif line.encode().strip(_SPACES):
            seen.add(line)
    chars = len(text) - (len(raw) - len(raw.translate(None, _SPACES)))
    longest = longest_repeats(hashes)
    cover = covered(longest)
    in_repeats = 0
    if cover.any():
        in_repeats = sum(len(w.decode()) for w, c in zip(raw.split(), cover.tolist()) if c)
    top = int(longest.max()) if n else 0
    return n, chars, len(raw) - len(raw.translate(None, _SYMBOLS)), dup, int(cover.sum()), in_repeats, top


def _batch(batch: pa.RecordBatch) -> pa.RecordBatch:
    rows = [measure(t) for t in texts(batch)]
    columns = list(zip(*rows)) or [[]] * len(COUNTS)
    return pa.record_batch([ids(batch).cast(pa.int64()), *(pa.array(c, pa.int64()) for c in columns)], names=["doc_id", *COUNTS])


def quality_rules(docs: DataFrame, max_covered_chars: int = MAX_COVERED_CHARS, max_longest: int = MAX_LONGEST) -> DataFrame:
    """One row per row of docs: the counts, base_failed and kept."""
    prepare(docs.sparkSession)
    found = documents(docs).mapInArrow(per_batch(_batch), "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_WORDS * F.col("n_words"))
    verdict = (100 * F.col("covered_chars") <= max_covered_chars * F.col("word_chars")) & (F.col("longest_repeat") <= max_longest)
    return found.select("doc_id", *COUNTS[:5], failed.alias("base_failed"), (~failed & verdict).alias("kept"), *COUNTS[5:])


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, that the rules keep. Judged in the same pass, without a join."""
    prepare(docs.sparkSession)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        good = []
        for t in texts(batch):
            n, chars, _, _, repeat, inside, top = measure(t)
            good.append(n >= MIN_WORDS and 100 * repeat <= MAX_REPEAT_WORDS * n and 100 * inside <= MAX_COVERED_CHARS * chars and top <= MAX_LONGEST)
        return batch.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(per_batch(run), docs.schema)


ORACLE = rf"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + {MIN_REPEAT - 1}], ' ') AS s FROM w, unnest(range(1, len(ws) - {MIN_REPEAT - 2})) AS r(i) WHERE len(ws) >= {MIN_REPEAT}),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS c FROM win) WHERE c > 1),
cov AS (SELECT DISTINCT doc_id, j FROM again, unnest(range(i, i + {MIN_REPEAT})) AS r(j)),
cc AS (SELECT cov.doc_id, count(*) AS n_repeat_words, sum(length(w.ws[cov.j])) AS covered_chars FROM cov JOIN w USING (doc_id) GROUP BY cov.doc_id),
run AS (SELECT doc_id, j, j - row_number() OVER (PARTITION BY doc_id ORDER BY j) AS g FROM cov),
spans AS (SELECT doc_id, min(j) AS a, max(j) AS b FROM run GROUP BY doc_id, g HAVING count(*) > 1),
lng AS (SELECT DISTINCT doc_id FROM (SELECT s.doc_id, md5(array_to_string(w.ws[p:p + {MAX_LONGEST}], ' ')) AS h, p FROM spans s JOIN w USING (doc_id), unnest(range(s.a, s.b - {MAX_LONGEST} + 1)) AS r(p)) GROUP BY doc_id, h HAVING count(*) > 1),
ln AS (SELECT doc_id, line FROM w, unnest(string_split(text, chr(10))) AS r(line) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dl AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM ln GROUP BY doc_id),
b AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(dl.n, 0)::BIGINT AS n_dup_lines,
  coalesce(cc.n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(cc.covered_chars, 0)::BIGINT AS covered_chars, lng.doc_id IS NOT NULL AS too_long
  FROM w LEFT JOIN cc USING (doc_id) LEFT JOIN dl USING (doc_id) LEFT JOIN lng USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_WORDS} * n_words) AS base_failed,
  NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_WORDS} * n_words) AND 100 * covered_chars <= {MAX_COVERED_CHARS} * word_chars AND NOT too_long AS kept,
  covered_chars
FROM b
"""


def query(spark, sf_dir: str) -> DataFrame:
    from .common import read

    return quality_rules(read(spark, sf_dir, "documents")).drop("longest_repeat")
