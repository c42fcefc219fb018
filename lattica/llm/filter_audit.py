"""Filter interaction audit by long-form window evaluation (operator 13).

Which filter removes a document depends on the order in which filters run. Each
document has a mask of the filters that it fails. Masks are counted per part, so a
part is at most 2**k cells, whatever its number of documents. Cells are unpivoted
against every step of every order; a running bit-or window over the steps of an order
holds the failures of earlier steps; conditional sums over cells give the metrics of a
step, and a window over a filter's rows its total over all orders.

Duplicates (filter E) are known by a digest of the whole text: a document fails if
its id is larger than the smallest id of the digest. Only digests, ids and masks are
shuffled, never texts. The join by digest has one row a digest on its other side, so
copies of one text may be split over tasks.

Defined cases: a null text is an empty one, so null and empty texts are copies of one
another; a null source is the empty part; a null doc_id is no copy of anything, and
nothing is a copy of it; rows that repeat a doc_id and text count each and are no copies
by that alone; a document without a label counts in neither lost column, and one with
several labels counts as its largest. An empty table gives no rows. Other columns are
not read.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

FILTERS = "ABCDE"
MIN_WORDS, MIN_DISTINCT, MAX_UPPER = 50, 65, 5
SYMBOLS = "[#$%&*|]"
WORD = r"[^\x20\x09-\x0D]+"


def text_failures(text: Column) -> dict[str, Column]:
    """Whether a text fails the filters A to D."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    n = F.size(words)
    upper = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {"A": n < MIN_WORDS, "B": 100 * F.size(F.array_distinct(words)) < MIN_DISTINCT * n, "C": 100 * upper > MAX_UPPER * F.length(text), "D": text.rlike(SYMBOLS)}


def bits(failures: dict[str, Column], filters: str) -> Column:
    """The mask with bit i set where the i-th filter fails."""
    out = F.lit(0)
    for i, f in enumerate(filters):
        if f in failures:
            out = out.bitwiseOR(F.when(failures[f], 1 << i).otherwise(0))
    return out


def masks(docs: DataFrame) -> DataFrame:
    """doc_id, part and mask of the five filters per row of docs."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    rows = materialize(rows.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), bits(text_failures(F.col("text")), FILTERS).alias("mask")), "masks")
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("c")).where("c > 1").drop("c")
    copy = F.when(F.col("doc_id") > F.col("first"), 1 << FILTERS.index("E")).otherwise(0)
    return rows.join(first, "digest", "left").select("doc_id", "part", F.col("mask").bitwiseOR(copy).alias("mask"))


def cells(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask and the documents there: n, good (labels.quality = 1) and toxic (labels.toxic = 1)."""
    marks = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("quality").cast("int")).alias("quality"), F.max(F.col("toxic").cast("int")).alias("toxic"))
    ones = lambda c: F.coalesce(F.sum((F.col(c) == 1).cast("long")), F.lit(0))
    return rows.join(marks, "doc_id", "left").groupBy("part", "mask").agg(F.count("*").alias("n"), ones("quality").alias("good"), ones("toxic").alias("toxic"))


def interactions(counted: DataFrame, filters: str = FILTERS) -> DataFrame:
    """The metrics of every part, order of the filters and step, from cells (part, mask, n, good, toxic) whose masks have a bit for each letter of filters."""
    orders = F.array(*(F.lit("".join(p)) for p in permutations(filters)))
    steps = counted.select("*", F.explode(orders).alias("filter_order"))
    steps = steps.select("*", F.explode(F.sequence(F.lit(1), F.lit(len(filters)))).alias("step"))
    bit = F.element_at(F.create_map(*(F.lit(x) for i, f in enumerate(filters) for x in (f, 1 << i))), F.col("filter"))
    steps = steps.withColumn("filter", F.substring("filter_order", F.col("step"), F.lit(1))).withColumn("bit", bit).withColumn("own", F.col("mask").bitwiseAND(F.col("bit")))
    before = Window.partitionBy("part", "mask", "filter_order").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    steps = steps.withColumn("earlier", F.coalesce(F.bit_or("own").over(before), F.lit(0)))
    passes, fails = F.col("earlier") == 0, F.col("own") > 0
    total = lambda what, when: F.sum(F.when(when, F.col(what)).otherwise(0)).cast("long")
    out = steps.groupBy("part", "filter_order", "step", "filter").agg(
        total("n", passes & ~fails).alias("kept"),
        total("n", passes & fails).alias("removed"),
        total("n", ~passes & fails).alias("redundant"),
        total("n", F.col("mask") == F.col("bit")).alias("unique_fails"),
        total("good", passes & fails).alias("good_lost"),
        total("toxic", passes & fails).alias("toxic_lost"),
    )
    return out.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "filter"))).drop("filter").withColumn("step", F.col("step").cast("int"))


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per part (source), order of the five filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost and shapley."""
    return interactions(cells(masks(docs), labels))


def brute_force(docs: list[tuple], labels: list[tuple]) -> list[tuple]:
    """The same rows, document by document and order by order, for tests. docs: (doc_id, text, source); labels: (doc_id, quality, toxic)."""
    import re

    least: dict = {}
    for d, t, _ in docs:
        if d is not None:
            least[t or ""] = min(d, least.get(t or "", d))
    seen = []
    for d, t, s in docs:
        t = t or ""
        words = re.findall(WORD, t)
        fails = {f for f, x in zip(FILTERS, (len(words) < 50, 100 * len(set(words)) < 65 * len(words), 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), bool(re.search(SYMBOLS, t)), d is not None and d > least[t])) if x}
        seen.append((s or "", fails, any(x == d and q == 1 for x, q, _ in labels if d is not None), any(x == d and y == 1 for x, _, y in labels if d is not None)))
    out, total = [], {}
    for part in sorted({s[0] for s in seen}):
        for order in map("".join, permutations(FILTERS)):
            left = [s for s in seen if s[0] == part]
            gone: list = []
            for step, f in enumerate(order, 1):
                here = [s for s in left if f in s[1]]
                redundant = sum(f in s[1] for s in gone)
                left = [s for s in left if f not in s[1]]
                gone += here
                total[part, f] = total.get((part, f), 0) + len(here)
                out.append([part, order, step, len(left), len(here), redundant, sum(s[0] == part and s[1] == {f} for s in seen), sum(s[2] for s in here), sum(s[3] for s in here)])
    return [(*r, total[r[0], r[1][r[2] - 1]]) for r in out]


ORACLE = rf"""
WITH w AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
f AS (SELECT t AS ft, min(doc_id) AS first FROM w GROUP BY t),
l AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
m AS MATERIALIZED (SELECT part, (len(ws) < {MIN_WORDS})::INT + 2 * (100 * len(list_distinct(ws)) < {MIN_DISTINCT} * len(ws))::INT
  + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > {MAX_UPPER} * length(t))::INT + 8 * regexp_matches(t, '{SYMBOLS}')::INT + 16 * coalesce(w.doc_id > first, false)::INT AS mask,
  coalesce(quality = 1, false) AS good, coalesce(toxic = 1, false) AS toxic
  FROM w JOIN f ON ft = t LEFT JOIN l ON l.doc_id = w.doc_id),
c AS (SELECT part, mask, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM m GROUP BY part, mask),
letters AS (SELECT i, substr('{FILTERS}', i + 1, 1) AS x, (1 << i) AS bit FROM range(5) AS r(i)),
orders AS (SELECT a.x || b.x || c.x || d.x || e.x AS o, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bs FROM letters a, letters b, letters c, letters d, letters e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND (a.bit | b.bit | c.bit | d.bit | e.bit) = 31),
s AS (SELECT o, step, bs[step] AS bit, coalesce(list_sum(bs[1:step - 1]), 0)::INT AS earlier FROM orders, unnest(range(1, 6)) AS r(step)),
g AS (SELECT part, o, step, any_value(s.bit) AS bit,
  coalesce(sum(n) FILTER (WHERE mask & earlier = 0 AND mask & bit = 0), 0) AS kept, coalesce(sum(n) FILTER (WHERE mask & earlier = 0 AND mask & bit > 0), 0) AS removed,
  coalesce(sum(n) FILTER (WHERE mask & earlier > 0 AND mask & bit > 0), 0) AS redundant, coalesce(sum(n) FILTER (WHERE mask = bit), 0) AS unique_fails,
  coalesce(sum(good) FILTER (WHERE mask & earlier = 0 AND mask & bit > 0), 0) AS good_lost, coalesce(sum(toxic) FILTER (WHERE mask & earlier = 0 AND mask & bit > 0), 0) AS toxic_lost
  FROM c, s GROUP BY part, o, step)
SELECT part, o AS filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
  good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, sum(removed) OVER (PARTITION BY part, bit)::BIGINT AS shapley FROM g
"""


def query(spark, sf_dir: str) -> DataFrame:
    from .common import read

    return filter_audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
