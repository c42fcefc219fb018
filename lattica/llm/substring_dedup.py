"""Substring dedup with repeated-phrase automata (operator 1).

A window is 50 consecutive words of a document. A word goes if a window that
covers it has the same words as a window of a document with a smaller doc_id.

1. Phrases. Winnowing picks from every window its 20-word phrase with the smallest
   hash, one phrase in about sixteen positions; equal windows pick the same. A
   count over all documents confirms the phrases that recur in several.
2. Automata. Confirmed phrases are dealt into shards, those of one passage together:
   by the first document that holds them, from which their words are read. A shard's
   phrases become an Aho-Corasick automaton (pyahocorasick) over word numbers, each
   written as two or three symbols, as a node's children are searched in turn. Every
   document streams through the automata of all shards of which it may hold a phrase;
   where a phrase occurs, the automaton alone tells, from the words.
   Documents are streamed in pieces of STRIDE windows, so that a shard gets what lies
   around its phrases and not the rest of a long document.
3. Windows whose picked phrase was located are compared in the shard. Equal ones pick
   the same phrase, so they meet there. Those that also start in a smaller document
   mark their words; the kept words of documents with marks are joined and digested.
   Others were digested in 1.

Scale. A shard has about SHARD_PHRASES phrases. Its pieces are salted into groups
of about GROUP_WORDS words, so that a passage in a third of all documents fills no
task; such groups first reduce their windows to one row each, and only these rows,
under a 128-bit digest of the words, meet the least document of all groups. Windows
are told apart inside a group by 128 bits too, over exact word numbers. Texts are
shuffled only for documents with confirmed phrases, and again in pieces.

Defined cases: a null or empty text has no words (n_words 0, digest of the empty
string); a row with a null doc_id keeps all words and is never the earlier one;
repeated rows and equal doc_ids are reported each and do not remove one another;
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, documents, ids, materialize, prepare, texts, with_ids
from .words import mix, rolling, word_hashes

WINDOW = 50
PHRASE = 20
#: Windows of a piece of a document, which has WINDOW - 1 words more.
STRIDE = 256
#: Phrases of a shard, and words of a group of pieces that its automaton streams, on average.
SHARD_PHRASES, GROUP_WORDS = 5_000, 800_000
#: Windows whose phrases are picked at once, and values of a symbol.
AT_ONCE, BASE = 1 << 15, 256


def winnowed(words: np.ndarray, window: int = WINDOW, phrase: int = PHRASE) -> tuple[np.ndarray, np.ndarray]:
    """The hash of the phrase at each position, and for each window the position of its phrase."""
    if len(words) < window:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    hashes = rolling(words, phrase)
    inside = np.lib.stride_tricks.sliding_window_view(hashes, window - phrase + 1)
    picked = [inside[i : i + AT_ONCE].argmin(axis=1) for i in range(0, len(inside), AT_ONCE)]
    return hashes, np.concatenate(picked) + np.arange(len(inside))


def tag(digest: str) -> int:
    """31 bits that tell rows with equal doc_ids and other words apart."""
    return int(digest[:8], 16) >> 1


def profile(docs: DataFrame, window: int, phrase: int) -> DataFrame:
    """doc_id, n_words, kept_sha256 of all words and, for each piece, the distinct winnowed phrases with the piece's number, per row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, digest, phrases, pieces = [], [], [], []
            for t in texts(batch):
                raw = (t or "").encode()
                words = word_hashes(raw)
                hashes, at = winnowed(words, window, phrase)
                n.append(len(words))
                digest.append(hashlib.sha256(b" ".join(raw.split())).hexdigest())
                piece = np.arange(len(at)) // STRIDE
                new = np.flatnonzero((np.diff(at, prepend=-1) != 0) | (np.diff(piece, prepend=-1) != 0))
                phrases.append(hashes[at[new]].view(np.int64))
                pieces.append(piece[new])
            yield pa.record_batch([ids(batch).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(digest, pa.string()), pa.array(phrases, pa.list_(pa.int64())), pa.array(pieces, pa.list_(pa.int32()))], names=["doc_id", "n_words", "kept_sha256", "phrase", "piece"])

    return docs.mapInArrow(run, "doc_id long, n_words long, kept_sha256 string, phrase array<long>, piece array<int>")


def pieces(docs: DataFrame, routed: DataFrame, window: int, phrase: int) -> DataFrame:
    """(shard, doc_id, tag, at, words): the pieces of documents that go to a shard, and where they start; and with a null doc_id the words of the shard's phrases, read from the first document that holds each. routed: doc_id, pieces, own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text, to, own in zip(ids(batch).to_pylist(), texts(batch), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                raw = (text or "").encode()
                words = raw.split()
                name = tag(hashlib.sha256(b" ".join(words)).hexdigest())
                for p in to:
                    at = p["piece"] * STRIDE
                    part = words[at : at + STRIDE + window - 1]
                    if len(part) >= window:
                        rows.append((p["shard"], doc, name, at, b" ".join(part)))
                if own:
                    hashes, at = winnowed(word_hashes(raw), window, phrase)
                    at = np.unique(at)
                    shard = {p["phrase"]: p["shard"] for p in own}
                    for p, h in zip(at.tolist(), hashes[at].view(np.int64).tolist()):
                        if (of := shard.pop(h, None)) is not None:
                            rows.append((of, None, None, None, b" ".join(words[p : p + phrase])))
            columns = list(zip(*rows)) or [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names=["shard", "doc_id", "tag", "at", "words"])

    return with_ids(docs, routed).select("doc_id", "text", "pieces", "own").mapInArrow(run, "shard long, doc_id long, tag long, at long, words binary")


def spans(places: np.ndarray, width: int) -> list[int]:
    """The union of [p, p + width) over sorted places as starts and ends in turn."""
    new = np.flatnonzero(np.diff(places, prepend=places[:1] - width - 1) > width)
    return np.stack([places[new], places[np.append(new[1:] - 1, len(places) - 1)] + width], axis=1).ravel().tolist() if len(places) else []


def spread(doc: np.ndarray, place: np.ndarray, width: int) -> tuple[list, list, list]:
    """Marked windows (document, place with the tag in its upper half) as documents, tags and their spans."""
    order = np.lexsort((place, doc))
    doc, place = doc[order], place[order]
    row = np.flatnonzero((np.diff(doc, prepend=doc[:1] - 1) != 0) | (np.diff(place >> 32, prepend=-1) != 0))
    parts = np.split(place & 0xFFFFFFFF, row[1:]) if len(row) else []
    return doc[row].tolist(), (place[row] >> 32).tolist(), [spans(p, width) for p in parts]


GROUP = "shard long, salt long, doc_id long, tag long, spans array<int>, window binary, first long, last long, docs array<long>, places array<long>"


def symbols(numbers: np.ndarray, width: int) -> str:
    """Numbers as text, width symbols each; symbols of different places differ."""
    return np.stack([(numbers // BASE**d) % BASE + 1 + d * BASE for d in range(width)], axis=-1).astype("<u4").tobytes().decode("utf-32-le")


def automaton(phrases: list[str]) -> ahocorasick.Automaton:
    out = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for p in phrases:
        out.add_word(p, 1)
    out.make_automaton()
    return out


def marks(rows: list[tuple[int, int, int, bytes]], phrases: list[bytes], alone: bool, window: int, phrase: int, name: tuple[int, int] = (0, 0)) -> pa.Table:
    """What a group of pieces (doc_id, tag, at, words) tells of its windows around phrases of the shard. name: its shard and salt.

    alone: the group is its whole shard, so marked windows come out as spans. Else each
    distinct window comes out with its digest, its first and last document and its places.
    """
    columns = {f.split()[0]: [] for f in GROUP.split(", ")}
    kinds = {"long": pa.int64(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64())}
    if rows and phrases:
        number = defaultdict(count(1).__next__).__getitem__
        patterns = np.fromiter(map(number, b" ".join(phrases).split()), dtype=np.int64)
        known = int(patterns.max())
        width = 2 if known < BASE**2 else 3 if known < BASE**3 else 4
        pattern = symbols(patterns, width)
        machine = automaton([pattern[i : i + phrase * width] for i in range(0, len(pattern), phrase * width)])
        raw = b" ".join([r[3] for r in rows])
        words = raw.split()
        numbers = np.fromiter(map(number, words), dtype=np.int64, count=len(words))
        located = np.zeros(len(words), dtype=bool)
        ends = np.fromiter((end for end, _ in machine.iter(symbols(np.where(numbers <= known, numbers, 0), width))), dtype=np.int64)
        located[(ends + 1) // width - phrase] = True
        size = np.array([r[3].count(b" ") + 1 for r in rows])
        row = np.repeat(np.arange(len(rows)), size)
        at = np.arange(len(words)) - np.repeat(np.cumsum(size) - size, size)
        picks = winnowed(word_hashes(raw), window, phrase)[1]
        place = np.flatnonzero(located[picks] & (at + window <= size[row])[: len(picks)])
        doc = np.array([r[0] for r in rows], dtype=np.int64)[row[place]]
        one, two = (rolling(mix(numbers.astype(np.uint64) + np.uint64(salt)), window)[place] for salt in (0, 1 << 40))
        order = np.lexsort((doc, two, one))
        doc, one, two, place = doc[order], one[order], two[order], place[order]
        start = np.flatnonzero((np.diff(one, prepend=~one[:1]) != 0) | (np.diff(two, prepend=~two[:1]) != 0))
        end = np.append(start[1:], len(doc))
        where = at[place] + np.array([r[2] + (r[1] << 32) for r in rows], dtype=np.int64)[row[place]]
        if alone:
            later = doc > np.repeat(doc[start], end - start)
            columns["doc_id"], columns["tag"], columns["spans"] = spread(doc[later], where[later], window)
        elif len(start):
            columns["window"] = [hashlib.blake2b(b" ".join(words[i : i + window]), digest_size=16).digest() for i in place[start].tolist()]
            columns["first"], columns["last"] = doc[start], doc[end - 1]
            columns["docs"], columns["places"] = (pa.ListArray.from_arrays(pa.array(np.append(start, len(doc)), pa.int32()), pa.array(c)) for c in (doc, where))
    n = max(map(len, columns.values()))
    columns["shard"], columns["salt"] = [name[0]] * n, [name[1]] * n
    return pa.table({c: pa.array(columns[c], kinds[k]) if len(columns[c]) else pa.nulls(n, kinds[k]) for c, k in (f.split() for f in GROUP.split(", "))})


def marked(docs: DataFrame, phrases: DataFrame, recurs: DataFrame, window: int, phrase: int, group_words: int) -> DataFrame:
    """(doc_id, tag, spans): the words to remove, of each row a few times. phrases: doc_id, piece, phrase. recurs: phrase, first, shard."""
    routed = phrases.join(recurs, "phrase").groupBy("doc_id")
    routed = materialize(routed.agg(F.collect_set(F.struct("piece", "shard")).alias("pieces"), F.collect_set(F.when(F.col("first") == F.col("doc_id"), F.struct("phrase", "shard"))).alias("own")), "routed")
    large = routed.select(F.explode("pieces.shard").alias("shard")).groupBy("shard").agg(F.ceil(F.count("*") * (STRIDE + window) / group_words).cast("long").alias("groups")).where("groups > 1")
    large = materialize(large, "large-shards")
    groups = F.coalesce("groups", F.lit(1).cast("long"))
    rows = pieces(docs, routed, window, phrase).join(F.broadcast(large) if large.count() <= BROADCAST_IDS else large, "shard", "left")
    # A phrase goes to every group of its shard, a piece to one.
    salts = F.when(F.col("doc_id").isNull(), F.sequence(F.lit(0).cast("long"), groups - 1)).otherwise(F.array(F.pmod(F.xxhash64("doc_id", "at"), groups)))
    rows = rows.select("shard", F.explode(salts).alias("salt"), (groups == 1).alias("alone"), "doc_id", "tag", "at", "words")

    def locate(table: pa.Table) -> pa.Table:
        doc, tags, at, words = (table.column(c).to_pylist() for c in ("doc_id", "tag", "at", "words"))
        found = [r for r in zip(doc, tags, at, words) if r[0] is not None]
        return marks(found, [w for d, w in zip(doc, words) if d is None], table.column("alone")[0].as_py(), window, phrase, (table.column("shard")[0].as_py(), table.column("salt")[0].as_py()))

    found = materialize(rows.groupBy("shard", "salt").applyInArrow(locate, GROUP), "marks")
    # Groups of a shard: only their distinct windows meet, and each group gets back which are late and after which document.
    shared = found.where("window IS NOT NULL").select("shard", "salt", "window", "first", "last", "docs", "places")
    heads = shared.drop("docs", "places")
    least = heads.groupBy("window").agg(F.min("first").alias("least"), F.max("last").alias("most")).where("least < most").select("window", "least")
    # Written, so that a window in very many groups can be split from its least document.
    late = materialize(heads.join(materialize(least, "least"), "window").where("least < last").select("shard", "salt", "window", "least"), "late")

    def merge(group: pa.Table, late: pa.Table) -> pa.Table:
        of = dict(zip(late.column("window").to_pylist(), late.column("least").to_pylist()))
        group = group.filter(pa.array([w in of for w in group.column("window").to_pylist()], pa.bool_()))
        docs, places = (group.column(c).combine_chunks() for c in ("docs", "places"))
        before = np.array([of[w] for w in group.column("window").to_pylist()], dtype=np.int64)
        doc, place = docs.flatten().to_numpy(), places.flatten().to_numpy()
        later = doc > np.repeat(before, pa.compute.list_value_length(docs).to_numpy())
        out = spread(doc[later], place[later], window)
        return pa.table({c: pa.array(v, k) for c, v, k in zip(("doc_id", "tag", "spans"), out, (pa.int64(), pa.int64(), pa.list_(pa.int32())))})

    late = shared.groupBy("shard", "salt").cogroup(late.groupBy("shard", "salt")).applyInArrow(merge, "doc_id long, tag long, spans array<int>")
    return found.where("doc_id IS NOT NULL").select("doc_id", "tag", "spans").unionByName(late)


def substring_dedup(docs: DataFrame, window: int = WINDOW, phrase: int = PHRASE, with_text: bool = False, shard_phrases: int = SHARD_PHRASES, group_words: int = GROUP_WORDS) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 per row of docs; with_text adds kept, the kept words joined by one space, of the rows that lost any."""
    prepare(docs.sparkSession)
    docs = documents(docs)
    rows = materialize(profile(docs, window, phrase), "profile")
    phrases = rows.where("doc_id IS NOT NULL").select("doc_id", F.inline(F.arrays_zip("phrase", "piece")))
    recurs = materialize(phrases.groupBy("phrase").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("phrase", "first"), "recurs")
    shards = max(1, -(-recurs.count() // shard_phrases))
    recurs = recurs.withColumn("shard", F.pmod(F.xxhash64("first"), F.lit(shards)))
    later = marked(docs, phrases, recurs, window, phrase, group_words)
    later = materialize(later.groupBy("doc_id", "tag").agg(F.flatten(F.collect_list("spans")).alias("spans")), "later")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            id_, whole, digest, gone, kept = [], [], [], [], []
            for doc, t, own, ends in zip(ids(batch).to_pylist(), texts(batch), batch.column(2).to_pylist(), batch.column(3)):
                words = (t or "").encode().split()
                name = hashlib.sha256(b" ".join(words)).hexdigest()
                if tag(name) != own:
                    continue
                ends = ends.values.to_numpy()
                step = np.zeros(len(words) + 1, dtype=np.int64)
                np.add.at(step, ends[::2], 1)
                np.add.at(step, ends[1::2], -1)
                drop = np.cumsum(step)[:-1] > 0
                left = b" ".join([w for w, d in zip(words, drop.tolist()) if not d])
                id_.append(doc)
                whole.append(name)
                digest.append(hashlib.sha256(left).hexdigest())
                gone.append(int(drop.sum()))
                kept.append(left.decode() if with_text else None)
            yield pa.record_batch([pa.array(id_, pa.int64()), pa.array(whole, pa.string()), pa.array(gone, pa.int64()), pa.array(digest, pa.string()), pa.array(kept, pa.string())], names=["id", "whole", "gone", "digest", "kept"])

    changed = with_ids(docs, later).select("doc_id", "text", "tag", "spans").mapInArrow(cut, "id long, whole string, gone long, digest string, kept string").dropDuplicates(["id", "whole"])
    out = rows.select("doc_id", "n_words", "kept_sha256").join(changed, (F.col("doc_id") == F.col("id")) & (F.col("kept_sha256") == F.col("whole")), "left")
    out = out.select("doc_id", "n_words", F.coalesce("gone", F.lit(0).cast("long")).alias("n_removed"), F.coalesce("digest", "kept_sha256").alias("kept_sha256"), "kept")
    return out if with_text else out.drop("kept")


def brute_force(docs: list[tuple], window: int = WINDOW) -> list[tuple]:
    """The same rows from plain dictionaries, for tests."""
    words = [(d, (t or "").encode().split()) for d, t in docs]
    least: dict = {}
    for d, w in words:
        if d is not None:
            for i in range(len(w) - window + 1):
                key = tuple(w[i : i + window])
                least[key] = min(least.get(key, d), d)
    out = []
    for d, w in words:
        gone = set()
        for i in range(len(w) - window + 1):
            if d is not None and least[tuple(w[i : i + window])] < d:
                gone.update(range(i, i + window))
        out.append((d, len(w), len(gone), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest()))
    return out


ORACLE = rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + {WINDOW - 1}], ' ')) AS h FROM w, unnest(range(1, len(ws) - {WINDOW - 2})) AS r(i) WHERE len(ws) >= {WINDOW}),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY h) AS f FROM win) WHERE f < doc_id),
gone AS (SELECT DISTINCT doc_id, j FROM later, unnest(range(i, i + {WINDOW})) AS r(j)),
g AS (SELECT doc_id, count(*) AS n, list(j) AS js FROM gone GROUP BY doc_id),
kept AS (SELECT w.doc_id, string_agg(w.ws[j], ' ' ORDER BY j) AS s FROM w JOIN g USING (doc_id), unnest(range(1, len(w.ws) + 1)) AS r(j) WHERE NOT EXISTS (SELECT 1 FROM gone x WHERE x.doc_id = w.doc_id AND x.j = r.j) GROUP BY w.doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(g.n, 0)::BIGINT AS n_removed,
  sha256(CASE WHEN g.n IS NULL THEN array_to_string(ws, ' ') ELSE coalesce(kept.s, '') END) AS kept_sha256
FROM w LEFT JOIN g USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


def query(spark, sf_dir: str) -> DataFrame:
    from .common import read

    return substring_dedup(read(spark, sf_dir, "documents"))
