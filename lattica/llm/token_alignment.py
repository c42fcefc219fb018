"""Cross-tokenizer alignment by packed bitsets of token ends (operator 12).

Tokenizers A and B cut the same bytes. A bitset per tokenizer marks the bytes at which
its tokens end; their AND holds the shared cuts. The rank of a cut (a running count of
set bits) in A's bitset is the number of A tokens before it, likewise in B's, so two
adjacent cuts select a range of A tokens and one of B tokens: a group. Every A token of
a group is linked to every B token of it.

How many documents hold an id pair linked is counted over the whole corpus. A document's
links are kept as distinct pairs with their numbers, never as single links, and a long
group as the products of its distinct ids.

Scale. Texts are encoded once; a document's pairs are written and read
twice. Pairs are counted per batch before the shuffle. The HOT most frequent pairs, a
fixed number of them, and the highest count of each A id (at most as many as A has ids)
go to all executors; the rest, whose pairs are all rare, meets its counts in a shuffle.
So no pair that a large share of the documents holds is a shuffle key, whatever its
counts, and both ways give the same numbers.

The texts of a batch are aligned together: their bytes lie one after the other, so one
bitset and one AND serve all, and a text's end is a shared cut.

Defined cases: null and empty texts, and texts whose joined A or B tokens differ from
space + text, have no tokens: zeros and ''. Rows that repeat a doc_id count as documents
of their own; a null doc_id is kept. An empty table gives no rows. Other columns are not
read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, ids, materialize, prepare, texts
from .tokens import Encoder, encoding

PIECES = "piece_bpe_32k.model"
#: A pair is its A id, shifted, with its B id; beside a text's number, above both.
_ID, _TEXT = 16, 32
#: Pairs whose counts go to all executors: 12 bytes each.
HOT = 1 << 18
SPACE = "▁"


class Aligned(NamedTuple):
    """Texts of a batch that have tokens. counts: n_a, n_b, n_groups and n_links of each; pairs: distinct in each text, sorted, `sizes` of them a text; groups: `a1,a2|b1;a3|b2,b3`."""

    counts: np.ndarray
    pairs: np.ndarray
    occurs: np.ndarray
    sizes: np.ndarray
    groups: list[str]


def marked(lengths: np.ndarray, size: int) -> np.ndarray:
    """The bitset of the bytes at which tokens end, packed, the lowest bit first."""
    ends = np.zeros(-(-size // 64) * 64, dtype=np.uint8)
    ends[np.cumsum(lengths) - 1] = 1
    return np.packbits(ends, bitorder="little").view(np.uint64)


def ranks(bits: np.ndarray, places: np.ndarray) -> np.ndarray:
    """How many bits are set at or before each place: counts of whole words before it, and of a word's masked bits."""
    before = np.concatenate([[0], np.cumsum(np.bitwise_count(bits), dtype=np.int64)])
    word, at = places >> 6, (places & 63).astype(np.uint64)
    low = bits[word] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(63) - at))
    return before[word] + np.bitwise_count(low)


def selected(bits: np.ndarray) -> np.ndarray:
    """The places of the set bits."""
    return np.flatnonzero(np.unpackbits(bits.view(np.uint8), bitorder="little"))


def cuts(lengths_a: np.ndarray, lengths_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the groups end, as counts of A tokens and of B tokens."""
    size = int(lengths_a.sum())
    a, b = marked(lengths_a, size), marked(lengths_b, size)
    shared = selected(a & b)
    return ranks(a, shared), ranks(b, shared)


def linked(a: np.ndarray, b: np.ndarray, to_a: np.ndarray, to_b: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys (text, A id, B id) of all groups, sorted, and how often each is linked. of: the text of each group."""
    from_a, from_b = np.concatenate([[0], to_a[:-1]]), np.concatenate([[0], to_b[:-1]])
    n_b = to_b - from_b
    each = (to_a - from_a) * n_b
    small = each <= 64
    links = np.repeat(np.flatnonzero(small), each[small])
    within = np.arange(len(links)) - np.repeat(np.cumsum(each[small]) - each[small], each[small])
    keys = [of[links] << _TEXT | a[from_a[links] + within // n_b[links]] << _ID | b[from_b[links] + within % n_b[links]]]
    occurs = [np.ones(len(links), dtype=np.int64)]
    for g in np.flatnonzero(~small).tolist():
        x, k = np.unique(a[from_a[g] : to_a[g]], return_counts=True)
        y, m = np.unique(b[from_b[g] : to_b[g]], return_counts=True)
        keys.append((of[g] << _TEXT | x[:, None] << _ID | y[None, :]).ravel())
        occurs.append((k[:, None] * m[None, :]).ravel())
    return summed(np.concatenate(keys), np.concatenate(occurs))


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and the sums of their counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.diff(keys, prepend=keys[0] - 1))
    return keys[first], np.add.reduceat(counts, first)


class Aligner:
    """Aligns texts by two tokenizers."""

    def __init__(self, path_a: str | None = None, path_b: str | None = None):
        import public_tokenizers
        import sentencepiece

        vocabulary = encoding(path_a)
        self.a = Encoder(path_a).plain
        self.bytes_a = vocabulary.decode_bytes
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b or public_tokenizers.path(PIECES))
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        known = set(vocabulary._mergeable_ranks.values())
        self.length_a = np.array([len(self.bytes_a([i])) if i in known else 0 for i in range(vocabulary.n_vocab)])
        self.length_b = np.array([len(x) for x in self.bytes_b])
        if max(len(self.length_a), len(self.length_b)) > 1 << _ID:
            raise ValueError("a vocabulary of more than 2**16 ids")
        #: Ids followed by a comma, the mark after a group's A tokens, that after its B tokens, and nothing.
        self.named = [f"{i}{mark}" for mark in (",", "|", ";", "") for i in range(1 << _ID)]

    def tokens(self, texts: list[str]) -> tuple[list[np.ndarray | None], list[np.ndarray | None]]:
        """The ids of space + text by A and of text by B; None for texts that have no tokens."""
        out_a, out_b = [], []
        for text, b in zip(texts, self.b.encode(texts, num_threads=1)):
            want = (" " + text).encode()
            a = np.frombuffer(self.a(" " + text), dtype=np.uint32).astype(np.int64) if text else None
            if a is None or b"".join(map(self.bytes_b.__getitem__, b)) != want or self.bytes_a(a.tolist()) != want:
                a = b = None
            out_a.append(a)
            out_b.append(None if b is None else np.array(b, dtype=np.int64))
        return out_a, out_b

    def align(self, texts: list[str]) -> tuple[list[int], Aligned]:
        """Which texts have tokens, and these aligned."""
        found_a, found_b = self.tokens(texts)
        which = [i for i, a in enumerate(found_a) if a is not None]
        none = np.zeros(0, dtype=np.int64)
        if not which:
            return which, Aligned(np.zeros((0, 4), dtype=np.int64), none, none, none, [])
        n_a, n_b = (np.array([len(x[i]) for i in which]) for x in (found_a, found_b))
        a, b = (np.concatenate([x[i] for i in which]) for x in (found_a, found_b))
        to_a, to_b = cuts(self.length_a[a], self.length_b[b])
        last = np.searchsorted(to_a, np.cumsum(n_a))  # the last group of each text
        of = np.repeat(np.arange(len(which)), np.diff(last, prepend=-1))
        keys, occurs = linked(a, b, to_a, to_b, of)
        ends = np.searchsorted(keys, np.arange(1, len(which) + 1) << _TEXT)
        total = np.concatenate([[0], np.cumsum(occurs)])
        sizes = np.diff(ends, prepend=0)
        counts = np.stack([n_a, n_b, np.diff(last, prepend=-1), total[ends] - total[ends - sizes]], axis=1)
        return which, Aligned(counts, keys & ((1 << _TEXT) - 1), occurs, sizes, self.groups(a, b, to_a, to_b, last))

    def groups(self, a: np.ndarray, b: np.ndarray, to_a: np.ndarray, to_b: np.ndarray, last: np.ndarray) -> list[str]:
        """The groups of each text: every token with the mark that follows it, joined."""
        n_a, n_b = np.diff(to_a, prepend=0), np.diff(to_b, prepend=0)
        out = np.empty(len(a) + len(b), dtype=np.int64)
        out[np.arange(len(a)) + np.repeat(to_b - n_b, n_a)] = a
        out[np.arange(len(b)) + np.repeat(to_a, n_b)] = b
        out[to_a + to_b - n_b - 1] += 1 << _ID
        out[to_a + to_b - 1] += 2 << _ID
        ends = (to_a + to_b)[last]
        out[ends - 1] += 1 << _ID
        marked_ids = list(map(self.named.__getitem__, out.tolist()))
        return ["".join(marked_ids[i:j]) for i, j in zip([0, *ends[:-1].tolist()], ends.tolist())]


def alignments(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, groups: bool = False) -> DataFrame:
    """Per row of docs: doc_id, n_a, n_b, n_groups, n_links, groups_sha256, its distinct linked pairs (A id * 65,536 + B id) and how often each is linked; with groups, also the groups as text."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(path_a, path_b)
        for batch in batches:
            which, found = aligner.align([t or "" for t in texts(batch)])
            counts, sizes = np.zeros((len(batch), 4), dtype=np.int64), np.zeros(len(batch), dtype=np.int64)
            counts[which], sizes[which] = found.counts, found.sizes
            shown = [""] * len(batch)
            for i, text in zip(which, found.groups):
                shown[i] = text
            sha = [hashlib.sha256(x.encode()).hexdigest() if x else "" for x in shown]
            cut = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
            columns = [ids(batch).cast(pa.int64()), *(pa.array(c) for c in counts.T.copy()), pa.array(sha, pa.string())]
            columns += [pa.ListArray.from_arrays(cut, pa.array(x)) for x in (found.pairs, found.occurs)]
            names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "occurs"]
            if groups:
                columns.append(pa.array(shown, pa.string()))
                names.append("groups")
            yield pa.record_batch(columns, names=names)

    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, occurs array<long>"
    return documents(docs).mapInArrow(run, schema + (", groups string" if groups else ""))


def flat(batch: pa.RecordBatch, column: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(column)).flatten().to_numpy(zero_copy_only=False)


def pair_counts(found: DataFrame) -> DataFrame:
    """(pair, docs): in how many rows of alignments() a pair is linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def out() -> pa.RecordBatch:
            pairs, docs = summed(np.concatenate([p for p, _ in held]), np.concatenate([c for _, c in held]))
            return pa.record_batch([pa.array(pairs), pa.array(docs)], names=["pair", "docs"])

        for batch in batches:
            pairs = flat(batch, "pairs")
            held.append(summed(pairs, np.ones(len(pairs), dtype=np.int64)))
            n += len(held[-1][0])
            if n > 1_000_000:
                merged = summed(np.concatenate([p for p, _ in held]), np.concatenate([c for _, c in held]))
                held, n = [merged], len(merged[0])
                if n > 500_000:
                    yield out()
                    held, n = [], 0
        if held:
            yield out()

    return found.select("pairs").mapInArrow(run, "pair long, docs long").groupBy("pair").agg(F.sum("docs").alias("docs"))


def scored(found: DataFrame, hot: int = HOT) -> DataFrame:
    """n_best and count_sum per row of a materialised alignments() with a row number, __row."""
    counts = materialize(pair_counts(found), "pair-counts")
    a_id = F.shiftright("pair", _ID)
    best = counts.groupBy(a_id.alias("a")).agg(F.max("docs").alias("best"))  # at most one row for each id of A
    counts = materialize(counts.withColumn("a", a_id).join(F.broadcast(best), "a").select("pair", "docs", (F.col("docs") == F.col("best")).alias("top")), "pair-tops")
    # Among equal counts the smaller pairs; which pairs are sent decides only the way they are looked up.
    sent = counts.orderBy(F.desc("docs"), "pair").limit(hot).toArrow().sort_by("pair")
    known = found.sparkSession.sparkContext.broadcast(tuple(sent.column(c).to_numpy() for c in ("pair", "docs", "top")))

    def lookup(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, docs, top = known.value
        for batch in batches:
            pairs, occurs = flat(batch, "pairs"), flat(batch, "occurs")
            sizes = np.diff(batch.column(batch.schema.get_field_index("pairs")).offsets.to_numpy())
            row = np.repeat(np.arange(len(sizes)), sizes)
            at = np.minimum(np.searchsorted(pair, pairs), max(len(pair) - 1, 0))
            hit = pair[at] == pairs if len(pair) else np.zeros(len(pairs), dtype=bool)

            def add(values: np.ndarray) -> np.ndarray:
                total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
                ends = np.cumsum(np.bincount(row[hit], minlength=len(sizes)))
                return total[ends] - total[np.concatenate([[0], ends[:-1]])]

            cut = np.concatenate([[0], np.cumsum(np.bincount(row[~hit], minlength=len(sizes)))])
            listed = lambda values: pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(values[~hit]))
            hits = at[hit]
            columns = [batch.column(batch.schema.get_field_index("__row")), pa.array(add(occurs[hit] * top[hits])), pa.array(add(occurs[hit] * docs[hits])), listed(pairs), listed(occurs)]
            yield pa.record_batch(columns, names=["__row", "n_best", "count_sum", "pairs", "occurs"])

    part = materialize(found.select("__row", "pairs", "occurs").mapInArrow(lookup, "__row long, n_best long, count_sum long, pairs array<long>, occurs array<long>"), "looked-up")
    rare = part.select("__row", F.explode(F.arrays_zip("pairs", "occurs")).alias("x")).select("__row", F.col("x.pairs").alias("pair"), F.col("x.occurs").alias("occurs"))
    rare = rare.join(counts, "pair").groupBy("__row").agg(F.sum(F.col("occurs") * F.col("top").cast("long")).alias("b"), F.sum(F.col("occurs") * F.col("docs")).alias("s"))
    none = F.lit(0)
    return part.join(rare, "__row", "left").select("__row", (F.col("n_best") + F.coalesce("b", none)).alias("n_best"), (F.col("count_sum") + F.coalesce("s", none)).alias("count_sum"))


def token_alignment(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, hot: int = HOT) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 per row of docs."""
    found = materialize(alignments(docs, path_a, path_b).withColumn("__row", F.monotonically_increasing_id()), "aligned")
    numbers = scored(found, hot)
    return found.drop("pairs", "occurs").join(numbers, "__row").select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def brute_force(docs: list[tuple]) -> list[tuple]:
    """The same rows from byte offsets, links listed one by one, by the tokenizers library, for tests."""
    from itertools import accumulate

    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    from .tokens import byte_of_char

    first = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(PIECES))
    to = byte_of_char()
    out, held = [], []
    for _, text in docs:
        want = (" " + (text or "")).encode()
        a = first.encode(" " + text, add_special_tokens=False).ids if text else []
        b = second.encode(text) if text else []
        bytes_a = [bytes(to[c] for c in first.id_to_token(i)) for i in a]
        bytes_b = [bytes([int(p[3:5], 16)]) if second.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in ((i, second.id_to_piece(i)) for i in b)]
        if b"".join(bytes_a) != want or b"".join(bytes_b) != want:
            held.append(([], [], [], []))
            continue
        ends = [set(accumulate(map(len, x))) for x in (bytes_a, bytes_b)]
        groups, i, j, at_a, at_b = [], 0, 0, 0, 0
        for cut in sorted(ends[0] & ends[1]):
            k, m = i, j
            while at_a < cut:
                at_a += len(bytes_a[k])
                k += 1
            while at_b < cut:
                at_b += len(bytes_b[m])
                m += 1
            groups.append((a[i:k], b[j:m]))
            i, j = k, m
        held.append((a, b, groups, [(x, y) for g, h in groups for x in g for y in h]))
    counts: dict = {}
    for *_, links in held:
        for p in set(links):
            counts[p] = counts.get(p, 0) + 1
    best: dict = {}
    for (x, _), c in counts.items():
        best[x] = max(best.get(x, 0), c)
    for (d, _), (a, b, groups, links) in zip(docs, held):
        named = ";".join(f"{','.join(map(str, g))}|{','.join(map(str, h))}" for g, h in groups)
        out.append((d, len(a), len(b), len(groups), len(links), sum(counts[p] == best[p[0]] for p in links), sum(counts[p] for p in links), hashlib.sha256(named.encode()).hexdigest() if a else ""))
    return out


def query(spark, sf_dir: str) -> DataFrame:
    from .common import read

    return token_alignment(read(spark, sf_dir, "documents"))
