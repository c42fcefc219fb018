"""Packing into sequences by first-fit decreasing (operator 4).

One pass over the table encodes each text and keeps only lengths and checksums:
a document's ids are cut into full pieces of the sequence length, which need no
placing, and one rest. Rests are placed first-fit decreasing in randomised
groups of about GROUP documents, each in a tournament tree over the free room
of its sequences. Only (doc_id, length, checksums) is shuffled, never texts or
ids, and a group is bounded whatever the sources or copies in the table.

Defined cases: a null text is empty and holds the end id alone; null doc_ids
are packed like others; repeated rows are packed each; an empty table gives no
pieces; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, ids, prepare, texts
from .tokens import Encoder

LENGTH = 2048
END_ID = 1
#: Documents of a group, on average.
GROUP = 8192
SEED = 17
#: Texts encoded at once.
AT_ONCE = 100
#: sequence_id = group * PER_GROUP + number in the group.
PER_GROUP = 1 << 32

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def first_fit_decreasing(lengths: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item, items taken from the longest (ties by position) and put in the first bin with room.

    A tournament tree holds at each node the largest free room below it, so
    the first bin with room is found by descending left where that is enough.
    """
    n = len(lengths)
    bins, offsets = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    if not n:
        return bins, offsets
    leaves = 1 << max(0, n - 1).bit_length()
    tree = [room] * (2 * leaves)
    size = np.asarray(lengths).tolist()
    for i in np.argsort(-np.asarray(lengths), kind="stable").tolist():
        need, node = size[i], 1
        while node < leaves:
            node *= 2
            if tree[node] < need:
                node += 1
        bins[i], offsets[i] = node - leaves, room - tree[node]
        tree[node] -= need
        node //= 2
        while node:
            most = tree[2 * node] if tree[2 * node] >= tree[2 * node + 1] else tree[2 * node + 1]
            if tree[node] == most:
                break
            tree[node] = most
            node //= 2
    return bins, offsets


def encoded(docs: DataFrame, length: int, path: str | None) -> DataFrame:
    """doc_id, doc_tokens and the CRC-32 of the ids of each piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = Encoder(path), np.array([END_ID], dtype="<u4").tobytes()
        for batch in batches:
            raw = [t or "" for t in texts(batch)]
            sizes, sums = [], []
            for at in range(0, len(raw), AT_ONCE):
                for b in encoder.batch(raw[at : at + AT_ONCE]):
                    b += end
                    sizes.append(len(b) // 4)
                    sums.append([zlib.crc32(b[i : i + 4 * length]) for i in range(0, len(b), 4 * length)])
            yield pa.record_batch([ids(batch).cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(sums, pa.list_(pa.int64()))], names=["doc_id", "doc_tokens", "crcs"])

    prepare(docs.sparkSession)
    return documents(docs).mapInArrow(run, "doc_id long, doc_tokens long, crcs array<long>")


def pack(docs: DataFrame, length: int = LENGTH, group: int = GROUP, seed: int = SEED, path: str | None = None) -> DataFrame:
    """One row per piece: where it starts in its document, its sequence and its offset there. path: a tokenizers file."""
    groups = max(1, round(docs.count() / group))

    def place(key: tuple, table: pa.Table) -> pa.Table:
        doc = table.column("doc_id").to_numpy(zero_copy_only=False) if not table.column("doc_id").null_count else None
        table = table.take(np.lexsort((table.column("doc_tokens").to_numpy(), doc))) if doc is not None else table.sort_by([("doc_id", "ascending"), ("doc_tokens", "ascending")])
        tokens = table.column("doc_tokens").to_numpy()
        pieces = -(-tokens // length)
        row = np.repeat(np.arange(len(tokens)), pieces)
        number = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = number * length
        size = np.minimum(length, tokens[row] - start)
        where, offset = np.zeros(len(row), dtype=np.int64), np.zeros(len(row), dtype=np.int64)
        full = size == length
        where[full] = np.arange(full.sum())
        rest, there = first_fit_decreasing(size[~full], length)
        where[~full], offset[~full] = rest + full.sum(), there
        crc = pa.chunked_array(table.column("crcs")).combine_chunks().flatten()
        return pa.table(
            {
                "doc_id": table.column("doc_id").take(row),
                "start": start,
                "length": size,
                "ids_crc32": crc,
                "doc_tokens": tokens[row],
                "sequence_id": where + key[0].as_py() * PER_GROUP,
                "offset": offset,
            }
        )

    at = F.pmod(F.xxhash64(F.coalesce("doc_id", F.monotonically_increasing_id()), F.lit(seed)), F.lit(groups))
    return encoded(docs, length, path).withColumn("group", at).groupBy("group").applyInArrow(place, SCHEMA)


def query(spark, sf_dir: str) -> DataFrame:
    from .common import read

    return pack(read(spark, sf_dir, "documents"))
