"""N-gram Jaccard join with parity sketches (operator 2).

A document is its set of distinct word shingles. Shingles are XOR-hashed into a
sketch: each flips one bit, so two sketches differ in at most as many bits as
their sets have elements that only one has. Two sets of a and b elements with
Jaccard similarity >= 3/4 differ in at most (a + b) / 7.

Pigeonhole join. Per band of sizes, shingles fall by hash into more parts than
two sets in the band can differ in, so linked sets agree in several parts. A
part's bits are kept as the XOR of its shingles' 64-bit hashes, the compact image
of a sparse parity vector: equal if the parts are equal. Documents meet on (band,
part, XOR). Parts without any shingle agree by default and are left out; a
document's slack is the number of filled parts in which it surely agrees with any
linked one. The few documents without slack offer their empty parts too.

Sizes fall into bands [L, 2L), and into boundary bands around each L for pairs
on either side of it.

Verification. Documents that meet on a key are linked to the smallest of them
only, never all with all; such pairs are checked by size, by the Hamming
distance of parity sketches as wide as the sets, and then exactly on the shingle
sets. What the smallest does not connect is looked up again. On a key, the documents
outside its largest component are compared with all others of different components;
those inside it are not compared with one another. Which keys are looked up depends
on their size, a switch between two exact ways: a key on which at most SMALL
documents meet is looked up itself. A document with fewer larger keys than slack
shares a small key with each linked one. The others, made of common passages, meet
again on single shingles: linked sets of n and m elements share one of the
n - 3n/4 + 1 (m - 3m/4 + 1) shingles that are rarest among these documents. So no
link that could join components is lost, and common passages bring no documents
together.

Equal sets are one node throughout, known by a 64-bit hash. A second hash tells
whether two sets have the same; the later ones then get other ids.

Scale. Keys are combined per batch before the shuffle (one document of each key
leaves a batch; the others go by their own id), packed in binary columns, and
dealt to as many groups as the shingles need, so neither a hot key nor a hot
source fills a task. Comparisons are dealt in cells of about BLOCK documents
against about PROBES, with sketches of at most BRIEF bytes, and cells into tasks by
their bytes. Texts are shuffled only for candidates.

Defined cases: a null or empty text has an empty set, n_shingles 0, and is linked
with nothing: its component is its own doc_id. A null doc_id is never a
component's name unless no other id is in it; the component is then null.
Repeated rows (equal ids or texts) are reported each. An empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import documents, fresh, ids, keep_ids, materialize, prepare, texts
from .components import components
from .words import mix, shingles, word_hashes

SHINGLE = 5
#: Documents that meet on a key and are then compared with one another if they stay unconnected.
SMALL = 8
#: Documents on a key that are compared with others in one go, how many these are, and bytes of such comparisons in a task, on average.
BLOCK, PROBES, GROUP_BYTES = 256, 4096, 16_000_000
#: Bytes of a sketch that is compared before candidates are known.
BRIEF = 512
#: Keys that a group of the second stage gets, on average.
KEYS_PER_GROUP = 1_000_000
#: Keys are numbers below this; chance agreement only adds candidates.
KEY = 1 << 48
_LEAST, _BANDS = 3, 40


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted hashes of the distinct shingles of a text in which A-Z are lower-cased."""
    return shingles(word_hashes((text or "").encode().lower()), SHINGLE)


class Names:
    """of(set): an id of the set, of so many bits. renamed: other ids for sets, by their first id and second hash."""

    def __init__(self, bits: int = 64, renamed: dict[tuple[int, int], int] | None = None):
        self.mask = np.uint64((1 << bits) - 1)
        self.renamed = renamed or {}

    def first(self, own: np.ndarray) -> int:
        return int((mix(mix(own).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(own))) & self.mask)[0].astype(np.int64))

    @staticmethod
    def check(own: np.ndarray) -> int:
        return int(mix(mix(own + np.uint64(KEY)).sum(dtype=np.uint64, keepdims=True))[0].astype(np.int64))

    def of(self, own: np.ndarray) -> int:
        node = self.first(own)
        return self.renamed.get((node, self.check(own)), node) if self.renamed else node


def brief(sketch: bytes) -> bytes | None:
    """A sketch folded to BRIEF bytes; None if it is no longer than that."""
    if len(sketch) <= BRIEF:
        return None
    return np.bitwise_xor.reduce(np.frombuffer(sketch, dtype=np.uint64).reshape(-1, BRIEF // 8), axis=0).tobytes()


def sketch_of(own: np.ndarray) -> bytes:
    """The parity sketch: as many bits as the set has elements, rounded up to a power of two, 1024 at least."""
    bits = 1 << max(10, int(len(own)).bit_length())
    return np.packbits((np.bincount((own & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def sketches_differ(a: bytes, b: bytes) -> int:
    """The Hamming distance of two sketches, the wider one folded to the width of the other."""
    x, y = (np.frombuffer(s, dtype=np.uint64) for s in sorted((a, b), key=len))
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def most_differences(n: int) -> int:
    """The most elements in which a set of n can differ from a linked one (of up to 4n/3)."""
    return (n + 4 * n // 3) // 7


def bands(n: int) -> list[tuple[int, int, int]]:
    """(band, parts, most differences there) for a set of n: the band that holds n, and the boundary bands that it may be linked across."""
    out = []
    for i in range(_BANDS):
        low = _LEAST << i
        if low <= n < 2 * low:
            most = 2 * (2 * low - 1) // 7
            out.append((2 * i, _parts(most), most))
        top = 4 * (low - 1) // 3
        if 4 * n >= 3 * low and n <= top:
            most = (top + low - 1) // 7
            out.append((2 * i + 1, _parts(most), most))
        if low > 2 * n:
            break
    return out


def _parts(differences: int) -> int:
    return differences + 1 + differences // 5


def keys_of(own: np.ndarray) -> tuple[np.ndarray, int]:
    """The keys on which a set meets others, and its slack: with a linked set it shares at least so many of them."""
    n = len(own)
    if n < _LEAST:
        return np.zeros(0, dtype=np.uint64), 1  # so small, only equal sets are linked
    out, slack = [], n
    for band, parts, most in bands(n):
        where = own % np.uint64(parts)
        order = np.argsort(where, kind="stable")
        where, codes = where[order], mix(own[order])
        first = np.flatnonzero(np.diff(where, prepend=np.uint64(2**63)))
        filled = where[first]
        name = np.uint64((band + 1) << 40)
        out.append(mix(mix(filled + name) ^ np.bitwise_xor.reduceat(codes, first)))
        apart = min(most_differences(n), most)
        if len(filled) <= apart:
            out.append(mix(np.setdiff1d(np.arange(parts, dtype=np.uint64), filled) + name))
            slack = 1  # a linked set may offer filled parts only
        else:
            slack = min(slack, len(filled) - apart)
    return np.concatenate(out), slack


def profile(docs: DataFrame, names: Names) -> DataFrame:
    """doc_id, n, node, check, sketch, brief and slack per row; node is null for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t) for t in texts(batch)]
            yield pa.record_batch(
                [
                    ids(batch).cast(pa.int64()),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([names.first(s) if len(s) else None for s in sets], pa.int64()),
                    pa.array([names.check(s) for s in sets], pa.int64()),
                    pa.array(sketches := [sketch_of(s) for s in sets], pa.binary()),
                    pa.array(map(brief, sketches), pa.binary()),
                    pa.array([keys_of(s)[1] for s in sets], pa.int64()),
                ],
                names=["doc_id", "n", "node", "check", "sketch", "brief", "slack"],
            )

    return docs.mapInArrow(run, "doc_id long, n long, node long, check long, sketch binary, brief binary, slack long")


def told_apart(rows: DataFrame, names: Names) -> tuple[DataFrame, DataFrame, Names]:
    """Rows with ids that differ where sets do, a row per node, and the names with these ids. Only ids that different sets have come to the driver: about one for 10**9 documents."""
    while True:
        parts = [F.max("n").alias("n"), F.max("slack").alias("slack"), F.first("sketch").alias("sketch"), F.first("brief").alias("brief"), F.min("doc_id").alias("doc_id")]
        nodes = materialize(rows.where("n > 0").groupBy("node").agg(*parts, F.min("check").alias("low"), F.max("check").alias("high")), "nodes")
        mixed = nodes.where("low < high").select("node", "low")
        if mixed.isEmpty():
            return rows, nodes, names
        others = rows.join(mixed, "node").where("check > low").select("node", "check").distinct().collect()
        was = {(new, check): first for (first, check), new in names.renamed.items()}
        fresh = {(r.node, r.check): int(mix(mix(np.array([r.node], dtype=np.int64).view(np.uint64)) + np.array([r.check], dtype=np.int64).view(np.uint64)).view(np.int64)[0]) for r in others}
        names.renamed |= {(was.get(k, k[0]), k[1]): new for k, new in fresh.items()}
        table = rows.sparkSession.createDataFrame([(*k, new) for k, new in fresh.items()], "node long, check long, new long")
        rows = materialize(rows.join(F.broadcast(table), ["node", "check"], "left").withColumn("node", F.coalesce("new", "node")).drop("new"), "profile")


def _meet(key: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorts pairs of key and node; returns the pairs and, beside them, the smallest node of the key, and which pairs are that node's. Equal pairs count once."""
    order = np.lexsort((node, key))
    key, node = key[order], node[order]
    new_key = np.ones(len(key), dtype=bool)
    new_key[1:] = key[1:] != key[:-1]
    new = new_key.copy()
    new[1:] |= node[1:] != node[:-1]
    least = node[np.flatnonzero(new_key)][np.cumsum(new_key) - 1] if len(key) else node
    return key[new], node[new], least[new], new_key[new]


def meetings(docs: DataFrame, groups: int, names: Names) -> DataFrame:
    """(key, rep, member): documents (as nodes) that meet on a key, each beside the smallest of its batch, and these beside the smallest of all."""
    columns = ("keys", "nodes", "counts", "met_keys", "met_reps", "met_members")

    def split(part: np.ndarray, *columns: np.ndarray) -> list[list[np.ndarray]]:
        order = np.argsort(part, kind="stable")
        cuts = np.searchsorted(part[order], np.arange(groups + 1))
        return [[c[order[a:b]] for a, b in zip(cuts[:-1], cuts[1:])] for c in columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, nodes, done = [], [], set()
            for t in texts(batch):
                own = shingle_set(t)
                node = names.of(own)
                if node not in done:
                    done.add(node)
                    keys.append(keys_of(own)[0] & np.uint64(KEY - 1))
                    nodes.append(np.full(len(keys[-1]), node, dtype=np.int64))
            if not keys:
                continue
            key, node, least, leads = _meet(np.concatenate(keys), np.concatenate(nodes))
            # Of those that leave the batch, each group gets six bytes a key, ordered by node, and every node once with its count.
            first = np.argsort(node[leads], kind="stable")
            key_lead, node_lead = key[leads][first], node[leads][first]
            sent = [[], [], []]
            for k, n in zip(*split(mix(key_lead) % np.uint64(groups), key_lead, node_lead)):
                sent[0].append(k.view(np.uint8).reshape(-1, 8)[:, :6].tobytes())
                each, counts = np.unique(n, return_counts=True)
                sent[1].append(each.tobytes())
                sent[2].append(counts.astype(np.uint32).tobytes())
            rest = split(mix(node[~leads].view(np.uint64)) % np.uint64(groups), key[~leads].view(np.int64), least[~leads], node[~leads])
            sent += [[x.tobytes() for x in c] for c in rest]
            yield pa.record_batch([pa.array(np.arange(groups, dtype=np.int32)), *(pa.array(c, pa.binary()) for c in sent)], names=["part", *columns])

    def meet(table: pa.Table) -> pa.Table:
        def whole(name: str, kind: type) -> np.ndarray:
            return np.frombuffer(b"".join(table.column(name).to_pylist()), dtype=kind)

        six = whole("keys", np.uint8).reshape(-1, 6)
        keys = np.zeros((len(six), 8), dtype=np.uint8)
        keys[:, :6] = six
        key, node, least, leads = _meet(keys.view(np.uint64).ravel(), np.repeat(whole("nodes", np.int64), whole("counts", np.uint32)))
        return pa.table(
            {
                "key": np.concatenate([key[~leads].view(np.int64), whole("met_keys", np.int64)]),
                "rep": np.concatenate([least[~leads], whole("met_reps", np.int64)]),
                "member": np.concatenate([node[~leads], whole("met_members", np.int64)]),
            }
        )

    schema = "part int, " + ", ".join(f"{c} binary" for c in columns)
    return docs.mapInArrow(run, schema).groupBy("part").applyInArrow(meet, "key long, rep long, member long")


def of_nodes(docs: DataFrame, wanted: DataFrame, fn, schema: str) -> DataFrame:
    """fn over the documents of wanted (node, doc_id). Documents of equal ids but other texts come along, with their own nodes. Nodes that only documents without an id have are looked for among these."""
    found = keep_ids(docs, wanted).mapInArrow(fn, schema)
    nameless = wanted.where("doc_id IS NULL").select("node")
    if not nameless.isEmpty():
        found = found.unionByName(docs.where("doc_id IS NULL").mapInArrow(fn, schema).join(nameless, "node", "left_semi"))
    return found


def links(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, names: Names) -> DataFrame:
    """The pairs (a, b) of nodes whose sets are linked, exactly. nodes: node, n, sketch, doc_id."""

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for n, m, x, y in zip(*(batch.column(c).to_pylist() for c in range(2, 6))):
                good.append(4 * min(n, m) >= 3 * max(n, m) and 7 * sketches_differ(x, y) <= n + m)
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    side = lambda x: nodes.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"s_{x}"))
    pairs = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "n_b", "s_a", "s_b").mapInArrow(near, "a long, b long")
    pairs = materialize(pairs, "near")
    wanted = pairs.select(F.col("a").alias("node")).unionAll(pairs.select(F.col("b").alias("node"))).distinct()
    wanted = materialize(nodes.select("node", "doc_id").join(wanted, "node", "left_semi"), "wanted")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [shingle_set(t) for t in texts(batch)]
            yield pa.record_batch([pa.array([names.of(s) if len(s) else None for s in own], pa.int64()), pa.array([s.tobytes() for s in own], pa.binary())], names=["node", "own"])

    found = materialize(of_nodes(docs, wanted, sets, "node long, own binary"), "sets")
    side = lambda x: found.select(F.col("node").alias(x), F.col("own").alias(f"s_{x}"))

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3)):
                a, b = np.frombuffer(x.as_buffer(), dtype=np.uint64), np.frombuffer(y.as_buffer(), dtype=np.uint64)
                common = len(np.intersect1d(a, b, assume_unique=True))
                good.append(100 * common >= 75 * (len(a) + len(b) - common))
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    return materialize(pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "s_a", "s_b").mapInArrow(linked, "a long, b long").distinct(), "links")


def rarest(docs: DataFrame, some: DataFrame, names: Names) -> DataFrame:
    """(key, node): for the documents of some (node, doc_id) their shingles of which, among these documents, linked ones must share one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = {names.of(s): s for s in map(shingle_set, texts(batch)) if len(s)}
            node = np.repeat(np.array(list(sets), dtype=np.int64), [len(s) for s in sets.values()])
            own = np.concatenate([np.zeros(0, dtype=np.uint64), *sets.values()])
            size = np.repeat([len(s) for s in sets.values()], [len(s) for s in sets.values()])
            yield pa.record_batch([pa.array(own.view(np.int64)), pa.array(node), pa.array(size, pa.int64())], names=["key", "node", "size"])

    each = materialize(of_nodes(docs, some, run, "key long, node long, size long").distinct(), "shingles")
    shared = each.groupBy("key").agg(F.count("*").alias("c")).where("c > 1")
    # Shingles of one document alone are the rarest; they take places and meet nobody.
    ranked = each.join(shared, "key").withColumn("rank", F.row_number().over(Window.partitionBy("node").orderBy("c", "key"))).withColumn("all", F.count("*").over(Window.partitionBy("node")))
    return ranked.where("size - all + rank <= size - ceil(0.75 * size) + 1").select("key", "node")


def unconnected(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes with a key in common and different components whose sizes and sketches allow a link. rows: key, node, component, n.

    On a key the nodes outside the largest component, in blocks of about BLOCK, are compared
    with all of the key, in blocks of about PROBES; each cell of two blocks on its own, so no
    key fills a task, and a key costs what its nodes outside the largest component ask for.
    """
    sizes = rows.groupBy("key", "component").agg(F.count("*").alias("c"))
    keys = sizes.groupBy("key").agg(F.sum("c").alias("all"), F.max("c").alias("most"), F.max_by("component", F.struct("c", "component")).alias("base"), F.count("*").alias("kinds")).where("kinds > 1")
    blocks, probes = F.ceil((F.col("all") - F.col("most")) / BLOCK), F.ceil(F.col("all") / PROBES)
    keys = materialize(keys.select("key", "base", blocks.cast("int").alias("blocks"), probes.cast("int").alias("probes")), "open-keys")
    rows = rows.join(keys, "key").join(nodes.select("node", F.coalesce("brief", "sketch").alias("sketch")), "node").withColumn("other", F.col("component") != F.col("base"))
    rows = materialize(rows.drop("base"), "compared")
    copies = F.col("blocks") + F.when(F.col("other"), F.col("probes")).otherwise(0)
    total = rows.agg(F.sum((F.length("sketch") + 48) * copies)).first()[0] or 0
    parts = max(8, -(-total // GROUP_BYTES))
    block, probe = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"), F.pmod(F.xxhash64("node", F.lit(1)), F.col("probes")).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    probed = rows.withColumn("block", every("blocks")).withColumn("probe", probe).withColumn("build", F.lit(False))
    built = rows.where("other").withColumn("block", block).withColumn("probe", every("probes")).withColumn("build", F.lit(True))
    part = F.pmod(F.xxhash64("key", "block", "probe"), F.lit(parts)).alias("part")
    cells = probed.unionByName(built).select(part, "key", "block", "probe", "build", "other", "node", "component", "n", "sketch")

    def compare(table: pa.Table) -> pa.Table:
        table = table.sort_by([("key", "ascending"), ("block", "ascending"), ("probe", "ascending"), ("build", "descending")])
        key, block, probe, build, other, node, component, n = (table.column(c).to_numpy() for c in ("key", "block", "probe", "build", "other", "node", "component", "n"))
        sketch = table.column("sketch").to_pylist()
        new = np.flatnonzero((np.diff(key, prepend=key[:1] - 1) != 0) | (np.diff(block, prepend=-1) != 0) | (np.diff(probe, prepend=-1) != 0))
        a, b = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        for start, end in zip(new.tolist(), [*new[1:].tolist(), len(key)]):
            cut = start + int(build[start:end].sum())
            if start == cut or cut == end:
                continue
            width = min(map(len, sketch[start:end])) // 8
            bits = np.stack([np.bitwise_xor.reduce(np.frombuffer(x, dtype=np.uint64).reshape(-1, width), axis=0) for x in sketch[start:end]])
            sizes, places, nodes_, far = n[cut:end], component[cut:end], node[cut:end], ~other[cut:end]
            for i in range(start, cut):
                good = (places != component[i]) & (far | (nodes_ > node[i])) & (4 * np.minimum(sizes, n[i]) >= 3 * np.maximum(sizes, n[i]))
                good = np.flatnonzero(good)
                good = good[7 * np.bitwise_count(bits[cut - start + good] ^ bits[i - start]).sum(axis=1) <= sizes[good] + n[i]]
                a.append(np.full(len(good), node[i]))
                b.append(nodes_[good])
        a, b = np.concatenate(a), np.concatenate(b)
        pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
        return pa.table({"a": pairs[:, 0].copy(), "b": pairs[:, 1].copy()})

    return cells.groupBy("part").applyInArrow(compare, "a long, b long")


def classes(docs: DataFrame, small: int = SMALL, id_bits: int = 64) -> tuple[DataFrame, Names]:
    """doc_id, n, node and component per row of docs, and the names of nodes. component: the smallest node reachable by links, null for an empty set."""
    rows = materialize(profile(docs, Names(id_bits)), "profile")
    rows, nodes, names = told_apart(rows, Names(id_bits))
    total = rows.agg(F.sum("n")).first()[0] or 0
    groups = max(8, -(-int(total) * 7 // 10 // KEYS_PER_GROUP))
    met = materialize(meetings(docs.where("text IS NOT NULL"), groups, names), "met")
    tried = materialize(met.select(F.least("rep", "member").alias("a"), F.greatest("rep", "member").alias("b")).distinct(), "tried")
    found = links(tried, nodes, docs, names)

    def connected(found: DataFrame) -> DataFrame:
        of = components(found.select("a", "b")).withColumnRenamed("vertex", "node")
        return nodes.select("node").join(of, "node", "left").select("node", F.coalesce("component", "node").alias("component"))

    of = materialize(connected(found), "classes")
    # Keys of three or more nodes, which the pairs with the smallest may have left unconnected.
    sizes = materialize(met.groupBy("key").agg(F.count("*").alias("c")).where("c > 1"), "sizes")
    each = lambda rows: rows.select("key", F.col("rep").alias("node")).unionAll(rows.select("key", F.col("member").alias("node"))).distinct()
    few = each(met.join(sizes.where(F.col("c") < small).select("key"), "key", "left_semi"))
    common = each(met.join(sizes.where(F.col("c") >= small).select("key"), "key", "left_semi"))
    unsafe = common.groupBy("node").agg(F.count("*").alias("h")).join(nodes.select("node", "slack", "doc_id"), "node").where("h >= slack")
    rare = rarest(docs, materialize(unsafe.select("node", "doc_id"), "unsafe"), names)
    open_keys = few.select("key", "node").unionByName(rare).join(of, "node").join(nodes.select("node", "n"), "node")
    open_keys = materialize(open_keys, "open")
    between = materialize(unconnected(open_keys, nodes).distinct().join(tried, ["a", "b"], "left_anti"), "between")
    if not between.isEmpty():
        more = links(between, nodes, docs, names)
        if not more.isEmpty():
            of = connected(found.unionAll(more))
    return rows.join(of, "node", "left").select("doc_id", "n", "node", "component"), names


def jaccard_classes(docs: DataFrame, small: int = SMALL, id_bits: int = 64) -> DataFrame:
    """doc_id, n_shingles and component_id, the smallest doc_id reachable by links, per row of docs."""
    prepare(docs.sparkSession)
    whole = materialize(classes(documents(docs), small, id_bits)[0], "of-rows")
    least = materialize(whole.where("component IS NOT NULL").groupBy("component").agg(F.min("doc_id").alias("least")), "least")
    named = whole.join(least, "component", "left")
    return named.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"))


def keep_one(docs: DataFrame, id_bits: int = 64) -> DataFrame:
    """One row of each component, with all its columns: the one of the smallest doc_id, nulls last.

    Defined cases: of several rows with this doc_id, that of the smallest set hash stays, and of
    rows with the same words one; a row with a repeated or null doc_id goes or stays by its own
    text; rows without words all stay, as they are linked with nothing; an empty table stays
    empty; columns may have any names.
    """
    prepare(docs.sparkSession)
    found, names = classes(documents(docs), SMALL, id_bits)
    found = materialize(found, "of-rows")
    first = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "node")
    # A component's leader is one row of a partial aggregate, however many copies there are.
    leads = materialize(found.where("n > 0").groupBy("component").agg(F.min(first).alias("lead"), F.count("*").alias("c")).where("c > 1"), "leads")
    rows = found.where("n > 0").join(leads, "component")
    repeated = materialize(found.groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1 OR doc_id IS NULL").select("doc_id"), "repeated")
    copies = rows.where("doc_id IS NOT NULL AND (lead.nameless OR lead.doc_id <> doc_id)").select("doc_id")
    drop = materialize(copies.union(repeated.where("doc_id IS NOT NULL")).distinct(), "near-copies")
    kept = keep_ids(docs.where("doc_id IS NOT NULL"), drop, "left_anti")
    if repeated.isEmpty():
        return kept
    # Rows whose doc_id does not tell which they are: by their words.
    node, own, doc, lead = (fresh(docs.columns, f"__{c}") for c in ("node", "of", "doc", "lead"))

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t) for t in texts(batch)]
            yield batch.append_column(node, pa.array([names.of(s) if len(s) else None for s in sets], pa.int64()))

    unclear = docs.where("doc_id IS NULL").unionByName(keep_ids(docs.where("doc_id IS NOT NULL"), repeated.where("doc_id IS NOT NULL")))
    unclear = unclear.mapInArrow(named, StructType([*docs.schema.fields, StructField(node, LongType())]))
    where = rows.select(F.col("node").alias(own), F.col("lead.doc_id").alias(doc), F.col("lead.node").alias(lead)).distinct()
    unclear = unclear.join(where, F.col(node) == F.col(own), "left")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    alone = unclear.where(F.col(own).isNull()).select(*columns)
    leaders = unclear.where(F.col("doc_id").cast("long").eqNullSafe(F.col(doc)) & (F.col(node) == F.col(lead))).dropDuplicates([node]).select(*columns)
    return kept.unionByName(alone).unionByName(leaders)


def brute_force(docs: list[tuple]) -> list[tuple]:
    """The same rows from plain sets and all pairs, for tests."""
    import re

    def own(text: str | None) -> frozenset:
        words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        k = min(SHINGLE, len(words))
        return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) if words else frozenset()

    sets = [own(t) for _, t in docs]
    up = list(range(len(docs)))

    def find(i: int) -> int:
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * (c := len(a & b)) >= 75 * (len(a) + len(b) - c):
                up[find(i)] = find(j)
    least: dict = {}
    for i, (d, _) in enumerate(docs):
        least[find(i)] = min(least.get(find(i), float("inf")), float("inf") if d is None else d)
    return [(d, len(s), None if (m := least[find(i)]) == float("inf") else m) for i, ((d, _), s) in enumerate(zip(docs, sets))]


ORACLE = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS MATERIALIZED (SELECT DISTINCT doc_id, hash(array_to_string(ws[i:i + least({SHINGLE}, len(ws)) - 1], ' ')) AS s FROM w, unnest(range(1, len(ws) - least({SHINGLE}, len(ws)) + 2)) AS r(i) WHERE len(ws) > 0),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach AS (SELECT a AS doc_id, a AS r FROM (SELECT DISTINCT a FROM e) UNION SELECT e.b, reach.r FROM reach JOIN e ON e.a = reach.doc_id WHERE reach.r < e.b),
m AS (SELECT doc_id, min(r) AS r FROM reach GROUP BY doc_id)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(coalesce(m.r, w.doc_id), w.doc_id)::BIGINT AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
"""


def query(spark, sf_dir: str) -> DataFrame:
    from .common import read

    return jaccard_classes(read(spark, sf_dir, "documents"))
