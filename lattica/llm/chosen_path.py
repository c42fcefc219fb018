"""MinHash near-duplicates by a chosen-path set similarity join (operator 11).

A document is its set of distinct word shingles, its signature the minwise token of
WIDTH hash functions. A tree branches documents recursively: a node of the tree chooses
one or two of the functions, pseudo-randomly by its path, and each document goes to the
children that its own minwise tokens under these functions name. Two sets of similarity J agree on a
function with probability J, so linked documents (J >= LEVEL) meet again in a child
with a probability that the number of functions makes high, while others part.

Recall. The first two levels of a tree choose two functions, deeper ones 1 / LEVEL on
average (the least that keeps linked pairs from dying out). A pair at the threshold
itself then stays together through all DEPTH levels of one tree with a probability of
about 0.89 (recall_of()), and misses all TREES independent trees with one of less than
1e-6; pairs of higher similarity, or that part later, with less.

Comparisons. A tree's nodes are first compared with their smallest document only, and
the links found this way give components; a node within one component is done, and a
large group of near copies costs one comparison a document. A node with several
components is branched on, unless it is small or few of its documents lie outside its
largest component: then these are compared with all others of different components,
in cells of about BLOCK documents against about PROBES. What is left after DEPTH
levels is compared in the same way, so depth costs no link. A comparison is one of parity
sketches (each shingle flips a bit, so sketches differ in no more bits than the sets in
shingles), and is confirmed on the full sets. A cell returns pairs that join its components,
not every pair of two components that it would join; where one of these is refuted on
the full sets, the tree's nodes that are still mixed return all their pairs.

Scale. Equal sets are one node throughout, told by 128 bits. What is shuffled per
document is its signature and 16 bytes for each of its 2 * TREES first children; sets
travel for candidates only. A document compared with many (the smallest of a large
group) is copied once to each cell of others, and cells are dealt by their bytes.

Defined cases: a null or empty text has an empty set, n_shingles 0, and is linked with
nothing: its component is its own doc_id. A null doc_id is never a component's name
unless no other id is in it; the component is then null, and kept is true. Repeated rows
(equal ids or texts) are reported each; those with the component's id are all kept. An
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, ids, keep_ids, materialize, prepare, texts
from .components import components
from .words import mix, shingles, word_hashes

SHINGLE, LEVEL = 3, 85
TREES, DEPTH = 7, 6
#: Hash functions of a signature, and bytes of one of its values.
WIDTH, BYTES = 32, 6
#: Documents outside a node's largest component that are compared with others in one go, and how many these are.
BLOCK, PROBES = 2048, 4096
#: Documents of a tree's node, and of those outside its largest component, up to which it is compared instead of branched on: so many comparisons of sketches cost a document about as much as one more level.
LEAF, FEW = 2048, 2048
#: Bytes of one cell of a document's comparisons, and of the cells of a task, on average.
CELL_BYTES, TASK_BYTES = 2_000_000, 16_000_000
_FIRST = 2 * TREES
_MUL = np.random.Generator(np.random.PCG64(11)).integers(0, 2**64, WIDTH, dtype=np.uint64) | np.uint64(1)
_MASK = np.uint64((1 << 8 * BYTES) - 1)


def recall_of(similarity: float, trees: int = TREES, depth: int = DEPTH) -> float:
    """The probability that a pair of this similarity meets at the bottom of at least one tree."""
    together, extra = 1.0, 100 / LEVEL - 1
    for level in range(depth, 0, -1):
        part = 1 - similarity * together
        together = 1 - (part * part if level <= 2 else part * (1 - extra + extra * part))
    return 1 - (1 - together) ** trees


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted hashes of the distinct shingles of a text in which A-Z are lower-cased."""
    return shingles(word_hashes((text or "").encode().lower()), SHINGLE)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """The minwise tokens of sets that are not empty, a row each."""
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    flat = np.concatenate(sets)
    return np.stack([mix(np.minimum.reduceat(mix(flat * m), starts)) & _MASK for m in _MUL], axis=1)


def packed(values: np.ndarray) -> list[bytes]:
    """Rows of a signature as BYTES bytes a value."""
    return [r.tobytes() for r in np.ascontiguousarray(values.view(np.uint8).reshape(len(values), WIDTH, 8)[:, :, :BYTES])]


def unpacked(rows: list[bytes]) -> np.ndarray:
    out = np.zeros((len(rows), WIDTH, 8), dtype=np.uint8)
    out[:, :, :BYTES] = np.frombuffer(b"".join(rows), dtype=np.uint8).reshape(len(rows), WIDTH, BYTES)
    return out.view(np.uint64).reshape(len(rows), WIDTH)


def first_children(values: np.ndarray) -> np.ndarray:
    """The paths of the first level, a column for each tree and choice."""
    names = mix(np.arange(1, _FIRST + 1, dtype=np.uint64))
    return mix(names[None, :] ^ mix(values[:, :_FIRST] + np.uint64(1)))


def children(path: np.ndarray, values: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """The paths of the next level's nodes and the rows that go there. level: that of the children, 2 or more."""
    path, out, rows = path.view(np.uint64), [], []
    for j in range(2):
        name = mix(path + np.uint64(0x9E3779B97F4A7C15 * (j + 1) % 2**64))
        at = np.arange(len(path)) if j == 0 or level <= 2 else np.flatnonzero((name >> np.uint64(40)) * LEVEL < (100 - LEVEL) << 24)
        pick = _FIRST + ((name[at] >> np.uint64(8)) % np.uint64(WIDTH - _FIRST)).astype(np.int64)
        out.append(mix(name[at] ^ mix(values[at, pick] + np.uint64(1))))
        rows.append(at)
    return np.concatenate(out).view(np.int64), np.concatenate(rows)


def sketch_of(own: np.ndarray) -> bytes:
    """The parity sketch: at least two bits for each element, a power of two, 256 at least."""
    bits = 1 << max(8, int(2 * len(own) - 1).bit_length())
    return np.packbits((np.bincount((mix(own) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The Hamming distances of a sketch and of each of several (rows), the wider folded to the width of the other; widths are powers of two."""
    while len(x) > y.shape[1]:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while y.shape[1] > len(x):
        y = y[:, : y.shape[1] // 2] ^ y[:, y.shape[1] // 2 :]
    return np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)


def may_link(n, m, differ):
    """Whether sets of n and m elements that differ in at least `differ` may be linked."""
    return (100 - LEVEL) * (n + m) >= (100 + LEVEL) * differ


def names_of(own: np.ndarray) -> tuple[int, int]:
    """128 bits that tell a set."""
    salted = (mix(own + np.uint64(s)).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(own)) for s in (0, 1 << 48))
    a, b = (int(mix(x).view(np.int64)[0]) for x in salted)
    return a, b


def profile(docs: DataFrame) -> DataFrame:
    """doc_id, n, h1, h2, signature and sketch per row; the last four null for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t) for t in texts(batch)]
            filled = [i for i, s in enumerate(sets) if len(s)]
            made: list = [None] * len(sets)
            for i, row in zip(filled, packed(signatures([sets[i] for i in filled])) if filled else []):
                made[i] = row
            names = [names_of(s) if len(s) else (None, None) for s in sets]
            columns = [ids(batch).cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()), *(pa.array([x[i] for x in names], pa.int64()) for i in range(2)), pa.array(made, pa.binary()), pa.array([sketch_of(s) if len(s) else None for s in sets], pa.binary())]
            yield pa.record_batch(columns, names=["doc_id", "n", "h1", "h2", "signature", "sketch"])

    return docs.mapInArrow(run, "doc_id long, n long, h1 long, h2 long, signature binary, sketch binary")


def planted(nodes: DataFrame) -> DataFrame:
    """(path, node): the first level of all trees."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = first_children(unpacked(batch.column(1).to_pylist()))
            yield pa.record_batch([pa.array(paths.view(np.int64).ravel()), pa.array(np.repeat(batch.column(0).to_numpy(), _FIRST))], names=["path", "node"])

    return nodes.select("node", "signature").mapInArrow(run, "path long, node long")


def branched(rows: DataFrame, nodes: DataFrame, level: int) -> DataFrame:
    """(path, node, component, n) of the children of rows (path, node, component, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            path, at = children(batch.column(0).to_numpy(), unpacked(batch.column(4).to_pylist()), level)
            rest = batch.select([1, 2, 3]).take(pa.array(at))
            yield pa.record_batch([pa.array(path), *rest.columns], names=["path", "node", "component", "n"])

    return rows.join(nodes.select("node", "signature"), "node").select("path", "node", "component", "n", "signature").mapInArrow(run, "path long, node long, component long, n long")


def facing(pairs: DataFrame, held: DataFrame, good, sized: str) -> DataFrame:
    """The pairs (a, b) that good(n and data of a, [n and data of each b]) keeps. held: node, n, data, once a node; sized: bytes of a node's data, by n.

    a may stand in any number of pairs: these are dealt to cells by their bytes, and each cell gets a's data once.
    """
    size = held.select("node", F.expr(sized).alias("bytes"))
    rows = pairs.join(size.withColumnsRenamed({"node": "b", "bytes": "bytes_b"}), "b")
    cells = rows.groupBy("a").agg(F.ceil(F.sum("bytes_b") / CELL_BYTES).cast("int").alias("cells"), F.sum("bytes_b").alias("bytes"))
    cells = materialize(cells.join(size.withColumnRenamed("bytes", "own").withColumnRenamed("node", "a"), "a"), "cells")
    total = cells.agg(F.sum(F.col("bytes") + F.col("own") * F.col("cells"))).first()[0] or 0
    parts = max(8, -(-int(total) // TASK_BYTES))
    cell = F.pmod(F.xxhash64("b"), F.col("cells")).cast("int")
    member = pairs.join(cells, "a").withColumn("cell", cell).select("a", "b", "cell").join(held.select(F.col("node").alias("b"), "n", "data"), "b")
    hub = cells.select("a", F.lit(None).cast("long").alias("b"), F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("cell")).join(held.select(F.col("node").alias("a"), "n", "data"), "a")
    both = hub.select("a", "b", "cell", "n", "data").unionByName(member.select("a", "b", "cell", "n", "data")).withColumn("part", F.pmod(F.xxhash64("a", "cell"), F.lit(parts)))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("a", "ascending"), ("cell", "ascending")])
        a, cell = table.column("a").to_numpy(), table.column("cell").to_numpy()
        data = list(zip(table.column("n").to_pylist(), table.column("data").to_pylist()))
        b = table.column("b").to_pylist()
        out_a, out_b = [], []
        new = np.flatnonzero((np.diff(a, prepend=a[:1] - 1) != 0) | (np.diff(cell, prepend=-1) != 0)).tolist()
        for start, end in zip(new, [*new[1:], len(a)]):
            own = next((data[i] for i in range(start, end) if b[i] is None), None)
            others = [i for i in range(start, end) if b[i] is not None]
            if own is None or not others:
                continue  # cells without pairs
            out_b += [b[i] for i, yes in zip(others, good(own, [data[i] for i in others])) if yes]
            out_a += [int(a[start])] * (len(out_b) - len(out_a))
        return pa.table({"a": pa.array(out_a, pa.int64()), "b": pa.array(out_b, pa.int64())})

    return both.groupBy("part").applyInArrow(run, "a long, b long")


def near(own: tuple[int, bytes], others: list[tuple[int, bytes]]) -> list[bool]:
    """Which sets may be linked with one, by their sketches."""
    x = np.frombuffer(own[1], dtype=np.uint64)
    return [bool(may_link(own[0], n, apart(x, np.frombuffer(o, dtype=np.uint64)[None])[0])) for n, o in others]


def linked(own: tuple[int, bytes], others: list[tuple[int, bytes]]) -> list[bool]:
    """Which sets are linked with one, exactly."""
    a, out = np.frombuffer(own[1], dtype=np.uint64), []
    for _, o in others:
        b = np.frombuffer(o, dtype=np.uint64)
        at = np.minimum(np.searchsorted(a, b), len(a) - 1)
        common = int((a[at] == b).sum())
        out.append(100 * common >= LEVEL * (len(a) + len(b) - common))
    return out


def sized_alike(a: str, b: str):
    return (100 * F.least(a, b) >= LEVEL * F.greatest(a, b))


def links(pairs: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """The distinct pairs (a, b) of nodes whose sets are linked, exactly. pairs: materialised."""
    ends = pairs.select(F.col("a").alias("node")).unionAll(pairs.select(F.col("b").alias("node"))).distinct()
    wanted = materialize(nodes.select("node", "h1", "h2", "doc_id").join(ends, "node", "left_semi"), "wanted")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = {names_of(s): s for s in map(shingle_set, texts(batch)) if len(s)}
            columns = [pa.array([x[i] for x in own], pa.int64()) for i in range(2)] + [pa.array([len(s) for s in own.values()], pa.int64()), pa.array([s.tobytes() for s in own.values()], pa.binary())]
            yield pa.record_batch(columns, names=["h1", "h2", "n", "data"])

    schema = "h1 long, h2 long, n long, data binary"
    found = keep_ids(docs, wanted.where("doc_id IS NOT NULL")).mapInArrow(sets, schema)
    if not wanted.where("doc_id IS NULL").isEmpty():
        found = found.unionByName(docs.where("doc_id IS NULL").mapInArrow(sets, schema))
    # Documents that repeat an id come along; of equal sets one stays.
    found = found.join(wanted.select("h1", "h2", "node"), ["h1", "h2"]).groupBy("node").agg(F.first("n").alias("n"), F.first("data").alias("data"))
    return materialize(facing(pairs, materialize(found, "sets"), linked, "8 * n").distinct(), "links")


def mixed(rows: DataFrame) -> DataFrame:
    """path, all, most and base (the largest component) of the paths with several components. rows: path, node, component."""
    sizes = rows.groupBy("path", "component").agg(F.count("*").alias("c"))
    out = sizes.groupBy("path").agg(F.sum("c").alias("all"), F.max("c").alias("most"), F.max_by("component", F.struct("c", "component")).alias("base"), F.count("*").alias("kinds"))
    return out.where("kinds > 1").drop("kinds")


def near_pairs(node: np.ndarray, component: np.ndarray, n: np.ndarray, other: np.ndarray, sketch: list[bytes], cut: int, every: bool) -> list[tuple[int, int]]:
    """The pairs of the first `cut` documents of a cell with the rest that may be linked, have different components and, unless `every`, join components that no earlier pair of the cell has joined."""
    up: dict[int, int] = {}

    def root(c: int) -> int:
        while c in up:
            c = up[c]
        return c

    widths = np.array([len(x) // 8 for x in sketch])
    rest = {w: np.flatnonzero(widths[cut:] == w) + cut for w in np.unique(widths[cut:]).tolist()}
    stacked = {w: np.frombuffer(b"".join(sketch[i] for i in at), dtype=np.uint64).reshape(-1, w) for w, at in rest.items()}
    out = []
    for i in range(cut):
        x, w = np.frombuffer(sketch[i], dtype=np.uint64), int(widths[i])
        for width in (w // 2, w, 2 * w):  # linked sets differ less than twofold in size
            if width not in rest:
                continue
            at = rest[width]
            good = np.flatnonzero((component[at] != component[i]) & (~other[at] | (node[at] > node[i])) & (100 * np.minimum(n[at], n[i]) >= LEVEL * np.maximum(n[at], n[i])))
            differ = apart(x, stacked[width][good])
            passed = may_link(n[at[good]], n[i], differ)
            good, differ = at[good[passed]], differ[passed]
            if not every and len(good):
                # Of each component the nearest, if it is not yet joined.
                order = np.lexsort((node[good], differ))
                good = good[order][np.unique(component[good[order]], return_index=True)[1]]
            for j in good.tolist():
                a, b = root(int(component[i])), root(int(component[j]))
                if every or a != b:
                    out.append((min(int(node[i]), int(node[j])), max(int(node[i]), int(node[j]))))
                if a != b:
                    up[max(a, b)] = min(a, b)
    return out


def compared(leaves: DataFrame, nodes: DataFrame, all_pairs: bool) -> DataFrame:
    """Pairs (a, b) of nodes that meet in a leaf, lie in different components and may be linked by their sketches: all, or in each cell those that join its components. leaves: path, node, component, n, all, most, base."""
    blocks, probes = F.ceil((F.col("all") - F.col("most")) / BLOCK).cast("int"), F.ceil(F.col("all") / PROBES).cast("int")
    rows = leaves.withColumn("blocks", blocks).withColumn("probes", probes).withColumn("other", F.col("component") != F.col("base")).drop("all", "most", "base")
    rows = materialize(rows.join(nodes.select("node", "sketch"), "node"), "leaves")
    copies = F.col("blocks") + F.when(F.col("other"), F.col("probes")).otherwise(0)
    total = rows.agg(F.sum((F.length("sketch") + 48) * copies)).first()[0] or 0
    parts = max(8, -(-int(total) // TASK_BYTES))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    probed = rows.withColumn("block", each("blocks")).withColumn("probe", F.pmod(F.xxhash64("node", F.lit(1)), F.col("probes")).cast("int")).withColumn("build", F.lit(False))
    built = rows.where("other").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("probe", each("probes")).withColumn("build", F.lit(True))
    cells = probed.unionByName(built).select(F.pmod(F.xxhash64("path", "block", "probe"), F.lit(parts)).alias("part"), "path", "block", "probe", "build", "other", "node", "component", "n", "sketch")

    def compare(table: pa.Table) -> pa.Table:
        table = table.sort_by([("path", "ascending"), ("block", "ascending"), ("probe", "ascending"), ("build", "descending")])
        path, block, probe, build, other, node, component, n = (table.column(c).to_numpy() for c in ("path", "block", "probe", "build", "other", "node", "component", "n"))
        sketch = table.column("sketch").to_pylist()
        new = np.flatnonzero((np.diff(path, prepend=path[:1] - 1) != 0) | (np.diff(block, prepend=-1) != 0) | (np.diff(probe, prepend=-1) != 0)).tolist()
        pairs: set[tuple[int, int]] = set()
        for start, end in zip(new, [*new[1:], len(path)]):
            cut = int(build[start:end].sum())
            if cut and cut < end - start:
                pairs.update(near_pairs(*(x[start:end] for x in (node, component, n, other, sketch)), cut, all_pairs))
        found = np.array(sorted(pairs), dtype=np.int64).reshape(-1, 2)
        return pa.table({"a": found[:, 0].copy(), "b": found[:, 1].copy()})

    return cells.groupBy("part").applyInArrow(compare, "a long, b long")


def connected(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """(node, component), the smallest node reachable by the links found, for every node."""
    of = components(found.select("a", "b")).withColumnRenamed("vertex", "node")
    return materialize(nodes.select("node").join(of, "node", "left").select("node", F.coalesce("component", "node").alias("component")), "classes")


def similar_classes(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable by links) and kept per row of docs."""
    prepare(docs.sparkSession)
    docs = documents(docs)
    rows = materialize(profile(docs), "profile")
    distinct = rows.where("n > 0").groupBy("h1", "h2").agg(F.max("n").alias("n"), F.min("doc_id").alias("doc_id"), F.first("signature").alias("signature"), F.first("sketch").alias("sketch"))
    nodes = materialize(distinct.withColumn("node", F.monotonically_increasing_id()), "nodes")
    # First level: every document of a tree's node against the smallest there.
    level = materialize(planted(nodes), "paths")
    groups = level.groupBy("path").agg(F.count("*").alias("c"), F.min("node").alias("least")).where("c > 1").drop("c")
    level = materialize(level.join(groups, "path"), "met")
    tried = materialize(level.where("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b")).distinct(), "tried")
    held = nodes.select("node", "n", F.col("sketch").alias("data"))
    side = lambda x: nodes.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"))
    alike = tried.join(side("a"), "a").join(side("b"), "b").where(sized_alike("n_a", "n_b")).select("a", "b")
    close = materialize(facing(materialize(alike, "alike"), held, near, "n div 2 + 32"), "near")
    found = links(close, nodes, docs)
    of = connected(nodes, found)
    # Nodes with several components: compared if small, else branched on.
    level = materialize(level.select("path", "node").join(of, "node").join(nodes.select("node", "n"), "node").select("path", "node", "component", "n"), "level-1")
    leaves = None
    for depth in range(1, DEPTH + 1):
        paths = materialize(mixed(level), "mixed")
        small = F.lit(depth == DEPTH) | (F.col("all") <= LEAF) | (F.col("all") - F.col("most") <= FEW)
        now = level.join(paths.where(small), "path")
        leaves = now if leaves is None else leaves.unionByName(now)
        more = paths.where(~small).select("path")
        if more.isEmpty():
            break
        level = materialize(branched(level.join(more, "path"), nodes, depth + 1), f"level-{depth + 1}")
    leaves = materialize(leaves, "leaves")
    for all_pairs in (False, True):
        joining = materialize(compared(leaves, nodes, all_pairs).distinct(), "joining")
        between = materialize(joining.join(tried, ["a", "b"], "left_anti"), "between")
        confirmed = 0
        if not between.isEmpty():
            extra = links(between, nodes, docs)
            confirmed = extra.count()
        if confirmed:
            found = found.unionAll(extra)
            of = connected(nodes, found)
        if all_pairs or confirmed == joining.count():
            break
        # Some pair was refuted, now or before, and it may have stood for others.
        tried = tried.unionAll(between)
        leaves = leaves.select("path", "node", "n").join(of, "node").select("path", "node", "component", "n")
        leaves = materialize(leaves.join(mixed(leaves), "path"), "leaves")
    whole = nodes.select("node", "h1", "h2", "doc_id").join(of, "node")
    least = whole.groupBy("component").agg(F.min("doc_id").alias("least"))
    whole = materialize(whole.join(least, "component").select("h1", "h2", "least"), "named")
    out = rows.select("doc_id", "n", "h1", "h2").join(whole, ["h1", "h2"], "left")
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("least")).alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def brute_force(docs: list[tuple]) -> list[tuple]:
    """The same rows from plain sets and all pairs, for tests."""
    import re

    def own(text: str | None) -> frozenset:
        words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        k = min(SHINGLE, len(words))
        return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) if words else frozenset()

    sets = [own(t) for _, t in docs]
    around: list[set] = [{i} for i in range(len(docs))]
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * (c := len(a & sets[j])) >= LEVEL * (len(a) + len(sets[j]) - c):
                around[i].add(j)
                around[j].add(i)
    out, done = {}, set()
    for i in range(len(docs)):
        if i in done:
            continue
        group, edge = {i}, [i]
        while edge:
            edge = [k for k in set().union(*(around[j] for j in edge)) if k not in group]
            group |= set(edge)
        done |= group
        named = [docs[j][0] for j in group if docs[j][0] is not None]
        for j in group:
            c = min(named) if named else None
            out[j] = (docs[j][0], len(sets[j]), c, docs[j][0] == c)
    return [out[i] for i in range(len(docs))]


ORACLE = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS MATERIALIZED (SELECT DISTINCT doc_id, hash(array_to_string(ws[i:i + least({SHINGLE}, len(ws)) - 1], ' ')) AS s FROM w, unnest(range(1, len(ws) - least({SHINGLE}, len(ws)) + 2)) AS r(i) WHERE len(ws) > 0),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= {LEVEL} * (x.n + y.n - c)),
e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach AS (SELECT a AS doc_id, a AS r FROM (SELECT DISTINCT a FROM e) UNION SELECT e.b, reach.r FROM reach JOIN e ON e.a = reach.doc_id WHERE reach.r < e.b),
m AS (SELECT doc_id, min(r) AS r FROM reach GROUP BY doc_id)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(coalesce(m.r, w.doc_id), w.doc_id)::BIGINT AS component_id, w.doc_id = least(coalesce(m.r, w.doc_id), w.doc_id) AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
"""


def query(spark, sf_dir: str) -> DataFrame:
    from .common import read

    return similar_classes(read(spark, sf_dir, "documents"))
