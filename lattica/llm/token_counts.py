r"""Edit-aware token counts (operator 10).

A document keeps its pre-tokens in a segment tree: a leaf holds the text of a block
of pre-tokens with the end and token count of each, inner nodes the characters,
tokens and pre-tokens below them. An edit replaces a span of characters. Only what
it touches is encoded again: from the last pre-token whose split cannot depend on
the edited characters (it ends a margin before them), to the first old pre-token
border beyond the edit at which splitting meets it. There the split of the rest is
the same, as a split depends only on what follows it. The blocks that hold these
pre-tokens are replaced and the sums above them updated, so an edit costs about a
block, however long the text. Blocks that grow too large are split and the tree is
built anew, once in about BLOCK added pre-tokens.

The vocabulary's added tokens, such as <|endoftext|>, are pre-tokens of their own.

documents holds texts without edits, so the query derives an edit log by rule:
runs of white space other than one space or line end are made one, and e-mail
addresses and long digit runs become placeholders. Any table (doc_id, start,
end, replacement) may be given instead.

A document is counted alone in one pass over the table; its edit log is joined by
doc_id where it comes as a table. The words that a task remembers are bounded.

Defined cases: a null or empty text has no tokens (edits at 0 may fill it); null
doc_ids are counted and have no edits; repeated rows are counted each; edits of a
document apply in order of (start, end) to the original text, those that overlap
an earlier one or end beyond the text are left out and counted as skipped; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, ids, prepare, texts
from .tokens import CACHE, LONGEST, added, added_pattern, encoding

#: Characters that a split looks ahead, beside what a longer added token may bind.
CONTEXT = 4
#: Pre-tokens of a block; one is split when it has twice as many.
BLOCK = 64
SCHEMA = "doc_id long, n_tokens long, n_edits long, n_skipped long, n_tokens_after long, n_pretokens long, n_reencoded long"

#: An address begins at its run's first character or right after another address, so long runs are read once.
_EDITS = re.compile(r"(?:(?<![\w.%+-])|(?<=[\w-])(?=[%+]|\.[.%+@]))[\w.%+-]+@[\w-]+(?:\.[\w-]+)+|\d{9,}|[^\S\n]{2,}|\n{2,}|\t")


class Splitter:
    """Splits into pre-tokens and counts the tokens of each."""

    def __init__(self, path: str | None = None, cache: int = CACHE):
        import public_tokenizers
        import regex

        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.encode = encoding(path).encode_ordinary
        self.added = added(path)
        self.stops = added_pattern(self.added)
        #: How far before an edit a split is safe.
        self.margin = CONTEXT + max(map(len, self.added), default=0)
        self.known: dict[str, int] = {}
        self.cache = cache

    def pretokens(self, text: str) -> list[str]:
        if self.stops is None or not self.stops.search(text):
            return self.pattern.findall(text)
        return [text[a:b] for a, b in self.bounds(text, 0)]

    def bounds(self, text: str, at: int) -> Iterator[tuple[int, int]]:
        """Where pre-tokens from the character at on start and end; text ends at an added token as it does at its own end."""
        while at < len(text):
            stop = self.stops.search(text, at) if self.stops else None
            for m in self.pattern.finditer(text, at, stop.start() if stop else len(text)):
                yield m.span()
            if stop is None:
                return
            yield stop.span()
            at = stop.end()

    def counts(self, pretokens: list[str]) -> list[int]:
        out = list(map(self.known.get, pretokens))
        if None in out:
            out = [self.count(p) if n is None else n for p, n in zip(pretokens, out)]
        return out

    def count(self, pretoken: str) -> int:
        n = self.known.get(pretoken)
        if n is None:
            n = 1 if pretoken in self.added else len(self.encode(pretoken))
            if len(self.known) < self.cache and len(pretoken) <= LONGEST:
                self.known[pretoken] = n
        return n


class Block:
    """A leaf: consecutive pre-tokens, their ends in the block's text and their token counts."""

    __slots__ = ("text", "ends", "counts")

    def __init__(self, text: str, ends: list[int], counts: list[int]):
        self.text, self.ends, self.counts = text, ends, counts

    def sums(self) -> tuple[int, int, int]:
        return len(self.text), sum(self.counts), len(self.ends)


class Tree:
    """Segment tree over blocks: node i has the children 2i and 2i + 1 and the sums of their characters, tokens and pre-tokens."""

    def __init__(self, blocks: list[Block]):
        self.blocks = blocks
        self.leaves = 1 << max(0, len(blocks) - 1).bit_length()
        self.nodes = [(0, 0, 0)] * (2 * self.leaves)
        self.nodes[self.leaves : self.leaves + len(blocks)] = [b.sums() for b in blocks]
        for i in range(self.leaves - 1, 0, -1):
            self._add(i)

    def _add(self, i: int) -> None:
        (a, b, c), (x, y, z) = self.nodes[2 * i], self.nodes[2 * i + 1]
        self.nodes[i] = (a + x, b + y, c + z)

    @property
    def total(self) -> int:
        return self.nodes[1][1]

    def find(self, char: int) -> tuple[int, int]:
        """The block that holds a character, the last one for the text's end, and where the block starts."""
        i, start = 1, 0
        if char >= self.nodes[1][0]:
            return len(self.blocks) - 1, self.nodes[1][0] - len(self.blocks[-1].text)
        while i < self.leaves:
            i *= 2
            if char - start >= self.nodes[i][0]:
                start += self.nodes[i][0]
                i += 1
        return i - self.leaves, start

    def update(self, changed: range) -> None:
        """Sums anew the nodes above the blocks."""
        level = {self.leaves + i for i in changed}
        for i in level:
            self.nodes[i] = self.blocks[i - self.leaves].sums()
        while min(level) > 1:  # all on one level
            level = {i // 2 for i in level}
            for i in level:
                self._add(i)


class Document:
    """A text with its pre-tokens; edit() keeps the counts right."""

    def __init__(self, text: str, splitter: Splitter):
        self.splitter, self.reencoded = splitter, 0
        pretokens = splitter.pretokens(text)
        counts, blocks, at = splitter.counts(pretokens), [], 0
        for i in range(0, max(1, len(pretokens)), BLOCK):
            ends = list(accumulate(map(len, pretokens[i : i + BLOCK])))
            size = ends[-1] if ends else 0
            blocks.append(Block(text[at : at + size], ends, counts[i : i + BLOCK]))
            at += size
        self.tree = Tree(blocks)

    @property
    def text(self) -> str:
        return "".join(b.text for b in self.tree.blocks)

    @property
    def pretokens(self) -> int:
        return self.tree.nodes[1][2]

    def edit(self, start: int, end: int, new: str) -> None:
        """Puts new in place of the characters start to end."""
        tree, margin = self.tree, self.splitter.margin
        blocks = tree.blocks
        low, origin = tree.find(max(0, start - margin))
        while low and origin and blocks[low].ends and blocks[low].ends[0] + origin > start - margin:
            low -= 1  # the block has no border that is safe; its start may not be
            origin -= len(blocks[low].text)
        high = tree.find(end)[0]
        while True:
            whole = "".join(b.text for b in blocks[low : high + 1])
            ends, counts, size = [], [], 0
            for b in blocks[low : high + 1]:
                ends += [size + e for e in b.ends]
                counts += b.counts
                size += len(b.text)
            a, z = start - origin, end - origin
            text = whole[:a] + new + whole[z:]
            moved, edited = len(new) - (z - a), a + len(new)
            first = bisect_right(ends, a - margin)
            old, fresh, met = bisect_left(ends, z), [], None
            # At the range's end a split is known only if the text ends there too.
            sure = len(text) if high == len(blocks) - 1 else len(text) - margin
            for x, y in self.splitter.bounds(text, ends[first - 1] if first else 0):
                if y > sure:
                    break
                fresh.append((x, y))
                if y >= edited:
                    while old < len(ends) and ends[old] + moved < y:
                        old += 1
                    if old < len(ends) and ends[old] + moved == y:
                        met = old + 1
                        break
            if met is None and high < len(blocks) - 1:
                high = min(len(blocks) - 1, high + max(1, high - low + 1))
                continue
            break
        met = len(ends) if met is None else met
        self.reencoded += len(fresh)
        ends[first:] = [y for _, y in fresh] + [e + moved for e in ends[met:]]
        counts[first:] = self.splitter.counts([text[x:y] for x, y in fresh]) + counts[met:]
        self._replace(low, high, text, ends, counts)

    def _replace(self, low: int, high: int, text: str, ends: list[int], counts: list[int]) -> None:
        """Spreads pre-tokens over the blocks low to high as they lay before, or over new ones if they are too many."""
        many = high - low + 1
        if len(ends) > 2 * BLOCK * many:
            many = -(-len(ends) // BLOCK)
        each, at, out = -(-len(ends) // many), 0, []
        for i in range(many):
            part = ends[i * each : (i + 1) * each]
            size = part[-1] if part else at
            out.append(Block(text[at:size], [e - at for e in part], counts[i * each : (i + 1) * each]))
            at = size
        self.tree.blocks[low : high + 1] = out
        if len(out) == high - low + 1:
            self.tree.update(range(low, high + 1))
        else:
            self.tree = Tree(self.tree.blocks)


def rule_edits(text: str) -> list[tuple[int, int, str]]:
    """The query's edit log: white space is tidied; addresses and long digit runs become placeholders."""
    out = []
    for m in _EDITS.finditer(text):
        s = m[0]
        out.append((m.start(), m.end(), "<email>" if "@" in s else "<number>" if s[0].isdigit() else "\n" if "\n" in s else " "))
    return out


def apply_edits(text: str, edits: list[tuple[int, int, str]], splitter: Splitter) -> tuple[Document, int, int, int]:
    """The document after the edits, its token count before, and the edits applied and skipped."""
    doc = Document(text, splitter)
    before, shift, free, done = doc.tree.total, 0, 0, 0
    for start, end, new in sorted(edits):
        if start < free or end < start or end > len(text):
            continue
        doc.edit(start + shift, end + shift, new)
        shift += len(new) - (end - start)
        free, done = end, done + 1
    return doc, before, done, len(edits) - done


def token_counts(docs: DataFrame, edits: DataFrame | None = None, path: str | None = None) -> DataFrame:
    """Token counts before and after the edits per row of docs. edits: doc_id, start, end, replacement; by default those of rule_edits."""
    prepare(docs.sparkSession)
    docs = documents(docs)
    logged = edits is not None
    if logged:
        log = edits.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.collect_list(F.struct(F.col("start").cast("long").alias("s"), F.col("end").cast("long").alias("e"), F.col("replacement").alias("r"))).alias("edits"))
        docs = docs.join(log, "doc_id", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = Splitter(path)
        for batch in batches:
            rows = []
            logs = batch.column(2).to_pylist() if logged else [None] * batch.num_rows
            for t, log in zip(texts(batch), logs):
                t = t or ""
                log = rule_edits(t) if not logged else [(x["s"], x["e"], x["r"] or "") for x in log or ()]
                doc, before, done, skipped = apply_edits(t, log, splitter)
                rows.append((before, done, skipped, doc.tree.total, doc.pretokens, doc.reencoded))
            columns = list(zip(*rows)) or [()] * 6
            yield pa.record_batch([ids(batch).cast(pa.int64()), *(pa.array(c, pa.int64()) for c in columns)], names=["doc_id", "n_tokens", "n_edits", "n_skipped", "n_tokens_after", "n_pretokens", "n_reencoded"])

    return docs.mapInArrow(run, SCHEMA)


def query(spark, sf_dir: str) -> DataFrame:
    from .common import read

    return token_counts(read(spark, sf_dir, "documents"))
