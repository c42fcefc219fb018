"""Token ids of whole texts with a cache of space-separated parts.

A byte-level BPE splits a text before merging. Unless white space surrounds a
space, a split never spans a cut before that space: so a text is cut there,
and each part (with its space) is encoded once and then remembered. Texts in
which a split could span a cut are encoded whole.

The vocabulary is a tokenizers file. Its ids are in merge order, so they serve
as ranks for tiktoken, which merges four times faster with the same ids
(tests/llm compares them with the tokenizers library's).

Strings of the file's added tokens, such as <|endoftext|>, are one id wherever they
stand in a text, as the tokenizers library has it; the text around them is encoded
piece by piece.
"""

from __future__ import annotations

import json
import re
from array import array

VOCABULARY = "byte_bpe_50k.json"
#: Parts remembered by a worker; when full, new parts are encoded each time.
CACHE = 500_000
#: Longer parts are not remembered.
LONGEST = 48

_SPANS = re.compile(r"\s (?:\s|\Z)")


def byte_of_char() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary, inverted."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _file(path: str | None) -> dict:
    import public_tokenizers

    with open(path or public_tokenizers.path(VOCABULARY), encoding="utf-8") as f:
        return json.load(f)


def added(path: str | None = None) -> dict[str, int]:
    """The added tokens of a tokenizers file and their ids. Those that take in spaces or ask for whole words are not supported."""
    tokens = _file(path)["added_tokens"]
    if any(t[flag] for t in tokens for flag in ("single_word", "lstrip", "rstrip")):
        raise ValueError("added tokens that strip spaces or match whole words only")
    return {t["content"]: t["id"] for t in tokens}


def added_pattern(tokens: dict[str, int]) -> re.Pattern | None:
    """Finds added tokens, the longest first; None if there are none."""
    return re.compile("|".join(map(re.escape, sorted(tokens, key=len, reverse=True)))) if tokens else None


def encoding(path: str | None = None):
    """A tiktoken encoding of the vocabulary in a tokenizers file, or in the public one, without its added tokens."""
    import public_tokenizers
    import tiktoken

    file = _file(path)
    to, extra = byte_of_char(), {t["content"] for t in file["added_tokens"]}
    ranks = {bytes(map(to.__getitem__, k)): v for k, v in file["model"]["vocab"].items() if k not in extra and all(c in to for c in k)}
    return tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def spans(text: str) -> bool:
    return _SPANS.search(text) is not None


class Encoder:
    """batch(texts): the ids of each, as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str | None = None, cache: int = CACHE):
        self.encode = encoding(path).encode_ordinary
        self.added = added(path)
        self.stops = added_pattern(self.added)
        self.known: dict[str, bytes] = {}  # by the part without its space
        self.cache = cache

    def ids(self, text: str) -> bytes:
        return array("I", self.encode(text)).tobytes()

    def one(self, text: str) -> bytes:
        if self.stops is None or not self.stops.search(text):
            return self.plain(text)
        out, at = [], 0
        for m in self.stops.finditer(text):
            out += [self.plain(text[at : m.start()]), array("I", [self.added[m[0]]]).tobytes()]
            at = m.end()
        return b"".join([*out, self.plain(text[at:])])

    def plain(self, text: str) -> bytes:
        if spans(text):
            return self.ids(text)
        known, parts = self.known, text.split(" ")
        out = [self.ids(parts[0]), *map(known.get, parts[1:])]
        for i in [i for i, ids in enumerate(out) if ids is None]:
            out[i] = known.get(parts[i])  # an earlier part of this text may have added it
            if out[i] is None:
                out[i] = self.ids(" " + parts[i])
                if len(known) < self.cache and len(parts[i]) <= LONGEST:
                    known[parts[i]] = out[i]
        return b"".join(out)

    def batch(self, texts: list[str]) -> list[bytes]:
        return [self.one(t) for t in texts]
