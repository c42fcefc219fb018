"""Words and word hashes of a text, vectorised with numpy.

A word is a maximal run of bytes outside ASCII white space (0x20, 0x09 to 0x0D),
which is what bytes.split() yields. Word hashes are polynomial hashes over the
word's bytes, read off one prefix sum per text and then mixed.
"""

from __future__ import annotations

import numpy as np

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_RNG = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _RNG.integers(0, 2**64, 256, dtype=np.uint64) | np.uint64(1)
_BASE, _WORD_BASE = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
#: Longer texts are hashed in pieces that end between words.
PIECE = 1 << 20
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i up to n."""
    have = _powers.get(base)
    if have is None or len(have[0]) <= n:
        size = max(1 << 14, 1 << int(n).bit_length())
        out = []
        for b in (base, pow(base, -1, 2**64)):
            a = np.full(size + 1, b, dtype=np.uint64)
            a[0] = 1
            out.append(np.cumprod(a, dtype=np.uint64))
        have = _powers[base] = (out[0], out[1])
    return have


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of each word, in order."""
    if len(text) > PIECE:
        out, at = [], 0
        while at < len(text):
            end = min(len(text), at + PIECE)
            while end < len(text) and not SPACE[text[end]]:
                end += 1
            out.append(_hashes(text[at:end]))
            at = end
        return np.concatenate(out)
    return _hashes(text)


def _hashes(text: bytes) -> np.ndarray:
    a = np.frombuffer(text, dtype=np.uint8)
    inside = np.zeros(len(a) + 2, dtype=np.int8)
    inside[1:-1] = ~SPACE[a]
    step = np.diff(inside)
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    up, down = powers(_BASE, len(a))
    total = np.zeros(len(a) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[a] * up[: len(a)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts])


def rolling(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of k consecutive words."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    if k <= 8:
        h = words[:n].copy()
        for j in range(1, k):
            h *= np.uint64(_WORD_BASE)
            h += words[j : n + j]
        return mix(h)
    up, down = powers(_WORD_BASE, len(words))
    total = np.zeros(len(words) + 1, dtype=np.uint64)
    np.cumsum(words * up[: len(words)], out=total[1:])
    return mix((total[k:] - total[:n]) * down[:n])


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of k-word shingles; of the whole sequence if there are fewer words; none without words."""
    if not len(words):
        return words
    return np.unique(rolling(words, min(k, len(words))))
