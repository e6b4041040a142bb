"""Words of UTF-8 texts and their 64-bit hashes, computed with numpy over whole byte buffers.

A word is a maximal run of bytes that are not separators. Both separator sets used here hold
ASCII bytes only, so a run of bytes is also a run of whole code points.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

#: Buffers are hashed in pieces of about this many bytes, so that a very long text needs bounded memory.
PIECE = 1 << 20

WHITE = np.zeros(256, bool)
WHITE[[0x20, 9, 10, 11, 12, 13]] = True

#: Everything ASCII that is neither a letter nor a digit.
NOT_WORD = np.zeros(256, bool)
NOT_WORD[:128] = True
for _lo, _hi in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A)):
    NOT_WORD[_lo : _hi + 1] = False

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_BASE = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


@lru_cache(maxsize=4)
def _powers(n: int) -> np.ndarray:
    out = np.full(n, _BASE, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def powers(n: int) -> np.ndarray:
    """Powers of an odd base modulo 2**64, for word lengths up to n."""
    return _powers(max(256, 1 << (n - 1).bit_length() if n > 1 else 1))


def spans(buf: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a buffer."""
    inside = np.empty(len(buf) + 2, bool)
    inside[0] = inside[-1] = False
    np.logical_not(separators[buf], out=inside[1:-1])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[::2], edges[1::2]


def hash_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of a buffer (spans don't overlap and aren't empty)."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    inside = np.zeros(len(buf) + 1, np.int8)
    inside[starts] += 1
    inside[ends] -= 1
    held = np.flatnonzero(np.cumsum(inside[:-1], dtype=np.int8))
    first = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    at = np.arange(len(held)) - np.repeat(first, lengths)
    total = np.add.reduceat(_BYTE[buf[held]] * powers(int(lengths.max()))[at], first)
    return mix(total + lengths.astype(np.uint64) * np.uint64(0xA0761D6478BD642F))


def word_hashes(text: bytes, separators: np.ndarray = WHITE, lower: bool = False) -> np.ndarray:
    """The hash of each word of a text, in order."""
    whole = np.frombuffer(text, np.uint8)
    if len(whole) <= PIECE:
        buf = LOWER[whole] if lower else whole
        return hash_spans(buf, *spans(buf, separators))
    out, at = [], 0
    while at < len(whole):
        end = min(len(whole), at + PIECE)
        while end < len(whole):  # cut at a separator; a word that fills the piece makes it longer
            cut = np.flatnonzero(separators[whole[at:end]])
            if len(cut):
                end = at + int(cut[-1]) + 1
                break
            end = min(len(whole), end + PIECE)
        buf = LOWER[whole[at:end]] if lower else whole[at:end]
        out.append(hash_spans(buf, *spans(buf, separators)))
        at = end
    return np.concatenate(out)


_SHIFT = mix(np.arange(11, 19, dtype=np.uint64)) | np.uint64(1)


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """The hash of each run of `size` words, in order; of the whole sequence if it is shorter; none without words."""
    n = len(words)
    if not n:
        return words
    width = min(size, n)
    total = np.zeros(n - width + 1, np.uint64)
    for k in range(width):
        total += mix(words[k : n - width + 1 + k] + _SHIFT[k]) * _SHIFT[k]
    return mix(total + np.uint64(width))
