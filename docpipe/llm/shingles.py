"""64-bit hashes of words and of five-word shingles, vectorised over bytes.

A word is a run of bytes other than space, tab, line feed, vertical tab, form
feed and carriage return, with A-Z lower-cased. Equal words have equal hashes;
two different shingles of one pair of documents share a hash with probability
of about 2**-64 each, which is the only inexactness.
"""

from __future__ import annotations

import numpy as np

WORDS = 5
_M1, _M2, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_BYTE = np.arange(256, dtype=np.uint64)
_IS_WORD = np.ones(256, bool)
_IS_WORD[[32, 9, 10, 11, 12, 13]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: A random odd value for each byte after lower-casing; 0 for white space.
_VALUE = np.where(_IS_WORD, mix((_LOWER.astype(np.uint64) + np.uint64(1)) * _GOLD) | np.uint64(1), np.uint64(0))
_BASE = np.uint64(0x5851F42D4C957F2D)
_PLACE = mix((_BYTE[:WORDS] + np.uint64(77)) * _GOLD) | np.uint64(1)
CHUNK = 1 << 20


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _BASE, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _hash_words(data: np.ndarray) -> np.ndarray:
    inside = _IS_WORD[data]
    if not inside.any():
        return np.empty(0, np.uint64)
    edge = np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    lengths = ends - starts
    powers = _powers(int(lengths.max()))
    values = _VALUE[data[inside]]
    first = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    place = np.arange(len(values)) - np.repeat(first, lengths)
    return mix(np.add.reduceat(values * powers[place], first) + lengths.astype(np.uint64))


def word_hashes(text: bytes) -> np.ndarray:
    """Hashes of all words in order. Long texts go in chunks cut at white space,
    so temporaries are bounded by the chunk or the longest word."""
    data = np.frombuffer(text, np.uint8)
    if len(data) <= CHUNK:
        return _hash_words(data)
    parts, start = [], 0
    while start < len(data):
        end = min(start + CHUNK, len(data))
        while end < len(data) and _IS_WORD[data[end]]:
            gap = np.flatnonzero(~_IS_WORD[data[end : end + CHUNK]])
            end = end + int(gap[0]) if len(gap) else min(end + CHUNK, len(data))
        parts.append(_hash_words(data[start:end]))
        start = end
    return np.concatenate(parts)


def all_shingles(words: np.ndarray, size: int = WORDS) -> np.ndarray:
    """Hash of each run of ``size`` words; fewer words make one shingle."""
    if not len(words):
        return words
    n = min(size, len(words))
    last = len(words) - n + 1
    total = np.full(last, np.uint64(n), np.uint64)
    for i in range(n):
        total += words[i : i + last] * _PLACE[i]
    return mix(total)


def shingle_set(text: bytes | None) -> np.ndarray:
    """Sorted distinct shingle hashes of one text; empty without words."""
    return np.unique(all_shingles(word_hashes(text))) if text else np.empty(0, np.uint64)
