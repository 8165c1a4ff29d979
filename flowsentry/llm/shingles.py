"""Sets of hashed word shingles, computed for many texts at once."""

from __future__ import annotations

from functools import cache

import numpy as np

from .common import ASCII_LOWER

WIDTH = 5
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)


def mix(value: np.ndarray) -> np.ndarray:
    """Spreads 64 bits over 64 bits, one to one."""
    value = (value ^ (value >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    value = (value ^ (value >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return value ^ (value >> np.uint64(31))


@cache
def _bytes() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * _BASE)


def _word_hashes(codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every word codes[start:end], from running sums of weighted bytes.

    Byte b at place k of its word counts as table[b] * BASE ** k. Weights restart at every word, so
    the sums are exact modulo 2 ** 64 whatever the length of the text.
    """
    length = end - start
    longest = int(length.max())
    powers = np.cumprod(np.append(np.uint64(1), np.full(longest, _BASE, np.uint64)), dtype=np.uint64)
    origin = np.repeat(np.append(0, start), np.diff(np.concatenate([[0], start, [len(codes)]])))
    weight = powers[np.minimum(np.arange(len(codes)) - origin, longest)]
    total = np.cumsum(_bytes()[codes] * weight, dtype=np.uint64)
    before = np.where(start > 0, total[np.maximum(start - 1, 0)], np.uint64(0))
    return mix(total[end - 1] - before + length.astype(np.uint64))


def shingle_sets(texts: list[bytes | None]) -> list[np.ndarray]:
    """For every text, the sorted distinct hashes of its runs of WIDTH words.

    A text with fewer words has one hash, of all its words; without a word, none.
    """
    lengths = np.array([len(t or b"") + 1 for t in texts], np.int64)
    codes = np.frombuffer(b" ".join(t or b"" for t in texts).translate(ASCII_LOWER) + b" ", np.uint8)
    space = _SPACE[codes]
    edge = np.diff(np.concatenate([[True], space, [True]]).astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    words = _word_hashes(codes, start, end) if len(start) else np.zeros(0, np.uint64)
    first = np.searchsorted(start, np.concatenate([[0], np.cumsum(lengths)]))
    runs = np.zeros(0, np.uint64)
    if len(words) >= WIDTH:
        runs = np.zeros(len(words) - WIDTH + 1, np.uint64)
        for k in range(WIDTH):
            runs += words[k:k + len(runs)] * mix(np.array([k + 1], np.uint64) * _BASE)
        runs = mix(runs)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= WIDTH:
            out.append(np.unique(runs[a:b - WIDTH + 1]))
        elif b > a:
            weights = mix(np.arange(11, 11 + b - a, dtype=np.uint64) * _BASE)
            out.append(mix((words[a:b] * weights).sum(keepdims=True) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
