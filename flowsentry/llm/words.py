"""Words of many texts at a time, as places in one byte array, and their hashes."""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
import xxhash

from .shingles import mix

_BASE = np.uint64(0x9E3779B97F4A7C15)


@cache
def _of_byte() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * _BASE)


def spans(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def spelt(codes: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.DictionaryArray]:
    """Starts and ends of the runs of True, and their bytes, equal ones kept once."""
    start, end = spans(inside)
    places = np.append(0, np.cumsum(end - start)).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(places), pa.py_buffer(codes[inside])])
    return start, end, words.dictionary_encode()


def part_of(place: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """How many of ``ends`` are not beyond each place; both ascend, the last end lies beyond all places."""
    return np.repeat(np.arange(len(ends)), np.diff(np.searchsorted(place, ends), prepend=0))


_EIGHT = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)  # the first k of eight bytes
LONG_SPAN = 64


def span_hashes(codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of codes[start:end], eight bytes at a time; spans beyond LONG_SPAN one by one."""
    # Eight bytes from every place on.
    eights = np.ndarray(len(codes) + 1, "<u8", np.append(codes, np.zeros(8, np.uint8)), strides=(1,))
    size = end - start
    out = mix(size.astype(np.uint64) * _BASE)
    rest = np.flatnonzero(size <= LONG_SPAN)
    at, left = start[rest], size[rest]
    while len(rest):
        out[rest] = mix(out[rest] * _BASE + (eights[at] & _EIGHT[np.minimum(left, 8)]))
        more = left > 8
        rest, at, left = rest[more], at[more] + 8, left[more] - 8
    for k in np.flatnonzero(size > LONG_SPAN).tolist():
        out[k] = xxhash.xxh64_intdigest(codes[start[k]:end[k]])
    return out


class SpanHashes:
    """64-bit hashes of codes[start:end] and of their first bytes.

    Byte b at place k of its span counts as table[b] * BASE ** k. Weights restart at every span, so
    running sums are exact modulo 2 ** 64.
    """

    def __init__(self, codes: np.ndarray, start: np.ndarray, end: np.ndarray):
        self.start, self.end = start, end
        longest = int((end - start).max(initial=0))
        powers = np.cumprod(np.append(np.uint64(1), np.full(longest, _BASE, np.uint64)), dtype=np.uint64)
        origin = np.repeat(np.append(0, start), np.diff(np.concatenate([[0], start, [len(codes)]])))
        weight = powers[np.minimum(np.arange(len(codes)) - origin, longest)]
        self.total = np.append(np.uint64(0), np.cumsum(_of_byte()[codes] * weight, dtype=np.uint64))

    def upto(self, end: np.ndarray) -> np.ndarray:
        return mix(self.total[end] - self.total[self.start] + (end - self.start).astype(np.uint64))

    def whole(self) -> np.ndarray:
        return self.upto(self.end)

    def first(self, size: int) -> np.ndarray:
        return self.upto(np.minimum(self.end, self.start + size))


class BitFilter:
    """A Bloom filter of two slots per key, in 64-bit words."""

    def __init__(self, words: np.ndarray):
        self.words = words.view(np.uint64)
        self.mask = np.uint64(64 * len(words) - 1)

    @staticmethod
    def slots(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        mask = np.uint64((1 << bits) - 1)
        return keys & mask, mix(keys) & mask

    def has(self, keys: np.ndarray) -> np.ndarray:
        found = np.ones(len(keys), bool)
        for slot in (keys & self.mask, mix(keys) & self.mask):
            found &= (self.words[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) > 0
        return found
