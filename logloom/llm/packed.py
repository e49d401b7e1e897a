"""Sorted pairs of words in a few bytes each, for shuffles whose rows would be longer than what they say.

Words have codes: the most frequent ones small numbers, all others their hash with the top bit set. Pairs of two small
numbers are one key; sorted keys are kept as differences, byte by byte in planes, compressed. A pair takes two to four
bytes so, one with a hashed word about nine.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bits of a frequent word's number, and of the context beside it.
WORD_BITS, CONTEXT_BITS = 16, 6
HASHED = np.uint64(1 << 63)
_CODEC = pa.Codec("zstd", compression_level=1)
#: Parts of one that sums are rounded to; a message's rounding is far below what the sums of a document show.
_PARTS = float(1 << 32)


def planes(x: np.ndarray, differences: bool = False) -> bytes:
    """Unsigned numbers as compressed planes of their bytes; ``differences`` suits sorted ones."""
    x = np.ascontiguousarray(x, np.uint64)
    if differences and len(x):
        x = np.concatenate((x[:1], np.diff(x)))
    used = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
    body = x.view(np.uint8).reshape(-1, 8)[:, :used].T
    return bytes([used]) + len(x).to_bytes(5, "little") + _CODEC.compress(np.ascontiguousarray(body), asbytes=True)


def numbers(data: bytes, differences: bool = False) -> np.ndarray:
    used, n = data[0], int.from_bytes(data[1:6], "little")
    body = np.frombuffer(_CODEC.decompress(memoryview(data)[6:], used * n), np.uint8).reshape(used, n)
    out = np.zeros((body.shape[1], 8), np.uint8)
    out[:, :used] = body.T
    x = out.view(np.uint64).ravel()
    return np.cumsum(x, dtype=np.uint64) if differences else x


def fixed(x: np.ndarray) -> bytes:
    """Sums of logarithms in fixed point, rounded to 2^-32."""
    q = np.rint(x * _PARTS).astype(np.int64)
    return planes(((q << 1) ^ (q >> 63)).view(np.uint64))


def unfixed(data: bytes) -> np.ndarray:
    q = numbers(data)
    return ((q >> np.uint64(1)).view(np.int64) ^ -(q & np.uint64(1)).view(np.int64)) / _PARTS


def doubles(x: np.ndarray) -> bytes:
    """Any numbers as they are, compressed; many of them equal."""
    return _CODEC.compress(np.ascontiguousarray(x, np.float64), asbytes=True)


def doubled(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(_CODEC.decompress(data, 8 * n), np.float64)


@dataclass
class Pairs:
    """Distinct pairs (context x, word y), sorted by x and y; ``small`` of them come first, whose codes are both numbers."""

    x: np.ndarray
    y: np.ndarray
    small: int

    def pack(self) -> tuple[bytes, bytes, bytes]:
        n = self.small
        return planes(self.x[:n] << np.uint64(WORD_BITS) | self.y[:n], True), planes(self.x[n:], True), planes(self.y[n:])

    @staticmethod
    def unpack(a: bytes, b: bytes, c: bytes) -> Pairs:
        key, x, y = numbers(a, True), numbers(b, True), numbers(c)
        return Pairs(np.concatenate((key >> np.uint64(WORD_BITS), x)), np.concatenate((key & np.uint64((1 << WORD_BITS) - 1), y)), len(key))

    def find(self, other: Pairs) -> tuple[np.ndarray, np.ndarray]:
        """For each pair of ``other`` (in any order) its place here, and whether it is here."""
        place, hit = np.zeros(len(other.x), np.int64), np.zeros(len(other.x), bool)
        n, m = self.small, other.small
        if n and m:
            own = self.x[:n] << np.uint64(WORD_BITS) | self.y[:n]
            key = other.x[:m] << np.uint64(WORD_BITS) | other.y[:m]
            at = np.minimum(np.searchsorted(own, key), n - 1)
            place[:m], hit[:m] = at, own[at] == key
        if len(self.x) > n and len(other.x) > m:
            # by x, then by halves in the run of x: what this costs hardly depends on the pairs that are here
            own, x, y = self.y[n:], other.x[m:], other.y[m:]
            low, end = (np.searchsorted(self.x[n:], x, side) for side in ("left", "right"))
            high, left = end.copy(), np.flatnonzero(low < end)
            while len(left):
                middle = (low[left] + high[left]) >> 1
                less = own[middle] < y[left]
                low[left[less]] = middle[less] + 1
                high[left[~less]] = middle[~less]
                left = left[low[left] < high[left]]
            here = (low < end) & (own[np.minimum(low, len(own) - 1)] == y)
            place[m:], hit[m:] = np.where(here, low + n, 0), here
        return place, hit


def distinct(x: np.ndarray, y: np.ndarray) -> tuple[Pairs, np.ndarray, np.ndarray]:
    """Distinct pairs in order; an order of the given pairs by them, and where in it each begins."""
    small = (x >> np.uint64(63) | y >> np.uint64(63)) == 0
    a, b = np.flatnonzero(small), np.flatnonzero(~small)
    key = x[a] << np.uint64(WORD_BITS) | y[a]
    bits = len(a).bit_length()
    if 2 * WORD_BITS + CONTEXT_BITS + bits <= 64:
        # places below the keys: numbers are sorted several times faster than places by them
        key = np.sort(key << np.uint64(bits) | np.arange(len(a), dtype=np.uint64))
        a = a[(key & np.uint64((1 << bits) - 1)).astype(np.int64)]
    else:
        a = a[np.argsort(key, kind="stable")]
    b = b[np.lexsort((y[b], x[b]))]
    order = np.concatenate((a, b))
    x, y = x[order], y[order]
    first = np.ones(len(x), bool)
    first[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
    if len(a) and len(b):
        first[len(a)] = True
    at = np.flatnonzero(first)
    return Pairs(x[at], y[at], int(np.searchsorted(at, len(a)))), order, at


def counted(x: np.ndarray, y: np.ndarray) -> tuple[Pairs, np.ndarray]:
    """Distinct pairs in order, and how often each occurs."""
    small = (x >> np.uint64(63) | y >> np.uint64(63)) == 0
    key, n = np.unique(x[small] << np.uint64(WORD_BITS) | y[small], return_counts=True)
    rest, order, at = distinct(x[~small], y[~small])
    pairs = Pairs(np.concatenate((key >> np.uint64(WORD_BITS), rest.x)), np.concatenate((key & np.uint64((1 << WORD_BITS) - 1), rest.y)), len(key))
    return pairs, np.concatenate((n, np.diff(np.append(at, len(order)))))
