"""Words as 64-bit hashes, computed for whole texts with array operations.

A word's hash is a polynomial over per-byte random values modulo 2^64, mixed at the end. Two different words meet with
probability about 2^-64; operators that must not rely on that compare the words themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes hashed at once; longer texts are cut at separators, so memory stays bounded unless one word is longer.
CHUNK = 1 << 20

_P = 0x9E3779B97F4A7C15 | 1
_PINV = pow(_P, -1, 1 << 64)
_VALUES = np.random.Generator(np.random.PCG64(20240601)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P^i and P^-i modulo 2^64 for i < n."""
    if not _powers or len(_powers[0]) < n:
        size = max(1 << 12, 1 << (n - 1).bit_length())
        made = []
        for base in (_P, _PINV):
            out = np.full(size, base, np.uint64)
            out[0] = 1
            made.append(np.multiply.accumulate(out))
        _powers[:] = made
    return _powers[0], _powers[1]


class Words:
    """A word definition over bytes: which bytes separate words, and whether A-Z count as a-z."""

    def __init__(self, separators: bytes, lower: bool):
        self.sep = np.zeros(256, bool)
        self.sep[list(separators)] = True
        fold = np.arange(256)
        if lower:
            fold[65:91] += 32
        self.values = _VALUES[fold]

    def bounds(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Byte offsets where words start and end."""
        edge = np.empty(len(text) + 2, np.int8)
        edge[0] = edge[-1] = 1
        np.take(self.sep.view(np.int8), text, out=edge[1:-1])
        step = np.flatnonzero(edge[1:] != edge[:-1])
        return step[0::2], step[1::2]

    def pieces(self, text: np.ndarray, chunk: int = CHUNK) -> Iterator[tuple[int, np.ndarray]]:
        """The text cut at separators into pieces of about ``chunk`` bytes; a longer word stays whole."""
        at, n = 0, len(text)
        while n - at > chunk:
            end, size = at + chunk, 4096
            while True:
                gap = np.flatnonzero(self.sep[text[end : end + size]])
                if len(gap) or end + size >= n:
                    end = end + int(gap[0]) if len(gap) else n
                    break
                end += size
            yield at, text[at:end]
            at = end
        if at < n:
            yield at, text[at:]

    def hashes(self, text: np.ndarray) -> np.ndarray:
        """One hash a word, in order."""
        out = [self._hash(piece)[0] for _, piece in self.pieces(text)]
        return out[0] if len(out) == 1 else np.concatenate(out) if out else np.empty(0, np.uint64)

    def hashes_and_bounds(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        hs, ss, es = [], [], []
        for at, piece in self.pieces(text):
            h, s, e = self._hash(piece)
            hs.append(h)
            ss.append(s + at)
            es.append(e + at)
        if not hs:
            return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
        return (hs[0], ss[0], es[0]) if len(hs) == 1 else (np.concatenate(hs), np.concatenate(ss), np.concatenate(es))

    def _hash(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        start, end = self.bounds(text)
        return self.hashes_at(text, start, end), start, end

    def hashes_at(self, text: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """One hash for each word between these offsets."""
        up, down = powers(len(text) + 1)
        sums = np.empty(len(text) + 1, np.uint64)
        sums[0] = 0
        np.cumsum(self.values[text] * up[: len(text)], out=sums[1:])
        h = (sums[end] - sums[start]) * down[start]
        return mix(h + (end - start).astype(np.uint64))


SPACE = bytes([0x20, *range(0x09, 0x0E)])
#: Words `[^\x20\x09-\x0D]+`, unchanged or with A-Z lowered.
PLAIN, LOWER = Words(SPACE, False), Words(SPACE, True)
#: Words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` of the lowered text.
ALNUM = Words(bytes(b for b in range(128) if not (48 <= b < 58 or 65 <= b < 91 or 97 <= b < 123)), True)


def windows(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` consecutive words."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    up, down = powers(len(words) + 1)
    sums = np.empty(len(words) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(words * up[: len(words)], out=sums[1:])
    return mix((sums[size:] - sums[:-size]) * down[:n] + np.uint64(size))


def sequence(words: np.ndarray) -> tuple[int, int]:
    """128 bits for a whole word sequence, as two signed 64-bit numbers."""
    n = len(words)
    up, _ = powers(n + 1)
    a = int(np.sum(words * up[:n], dtype=np.uint64)) + n
    b = int(np.sum(mix(words + np.uint64(0x5851F42D4C957F2D)) * up[:n], dtype=np.uint64)) ^ n
    both = mix(np.array([a & (1 << 64) - 1, b & (1 << 64) - 1], np.uint64)).view(np.int64)
    return int(both[0]), int(both[1])
