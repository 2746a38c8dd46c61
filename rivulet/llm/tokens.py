"""Words of many texts at once, on the raw bytes of an Arrow column: spans, 64-bit word hashes, hashes of word windows.

All arithmetic is modulo 2**64. A hash of a run of values v[0..k) is the sum of mix(v[j]) * Q**j; prefix sums and the
inverse of the odd number Q give it for every window in a few passes. Equal runs always have equal hashes; unequal runs
may collide, so callers verify.
"""

from __future__ import annotations

import numpy as np

#: Fixed odd multipliers and seeds of two independent hash families.
_Q = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_SEED = (0x0123456789ABCDEF, 0x5851F42D4C957F2D)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}

#: The first bytes of eight, by their number; words of more bytes than ``_CHUNKED`` are hashed by bytes in any case.
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_CHUNKED = 64

#: Bytes of words: everything but blanks and the control characters 9 to 13.
PLAIN = np.ones(256, bool)
PLAIN[[32, 9, 10, 11, 12, 13]] = False
#: Bytes of normalised words after lower-casing: digits, a-z and every byte of a non-ASCII character.
NORMAL = np.zeros(256, bool)
NORMAL[48:58] = NORMAL[97:123] = NORMAL[128:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE_VALUES = tuple(mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(q) + np.uint64(s)) for q, s in zip(_Q, _SEED, strict=True))


def _powers(family: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(Q**i, Q**-i) for i up to n at least."""
    if family not in _POWERS or len(_POWERS[family][0]) < n:
        size = -(-n // (1 << 18)) << 18
        inverse = pow(_Q[family], -1, 1 << 64)
        both = []
        for base in (_Q[family], inverse):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            both.append(np.cumprod(steps, dtype=np.uint64))
        _POWERS[family] = (both[0], both[1])
    return _POWERS[family]


def _runs(values: np.ndarray, first: np.ndarray, last: np.ndarray, family: int) -> np.ndarray:
    power, inverse = _powers(family, len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * power[: len(values)], out=sums[1:])
    return (sums[last] - sums[first]) * inverse[first]


class Words:
    """The words of a slice of rows: ``start``/``end`` byte offsets, ``row``, and ``first``: the rows' word offsets."""

    def __init__(self, data: np.ndarray, at: np.ndarray, table: np.ndarray, chunked: bool = False):
        """``chunked``: hash words by eight bytes at once (other values than by bytes, and fewer steps)."""
        self.data, self.at, self.chunked, n = data, at, chunked, len(at) - 1
        if len(data) == 0:
            self.start = self.end = np.zeros(0, np.int64)
        else:
            inside = np.zeros(len(data) + 2, bool)
            inside[1:-1] = table[data]
            edges = np.flatnonzero(inside[1:] != inside[:-1])
            cuts = np.unique(at[(at > 0) & (at < len(data))])
            cuts = cuts[inside[cuts] & inside[cuts + 1]]  # rows end and start within a run of words' bytes
            self.start, self.end = (np.sort(np.concatenate([x, cuts]), kind="stable") if len(cuts) else x for x in (edges[::2], edges[1::2]))
        self.first = np.searchsorted(self.start, at[:-1]).astype(np.int64)
        self.first = np.append(self.first, len(self.start))
        self.count = np.diff(self.first)
        self.row = np.repeat(np.arange(n), self.count)
        self._hashes: dict[int, np.ndarray] = {}

    def hashes(self, family: int = 0) -> np.ndarray:
        """A 64-bit hash of every word."""
        if family not in self._hashes:
            found = self._chunks(family) if self.chunked else _runs(_BYTE_VALUES[family][self.data], self.start, self.end, family)
            self._hashes[family] = mix(found + (self.end - self.start).astype(np.uint64) * np.uint64(_SEED[family] | 1))
        return self._hashes[family]

    def _chunks(self, family: int) -> np.ndarray:
        length, times, seed = self.end - self.start, np.uint64(_Q[family]), np.uint64(_SEED[family])
        wide = np.ndarray((len(self.data) + 1,), np.dtype("<u8"), np.append(self.data, np.zeros(8, np.uint8)), 0, (1,))
        found = mix((wide[self.start] & _KEEP[np.minimum(length, 8)]) * times + seed)
        some, at = np.flatnonzero((length > 8) & (length <= _CHUNKED)), 8
        while len(some):
            left = length[some] - at
            found[some] = mix(found[some] * times + (wide[self.start[some] + at] & _KEEP[np.minimum(left, 8)]))
            some, at = some[left > 8], at + 8
        if len(rest := np.flatnonzero(length > _CHUNKED)):
            found[rest] = _runs(_BYTE_VALUES[family][self.data], self.start[rest], self.end[rest], family)
        return found

    def windows(self, k: int) -> np.ndarray:
        """The first words of all windows of k words within one row."""
        n = len(self.start)
        if n < k:
            return np.zeros(0, np.int64)
        return np.flatnonzero(self.row[: n - k + 1] == self.row[k - 1 :])


def window_hashes(word_hashes: np.ndarray, starts: np.ndarray, k: int, family: int = 0) -> np.ndarray:
    """A 64-bit hash of the k words from every start."""
    return mix(_runs(mix(word_hashes), starts, starts + k, family))


def run_hashes(word_hashes: np.ndarray, first: np.ndarray, last: np.ndarray, family: int = 0) -> np.ndarray:
    """A 64-bit hash of the words of every run [first, last)."""
    return mix(_runs(mix(word_hashes), first, last, family))


def covered(n: int, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Which of n positions lie in any interval [first, last)."""
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, first, 1)
    np.add.at(edges, last, -1)
    return np.cumsum(edges[:-1]) > 0
