"""Vectorised hashing of bytes, words and word windows."""

from __future__ import annotations

import numpy as np

_RNG = np.random.Generator(np.random.PCG64(20240229))
#: Random odd 64-bit coefficients by byte value and by place in a word (low and high 16 bits).
BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
PLACE = _RNG.integers(1, 2**63, 1 << 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
WINDOW = _RNG.integers(1, 2**63, (2, 64), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
BYTE_OF_WORD = np.where(SPACE, np.uint64(0), BYTE)
#: The same for a second, independent hash.
BYTE_2 = np.where(SPACE, np.uint64(0), _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1))
PLACE_2 = _RNG.integers(1, 2**63, 1 << 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
FAR = _RNG.integers(1, 2**63, (2, 1 << 15), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads all bits (in place on a fresh array)."""
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    return h


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of documents laid end to end.

    hash: of each word; hash2: with ``twice``, a second one that shares no
    coefficient with it; start, end: byte bounds; first: index of the first
    word of each document, with a last entry for the end.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, twice: bool = False):
        n = len(data)
        if not n:
            self.hash = self.hash2 = np.zeros(0, np.uint64)
            self.start = self.end = np.zeros(0, np.int64)
            self.first = np.zeros(len(offsets), np.int64)
            return
        word = ~SPACE[data]
        head = np.zeros(n + 1, bool)
        head[offsets] = True  # a document's start, and the position after the last
        begin = word.copy()
        begin[1:] &= ~word[:-1] | head[1:n]
        last = word
        last[:-1] &= ~last[1:] | head[1:n]
        self.start = np.flatnonzero(begin)
        self.end = np.flatnonzero(last) + 1
        self.first = np.searchsorted(self.start, offsets)
        if not len(self.start):
            self.hash = self.hash2 = np.zeros(0, np.uint64)
            return
        place = np.arange(n, dtype=np.int32)
        base = np.zeros(n, np.int32)
        base[self.start[1:]] = np.diff(self.start)
        base[self.start[0]] = self.start[0]
        place -= np.cumsum(base, dtype=np.int32)
        self.hash = self._hashed(data, place, BYTE_OF_WORD, PLACE, FAR[0])
        self.hash2 = self._hashed(data, place, BYTE_2, PLACE_2, FAR[1]) if twice else None

    def _hashed(self, data: np.ndarray, place: np.ndarray, of_byte: np.ndarray, near: np.ndarray, far: np.ndarray) -> np.ndarray:
        v = of_byte[data]
        v *= near[place & np.int32(len(near) - 1)]
        if (self.end - self.start).max() > len(near):
            v *= far[place >> 16]  # no place has the coefficient of another
        return mix(np.add.reduceat(v, self.start) + (self.end - self.start).astype(np.uint64))

    def windows(self, size: int) -> np.ndarray:
        """For each word, if ``size`` words of its document start there."""
        n = len(self.hash)
        ok = np.zeros(n, bool)
        stop = np.repeat(self.first[1:], np.diff(self.first))
        ok[:] = np.arange(n) + size <= stop
        return ok


def window_hashes(words: np.ndarray, at: np.ndarray, size: int, which: int = 0) -> np.ndarray:
    """Hash of the ``size`` words that start at each of these places."""
    h = np.zeros(len(at), np.uint64)
    for k in range(size):
        h += words[at + k] * WINDOW[which, k % 64] * np.uint64(2 * (k // 64) + 1)
    return mix(h + np.uint64(size))


def covered(n: int, starts: np.ndarray, size: int) -> np.ndarray:
    """Which of ``n`` places lie in a window of ``size`` at one of ``starts`` (ascending)."""
    out = np.zeros(n, bool)
    if len(starts):
        cut = np.flatnonzero(np.diff(starts) > size) + 1
        first = starts[np.concatenate([[0], cut])]
        last = starts[np.concatenate([cut - 1, [len(starts) - 1]])] + size
        for a, b in zip(first.tolist(), last.tolist(), strict=True):
            out[a:b] = True
    return out


def counted(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How many flags are set between each bound and the next."""
    out = np.zeros(len(bounds) - 1, np.int64)
    some = np.flatnonzero(bounds[1:] > bounds[:-1])
    if len(some):
        out[some] = np.add.reduceat(flags.view(np.uint8), bounds[some], dtype=np.int64)
    return out
