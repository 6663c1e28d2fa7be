"""Hashes of many substrings at once: prefix sums of a polynomial modulo 2**64."""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Random words for the 256 bytes, the same in every process.
_BYTES = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        for k, factor in enumerate((_BASE, _INVERSE)):
            steps = np.full(max(n, 2 * len(_POWERS[k])), factor, dtype=np.uint64)
            steps[0] = 1
            _POWERS[k] = np.multiply.accumulate(steps)
    return _POWERS[0][:n], _POWERS[1][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """Every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


class Prefixes:
    """Hashes of any runs of a sequence of 64-bit words, or of bytes."""

    def __init__(self, items: np.ndarray):
        words = _BYTES[items] if items.dtype == np.uint8 else items
        up, self.down = _powers(len(words) + 1)
        self.sums = np.zeros(len(words) + 1, dtype=np.uint64)
        np.cumsum(words * up[:-1], out=self.sums[1:])

    def every(self, length: int) -> np.ndarray:
        """The hash of each run of `length` items, in order of its start."""
        n = len(self.sums) - length
        if n <= 0:
            return np.zeros(0, dtype=np.uint64)
        return mixed((self.sums[length:] - self.sums[:n]) * self.down[:n])

    def runs(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The hash of each run; runs of different lengths do not meet by leading zeros."""
        raw = (self.sums[ends] - self.sums[starts]) * self.down[starts]
        return mixed(raw + (ends - starts).astype(np.uint64))


def among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are in the sorted array `known`."""
    if not len(known):
        return np.zeros(len(values), dtype=bool)
    at = np.searchsorted(known, values)
    at[at == len(known)] = 0
    return known[at] == values


class Words:
    """The blank-separated words of several texts, as one sequence of hashes."""

    def __init__(self, texts: list[bytes], fold: bool = False):
        data = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
        if fold:
            data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
        blank = (data == 32) | ((data >= 9) & (data <= 13))
        edge = np.flatnonzero(np.diff(np.concatenate(([True], blank)).view(np.int8)))
        starts, ends = edge[::2], edge[1::2]
        self.hashes = Prefixes(data).runs(starts, ends)
        limits = np.cumsum([len(t) + 1 for t in texts]) if texts else np.zeros(0, dtype=np.int64)
        #: Words of text i are hashes[first[i]:first[i + 1]].
        self.first = np.concatenate(([0], np.searchsorted(starts, limits)))
        self.owner = np.repeat(np.arange(len(texts)), np.diff(self.first))
        self.place = np.arange(len(starts)) - self.first[self.owner]

    def fits(self, length: int) -> np.ndarray:
        """Which windows of `length` words, by start, lie in one text."""
        n = max(0, len(self.hashes) - length + 1)
        return self.owner[:n] == self.owner[length - 1 :][:n]
