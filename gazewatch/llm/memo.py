"""Results by piece of text, for all pieces of a batch at once and bounded in memory."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from gazewatch.llm.hashing import Prefixes, mixed


def white_space(data: np.ndarray) -> np.ndarray:
    """Which bytes of UTF-8 text belong to white space as Unicode has it."""
    white = ((data >= 9) & (data <= 13)) | (data == 32)
    for lead in (0xC2, 0xE1, 0xE2, 0xE3):
        at = np.flatnonzero(data == lead)
        if not len(at):
            continue
        second, third = data[np.minimum(at + 1, len(data) - 1)], data[np.minimum(at + 2, len(data) - 1)]
        if lead == 0xC2:
            at = at[(second == 0x85) | (second == 0xA0)]
        elif lead == 0xE1:
            at = at[(second == 0x9A) & (third == 0x80)]
        elif lead == 0xE2:
            spaces = (third <= 0x8A) | (third == 0xA8) | (third == 0xA9) | (third == 0xAF)
            at = at[(second == 0x80) & spaces | (second == 0x81) & (third == 0x9F)]
        else:
            at = at[(second == 0x80) & (third == 0x80)]
        for i in range(2 if lead == 0xC2 else 3):
            white[at + i] = True
    return white


class Grown:
    """An array that grows by doubling."""

    def __init__(self, dtype):
        self.held, self.n = np.zeros(1024, dtype=dtype), 0

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, at):
        return self.held[at]

    def extend(self, values: np.ndarray) -> None:
        end = self.n + len(values)
        if end > len(self.held):
            grown = np.zeros(max(end, 2 * len(self.held)), dtype=self.held.dtype)
            grown[: self.n] = self.held[: self.n]
            self.held = grown
        self.held[self.n : end] = values
        self.n = end


#: What keeps the first so many of eight bytes.
_HEADS = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)


class PieceMemo:
    """Maps pieces (runs of bytes) to sequences of numbers, computing each piece once.

    `compute` gives the numbers of all pieces, one after the other, and how many each has;
    a piece has no more of them than bytes. An open hash table in arrays; pieces are known by
    64 bits of hash and as many of check. Beyond `bound` pieces, or pieces of `most_bytes` in
    all, it starts anew, so its memory does not grow with the input, nor with the length of
    pieces.
    """

    BITS = 20

    def __init__(
        self,
        compute: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]],
        bound: int = 500_000,
        most_bytes: int = 16 << 20,
    ):
        self.compute, self.bound, self.most_bytes = compute, min(bound, 1 << (self.BITS - 1)), most_bytes
        self._clear()

    def _clear(self) -> None:
        self.keys = np.zeros(1 << self.BITS, dtype=np.uint64)
        self.slots = np.zeros(1 << self.BITS, dtype=np.int32)
        self.checks = Grown(np.uint64)
        self.begins, self.sizes = Grown(np.int64), Grown(np.int64)
        self.flat, self.held_bytes = Grown(np.uint32), 0

    def _full(self, pieces: int, n_bytes: int) -> bool:
        return len(self.checks) + pieces > self.bound or self.held_bytes + n_bytes > self.most_bytes

    def _find(self, keys: np.ndarray) -> np.ndarray:
        found, mask = np.full(len(keys), -1, dtype=np.int64), (1 << self.BITS) - 1
        at, todo = (keys >> np.uint64(64 - self.BITS)).astype(np.int64), np.arange(len(keys))
        while len(todo):
            held = self.keys[at]
            hit = held == keys[todo]
            found[todo[hit]] = self.slots[at[hit]]
            on = ~hit & (held != 0)
            at, todo = (at[on] + 1) & mask, todo[on]
        return found

    def _put(self, keys: np.ndarray, entries: np.ndarray) -> None:
        mask = (1 << self.BITS) - 1
        at, todo = (keys >> np.uint64(64 - self.BITS)).astype(np.int64), np.arange(len(keys))
        while len(todo):
            free = self.keys[at] == 0
            self.keys[at[free]] = keys[todo[free]]  # of several for one slot, one stays
            won = free & (self.keys[at] == keys[todo])
            self.slots[at[won]] = entries[todo[won]]
            at, todo = (at[~won] + 1) & mask, todo[~won]

    def take(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of all pieces, one after the other, and each piece's share."""
        keys = Prefixes(data).runs(starts, ends) | np.uint64(1)
        padded = np.concatenate((data, np.zeros(8, dtype=np.uint8)))
        lengths = ends - starts
        # The first eight bytes of each piece as one number, zeros after a shorter piece.
        eights = np.ndarray(len(data), dtype="<u8", buffer=padded, strides=(1,))
        head = eights[starts].astype(np.uint64) & _HEADS[np.minimum(lengths, 8)]
        checks = mixed(head ^ (lengths.astype(np.uint64) << np.uint64(40)))
        found = self._find(keys)
        if (found < 0).any():
            found = self._learn(data, starts, ends, keys, checks, found)
        odd = np.flatnonzero(self.checks[found] != checks)  # equal hashes, other pieces
        if len(odd):
            self._append(checks[odd], *self.compute([data[starts[i] : ends[i]].tobytes() for i in odd]))
            found[odd] = np.arange(len(self.checks) - len(odd), len(self.checks))
        sizes = self.sizes[found]
        before = np.cumsum(sizes) - sizes
        at = np.repeat(self.begins[found] - before, sizes) + np.arange(sizes.sum())
        return self.flat[at], sizes

    def _learn(self, data, starts, ends, keys, checks, found) -> np.ndarray:
        missing = np.flatnonzero(found < 0)
        new, first = np.unique(keys[missing], return_index=True)
        if self._full(len(new), int((ends - starts)[missing[first]].sum())):
            self._clear()
            new, first = np.unique(keys, return_index=True)
            missing = np.arange(len(keys))
        first = missing[first]
        size = int((ends - starts)[first].sum())
        once = self._full(len(new), size)  # a batch that is too large by itself: used, not kept
        self.held_bytes += size
        whole = data.tobytes()
        pieces = [whole[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
        entries = np.arange(len(self.checks), len(self.checks) + len(new))
        self._append(checks[first], *self.compute(pieces))
        if once:
            found = entries[np.searchsorted(new, keys)]
            return found
        self._put(new, entries)
        return self._find(keys)

    def _append(self, checks: np.ndarray, numbers: np.ndarray, sizes: np.ndarray) -> None:
        self.checks.extend(checks)
        self.begins.extend(len(self.flat) + np.cumsum(sizes) - sizes)
        self.sizes.extend(sizes)
        self.flat.extend(numbers.astype(np.uint32, copy=False))


def laid_out(texts: list[bytes], before: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
    """The texts as one array of bytes, each after `before`, and where each begins and the end."""
    data = np.frombuffer(b"".join([before + t for t in texts]), dtype=np.uint8)
    limits = np.concatenate(([0], np.cumsum([len(before) + len(t) for t in texts], dtype=np.int64)))
    return data, limits.astype(np.int64)


def by_text(numbers: np.ndarray, sizes: np.ndarray, starts: np.ndarray, limits: np.ndarray) -> list[np.ndarray]:
    """The numbers of each text, given where pieces and texts begin."""
    ends = np.concatenate(([0], np.cumsum(sizes)))
    cut = ends[np.searchsorted(starts, limits)]
    return [numbers[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]
