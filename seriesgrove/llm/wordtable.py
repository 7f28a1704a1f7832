"""A bounded table of words and their token ids, in numpy.

Words are looked up by hash, many at once, in a sorted array; the bytes are kept
and compared, so that a clash of hashes cannot change a result. There are two
generations: what is used moves to the younger one, and when that holds half of
what the table may hold, the older one is dropped and takes its place. So common
words stay, whatever is read, and memory has a fixed bound.
"""

from __future__ import annotations

import numpy as np


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places of stretches (start, length), one after another."""
    before = np.cumsum(lengths) - lengths
    return np.arange(int(lengths.sum())) + np.repeat(starts - before, lengths)


class Pool:
    """Stretches of numbers, one after another in an array that grows by doubling."""

    def __init__(self, kind):
        self.data, self.bounds, self.n = np.zeros(1024, kind), np.zeros(1024, np.int64), 0

    def add(self, data: np.ndarray, lengths: np.ndarray) -> None:
        used, m = int(self.bounds[self.n]), len(lengths)
        while used + len(data) > len(self.data):
            self.data = np.append(self.data, np.zeros_like(self.data))
        while self.n + m + 1 > len(self.bounds):
            self.bounds = np.append(self.bounds, np.zeros_like(self.bounds))
        self.data[used : used + len(data)] = data
        self.bounds[self.n + 1 : self.n + m + 1] = used + np.cumsum(lengths)
        self.n += m

    def spans(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and lengths of some stretches."""
        return self.bounds[at], self.bounds[at + 1] - self.bounds[at]

    def take(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Some stretches one after another, and their lengths."""
        starts, lengths = self.spans(at)
        return self.data[ragged(starts, lengths)], lengths


class Generation:
    """Hashes in order, and the bytes and ids of the words."""

    def __init__(self):
        self.hashes, self.order = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.words, self.ids = Pool(np.uint8), Pool(np.uint32)

    @property
    def size(self) -> int:
        """Bytes held, about."""
        return int(self.words.bounds[self.words.n] + 4 * self.ids.bounds[self.ids.n] + 32 * self.words.n)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each hash's word, or -1."""
        if not len(self.hashes):
            return np.full(len(hashes), -1, np.int64)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.order[at], -1)

    def add(self, hashes: np.ndarray, words: np.ndarray, lengths: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        """Adds words of different hashes that are not held yet."""
        order = np.argsort(hashes)
        new = hashes[order]
        at = np.searchsorted(self.hashes, new)
        self.hashes, self.order = np.insert(self.hashes, at, new), np.insert(self.order, at, self.words.n + order)
        self.words.add(words, lengths)
        self.ids.add(ids, counts)


class WordTable:
    """Words and ids, of at most about `limit` bytes besides what one block of text adds."""

    def __init__(self, limit: int):
        self.limit, self.young, self.old = limit, Generation(), Generation()

    def clear(self) -> None:
        self.young, self.old = Generation(), Generation()

    def __len__(self) -> int:
        return self.young.words.n + self.old.words.n

    def turn(self) -> None:
        """Drops the older generation if the younger one is full. Numbers of words are valid from one call to the next."""
        if self.young.size > self.limit // 2:
            self.old, self.young = self.young, Generation()

    def lookup(self, hashes: np.ndarray, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The number of each word (all of different hashes): -1 if it is not held, -2 if another word of its hash is."""
        at = self.young.find(hashes)
        absent = np.flatnonzero(at < 0)
        older = self.old.find(hashes[absent])
        absent, older = absent[older >= 0], older[older >= 0]
        if len(absent):
            n = self.young.words.n
            self.young.add(hashes[absent], *self.old.words.take(older), *self.old.ids.take(older))
            at[absent] = n + np.arange(len(absent))
        held = np.flatnonzero(at >= 0)
        at[held[~self._same(at[held], data, starts[held], lengths[held])]] = -2
        return at

    def _same(self, at: np.ndarray, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Whether the words are those held."""
        own, held = self.young.words.spans(at)
        same = held == lengths
        maybe = np.flatnonzero(same)
        length = lengths[maybe]
        differ = self.young.words.data[ragged(own[maybe], length)] != data[ragged(starts[maybe], length)]
        if differ.any():
            same[maybe[np.repeat(np.arange(len(maybe)), length)[differ]]] = False
        return same

    def add(self, hashes: np.ndarray, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        self.young.add(hashes, data[ragged(starts, lengths)], lengths, ids, counts)
