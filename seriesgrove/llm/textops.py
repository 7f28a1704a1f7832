"""Words, word hashes and blocks of text over Arrow buffers, in numpy.

Words are the runs of `[^\\x20\\x09-\\x0D]+`. These separators are single bytes
in UTF-8, so words are found on the raw bytes without decoding. A word's hash
is a polynomial over its bytes modulo 2**64, taken from prefix sums and mixed;
it depends on nothing but the bytes, so every task of every run agrees.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; a longer text is handled alone.
BLOCK_BYTES = 1 << 20
#: Bytes whose hash terms are held at once; a longer word is handled alone.
TERM_BYTES = 1 << 20

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_P = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2**64
_P_INV = pow(_P, -1, 1 << 64)
_Q = np.uint64(0xD6E8FEB86659FD93)
_powers: tuple[np.ndarray, np.ndarray] | None = None


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P**i and P**-i modulo 2**64 for i below n."""
    global _powers
    if _powers is None or len(_powers[0]) < n:
        m = max(n, TERM_BYTES)
        out = []
        for p in (_P, _P_INV):
            x = np.full(m, p, np.uint64)
            x[0] = 1
            out.append(np.cumprod(x))
        if n > TERM_BYTES:
            return out[0], out[1]  # not kept: only a word this long needs it
        _powers = (out[0], out[1])
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Block:
    """Some consecutive texts: their bytes, and the first byte of each."""

    def __init__(self, first: int, data: np.ndarray, bounds: np.ndarray):
        self.first, self.data, self.bounds = first, data, bounds

    def __len__(self) -> int:
        return len(self.bounds) - 1

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Byte starts and ends of all words, and the first word of each text (one more at the end)."""
        space = IS_SPACE[self.data]
        before = np.ones(len(space), bool)
        before[1:] = space[:-1]
        after = np.ones(len(space), bool)
        after[:-1] = space[1:]
        inner = self.bounds[:-1][self.bounds[:-1] < self.bounds[1:]]
        before[inner] = True
        after[inner[1:] - 1] = True
        word = ~space
        starts, ends = np.flatnonzero(word & before), np.flatnonzero(word & after) + 1
        return starts, ends, np.searchsorted(starts, self.bounds)


def blocks(texts: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """Cuts a string array into blocks of at most limit bytes, or of one text; a null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    if not len(texts):
        return
    wide = pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i, n = 0, len(texts)
    while i < n:
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + limit, "right")) - 1)
        j = min(j, n)
        yield Block(i, data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i])
        i = j


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each word."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        lo = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, lo + TERM_BYTES, "right")))
        hi = int(ends[j - 1])
        up, down = powers(hi - lo)
        part = data[lo:hi]
        terms = (LOWER[part] if lower else part).astype(np.uint64)
        terms += np.uint64(1)
        terms *= up[: hi - lo]
        sums = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(terms, out=sums[1:])
        s, e = starts[i:j] - lo, ends[i:j] - lo
        out[i:j] = mix((sums[e] - sums[s]) * down[s] ^ (e - s).astype(np.uint64))
        i = j
    return out


def windows(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n consecutive word hashes; empty if there are fewer than n."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:m].copy()
    for k in range(1, n):
        out *= _Q
        out += hashes[k : k + m]
    return mix(out)


def whole(hashes: np.ndarray) -> np.ndarray:
    """One hash of a whole sequence of word hashes, its length included."""
    h = len(hashes)
    for x in hashes.tolist():
        h = (h * int(_Q) + x) & 0xFFFFFFFFFFFFFFFF
    return mix(np.array([h], np.uint64))


def shingles(hashes: np.ndarray, n: int = 5) -> np.ndarray:
    """The sorted distinct n-word shingles; of a shorter text the whole sequence; of none nothing."""
    if not len(hashes):
        return np.zeros(0, np.uint64)
    return np.unique(windows(hashes, n)) if len(hashes) >= n else whole(hashes)


def fresh(names: list[str], stem: str) -> str:
    """A column name that is not taken, whatever the letter case."""
    taken = {x.lower() for x in names}
    while stem.lower() in taken:
        stem += "_"
    return stem


def small_batches(spark, rows: int = 2000) -> None:
    """Lets Spark hand Python at most so many rows at once, unless the session says something else than Spark's default.

    Queries call this, operators do not: texts can be long, and two workers share an executor's memory with the JVM.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(rows))


def give_back() -> None:
    """Returns memory that is no longer used to the system: workers are kept and used for other stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not this C library
        pass


def tidy(stage: Callable) -> Callable:
    """A generator that gives memory back at its end."""

    @wraps(stage)
    def run(*a, **b):
        try:
            yield from stage(*a, **b)
        finally:
            give_back()

    return run
