"""Operator 5, substring dedup by collinear chaining.

1. Seeds: all k-mers of words, so any k equal words in two texts are a seed.
2. Join: a seed found in several texts links each of its places with the text of
   the least id that has it, and with the text before it in order of id, which
   may share more: not all pairs, so a passage in n texts gives at most 2n
   links. The i-th place of a seed in a text is linked with its i-th place in
   the other one, counted from the first again beyond the last, so that texts
   that repeat themselves meet in long chains. Seeds and links are dealt to
   buckets as packed columns, since there are nearly as many seeds as words; a
   seed is 48 bits of a hash, and the alignment compares the words.
3. Chains: of links that follow each other word by word, one in k and the last
   stand for the run. The linked places of a text and the first text are ordered matches.
   The best chain ending at a match adds its words to the best one that ends
   before it in both texts, less a cost for the words between. A Fenwick tree
   over the places in the first text gives that maximum. A chain is cut where
   more words lie between two matches than an end may move outward.
4. Alignment: the words of both texts around a chain are compared: stretches
   between matches by edit distance, the ends outward until mismatches outweigh.
   What agrees well enough is a fuzzy passage; a chain that does not is taken in
   parts, down to its equal runs. Passages of a text that overlap or touch are
   united; those of `min_words` or more are the result.
5. The other pairs: after that, all words of seeds that an earlier text has are
   in passages. A pair of texts that was not linked at each of its seeds can add
   only words between two seeds. So where words between two passages are not in
   any, and seeds on both sides were not linked with all who have them, all
   earlier texts that have any two such seeds equally near, in that order, are
   found by a join on the two seeds together, and are chained and aligned with
   the text over the whole of both. Pairs of seeds that all the same texts have
   at the same distances are joined as one. Left out are only pairs whose seeds lie so
   much further apart in one text that no chain over them can agree well enough.
   There is no cap on the rest.

Words are the runs of `[^\\x20\\x09-\\x0D]+`, compared exactly; positions count
words. Defined results: a null or empty text, or one shorter than a k-mer, has
no passages. Texts are told apart by id: repeats within one text do not count,
nor do rows that share an id count as copies of each other. Rows without an id
are left out, since their passages could not be named. No rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seriesgrove.llm import textops
from seriesgrove.llm.lineage import cut_clear


@dataclass(frozen=True)
class Settings:
    """k of the seeds, and of how many the least is taken (1: all); gap cost a word, on either side; least words of a passage; least share of equal words; words that an end may move outward."""

    k: int = 8
    window: int = 1
    gap: float = 0.1
    min_words: int = 50
    identity: float = 0.8
    reach: int = 64


# Seeds


def minimizers(hashes: np.ndarray, window: int) -> np.ndarray:
    """Places of the least hash of each `window` places; of equal ones the last. A shorter array has one window."""
    n = len(hashes)
    if not n:
        return np.zeros(0, np.int64)
    w = min(window, n)
    views = np.lib.stride_tricks.sliding_window_view(hashes[::-1], w)
    return np.unique(n - 1 - (views.argmin(axis=1) + np.arange(n - w + 1)))


#: Seeds and links are dealt to so many buckets; one is handled at once.
BUCKETS = 4096
#: The bits of a hash that are a seed.
SEED = np.uint64(0xFFFFFFFFFFFF0000)
#: Rows that a task holds before it deals them out.
HELD = 1 << 21
DEALT = "bucket int, n int, seeds binary, rest binary"


_squeeze, _loosen = zstandard.ZstdCompressor(level=1).compress, zstandard.ZstdDecompressor().decompress


def order(*columns: np.ndarray) -> np.ndarray:
    """The order of rows by the first column, then by the next: one sort of whole numbers where the columns fit in 63 bits together. Equal rows come in any order."""
    if len(columns[0]) < 512:
        return np.lexsort(columns[::-1])
    low, high = [int(c.min()) for c in columns], [int(c.max()) for c in columns]
    if sum((h - v).bit_length() for v, h in zip(low, high, strict=True)) > 63:
        columns = tuple(np.unique(c, return_inverse=True)[1] for c in columns)
        low, high = [0] * len(columns), [int(c.max()) for c in columns]
    bits = [(h - v).bit_length() for v, h in zip(low, high, strict=True)]
    if sum(bits) > 63:
        return np.lexsort(columns[::-1])
    key = np.zeros(len(columns[0]), np.int64)
    for c, v, n in zip(columns, low, bits, strict=True):
        key = (key << n) | (c - c.dtype.type(v)).astype(np.int64)
    return np.argsort(key)


def planes(columns: list[np.ndarray], heads: np.ndarray) -> np.ndarray:
    """Columns of 64-bit integers as differences, begun anew at each head, by planes of bytes, as many as are not all 0."""
    found = []
    for c in columns:
        d = np.empty_like(c)
        np.subtract(c[1:], c[:-1], out=d[1:])
        d[heads] = c[heads]
        found.append(((d << 1) ^ (d >> 63)).view(np.uint64))
    n = max(1, *((int(d.max(initial=0)).bit_length() + 7) // 8 for d in found))
    return np.stack([d.view(np.uint8).reshape(-1, 8)[:, :n].T for d in found])


def pieces(found: np.ndarray, spans: list[tuple[int, int]]) -> list[bytes]:
    """Ranges of rows of planes(), each from a head to the next, compressed after a byte that tells how many planes there are."""
    lead = bytes([found.shape[1]])
    return [lead + _squeeze(found[:, :, a:z].tobytes()) for a, z in spans]


def spread(data: bytes, n: int) -> np.ndarray:
    """The planes of one of pieces(), of n rows."""
    return np.frombuffer(_loosen(data[1:]), np.uint8).reshape(-1, data[0], n)


def joined(found: list[np.ndarray]) -> np.ndarray:
    """The columns that planes() was given, piece after piece, as rows of an array."""
    ends = np.cumsum([x.shape[2] for x in found])
    wide = np.zeros((len(found[0]), ends[-1], 8), np.uint8)
    for x, z in zip(found, ends.tolist(), strict=True):
        wide[:, z - x.shape[2] : z, : x.shape[1]] = x.transpose(0, 2, 1)
    d = wide.view(np.int64)[..., 0]
    d = (d >> 1 & 0x7FFFFFFFFFFFFFFF) ^ -(d & 1)
    out = np.cumsum(d, axis=1)
    if len(found) > 1:
        heads = np.append(0, ends[:-1])
        out -= np.repeat(out[:, heads] - d[:, heads], ends - heads, axis=1)
    return out


def deal(bucket: np.ndarray, columns: list[np.ndarray], seeds: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """Rows of DEALT: the columns by bucket, in their order. Seeds are without their first byte, which the bucket tells, and by planes of bytes, without the last two where no seed has them."""
    by = np.argsort(bucket.astype(np.uint16), kind="stable")  # 16 bits are sorted by counting
    bucket = bucket[by]
    cuts = np.append(0, np.append(np.flatnonzero(np.diff(bucket)) + 1, len(bucket)))
    if seeds is not None:
        low = 0 if (seeds & np.uint64(0xFFFF)).any() else 2
        raw = np.ascontiguousarray(seeds[by].view(np.uint8).reshape(-1, 8)[:, low:7].T)
    found = planes([c[by] for c in columns], cuts[:-1])
    bucket, cuts = bucket[cuts[:-1]], cuts.tolist()
    for i in range(0, len(cuts) - 1, 512):
        spans = list(zip(cuts[i : i + 512], cuts[i + 1 : i + 513], strict=False))
        own = [b"" if seeds is None else _squeeze(raw[:, a:z].tobytes()) for a, z in spans]
        yield pa.RecordBatch.from_arrays([pa.array(bucket[i : i + 512], pa.int32()), pa.array([z - a for a, z in spans], pa.int32()), pa.array(own, pa.binary()), pa.array(pieces(found, spans), pa.binary())], names=["bucket", "n", "seeds", "rest"])


def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray | None, np.ndarray]]:
    """Rows of DEALT in order of bucket: seeds, if any, and columns of each bucket."""
    at, seeds, rest = None, [], []

    def out() -> tuple[np.ndarray | None, np.ndarray]:
        columns = joined(rest)
        if not seeds:
            return None, columns
        wide, z = np.zeros((columns.shape[1], 8), np.uint8), 0
        for x in seeds:
            a, z = z, z + x.shape[1]
            wide[a:z, 7 - len(x) : 7] = x.T
        wide[:, 7] = at >> 4
        return wide.view(np.uint64)[:, 0], columns

    for batch in batches:
        for bucket, n, own, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if bucket != at and rest:
                yield out()
                seeds, rest = [], []
            at = bucket
            if own:
                seeds.append(np.frombuffer(_loosen(own), np.uint8).reshape(-1, n))
            rest.append(spread(data, n))
    if rest:
        yield out()


@textops.tidy
def _seeds(batches: Iterator[pa.RecordBatch], s: Settings) -> Iterator[pa.RecordBatch]:
    held, size = [], 0

    def out() -> Iterator[pa.RecordBatch]:
        seeds, docs, at = (np.concatenate(x) for x in zip(*held, strict=True))
        return deal((seeds >> np.uint64(52)).astype(np.int32), [docs, at], seeds)

    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        for b in textops.blocks(batch.column(1)):
            starts, ends, first = b.words()
            mers = textops.windows(textops.hash_words(b.data, starts, ends), s.k) & SEED
            counts = np.maximum(0, np.diff(first) - s.k + 1)
            at = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            docs = np.repeat(ids[b.first : b.first + len(b)], counts)
            seeds = mers[np.repeat(first[:-1], counts) + at]
            if s.window > 1:
                ends = np.cumsum(counts)
                keep = np.concatenate([lo + minimizers(seeds[lo:hi], s.window) for lo, hi in zip(ends - counts, ends, strict=True)])
                seeds, docs, at = seeds[keep], docs[keep], at[keep]
            held.append((seeds, docs, at))
            size += len(seeds)
            if size >= HELD:
                yield from out()
                held, size = [], 0
    if size:
        yield from out()


def linked(seeds: np.ndarray, docs: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The links, and columns doc, seed (32 bits of it), at, rank of all places of seeds that several texts have; rank is -1 for the text of the least id, then -2 and so on, not below -4."""
    by = np.argsort(seeds)
    s = seeds[by]
    same = s[1:] == s[:-1]
    by = by[np.append(False, same) | np.append(same, False)]
    seeds, docs, at = seeds[by], docs[by], at[by]
    by = order(np.cumsum(np.append(0, seeds[1:] != seeds[:-1])[: len(seeds)]), docs, at)
    seeds, docs, at = seeds[by], docs[by], at[by]
    fresh = np.append(True, seeds[1:] != seeds[:-1])[: len(seeds)]
    heads = np.flatnonzero(fresh | np.append(True, docs[1:] != docs[:-1])[: len(seeds)])  # first places of a seed in each text
    times = np.diff(np.append(heads, len(seeds)))
    holder = np.repeat(np.arange(len(heads)), times)
    nth = np.arange(len(seeds)) - heads[holder]
    begun = np.maximum.accumulate(np.where(fresh[heads], np.arange(len(heads)), 0))[holder]
    rows = np.flatnonzero(holder > begun)
    last = np.append(fresh[heads][1:], True)[: len(heads)]  # holders that are the last of their seed
    several = np.flatnonzero((holder > begun) | ~last[holder])
    seen = np.stack([docs[several], (seeds[several] >> np.uint64(16) & np.uint64(0xFFFFFFFF)).view(np.int64), at[several], -1 - np.minimum(holder - begun, 3)[several]])
    first, before = begun[rows], holder[rows] - 1
    more = before != first
    rows, of = np.append(rows, rows[more]), np.append(first, before[more])
    to = heads[of] + nth[rows] % times[of]
    return np.stack([docs[rows], docs[to], at[rows], at[to]]), seen


def links(seeds: np.ndarray, docs: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Columns doc, other, at, other_at: each place of a seed with one in the text of the least id, and one in the text before in order of id."""
    return linked(seeds, docs, at)[0]


@textops.tidy
def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, seen, size = [], [], 0

    def out() -> Iterator[pa.RecordBatch]:
        for parts, keys in ((held, (0, 1, 2)), (seen, (0, 2))):
            m = np.concatenate(parts, axis=1)
            m = m[:, order(*(m[i] for i in keys))]
            yield from deal((textops.mix(m[0].view(np.uint64)) % np.uint64(BUCKETS)).astype(np.int32), list(m))

    for seeds, (docs, at) in dealt(batches):
        own, places = linked(seeds, docs, at)
        held.append(own)
        seen.append(places)
        size += own.shape[1] + places.shape[1]
        if size >= HELD:
            yield from out()
            held, seen, size = [], [], 0
    if size:
        yield from out()


# Chains


def chain(a: np.ndarray, b: np.ndarray, k: int, gap: float) -> list[np.ndarray]:
    """Chains of the matches (a[i], b[i]), which are in order of a, then b: arrays of match numbers, the best chain first.

    f(i) = k + max(0, max of f(j) - gap * (a_i - a_j + b_i - b_j) over a_j < a_i and b_j < b_i); the tree holds
    f(j) + gap * (a_j + b_j).
    """
    n = len(a)
    ranks = np.unique(b, return_inverse=True)[1].tolist()
    size = max(ranks) + 1
    best, who = [float("-inf")] * (size + 1), [-1] * (size + 1)  # the Fenwick tree: greatest value of a prefix
    al, bl = a.tolist(), b.tolist()
    f, before = [0.0] * n, [-1] * n
    i = 0
    while i < n:
        j = i
        while j < n and al[j] == al[i]:  # matches at one place cannot follow each other
            r, value, at = ranks[j], gap * (al[j] + bl[j]), -1  # below that value a new chain is better
            while r:
                if best[r] > value:
                    value, at = best[r], who[r]
                r &= r - 1
            f[j], before[j] = k + max(0.0, value - gap * (al[j] + bl[j])), at
            j += 1
        for m in range(i, j):
            r, value = ranks[m] + 1, f[m] + gap * (al[m] + bl[m])
            while r <= size:
                if value > best[r]:
                    best[r], who[r] = value, m
                r += r & -r
        i = j
    used, out = [False] * n, []
    for end in sorted(range(n), key=lambda i: (-f[i], i)):
        path, at = [], end
        while at >= 0 and not used[at]:
            used[at] = True
            path.append(at)
            at = before[at]
        if path:
            out.append(np.array(path[::-1]))
    return out


def apart(rows: np.ndarray, most: int) -> list[np.ndarray]:
    """A chain cut where its matches lie more than `most` words apart in either text."""
    wide = (rows[1:, 2:] - rows[:-1, 2:] > most).any(axis=1)
    return np.split(rows, np.flatnonzero(wide) + 1) if wide.any() else [rows]


def thinned(m: np.ndarray, k: int) -> np.ndarray:
    """Rows (doc, other, a, b) in order: of a run of matches that follow each other word by word, one in k and the last."""
    by = order(m[:, 0], m[:, 1], m[:, 2] - m[:, 3], m[:, 2])
    s = m[by]
    new = np.append(True, (np.diff(s, axis=0) != (0, 0, 1, 1)).any(axis=1))
    heads = np.flatnonzero(new)
    place = np.arange(len(s)) - np.repeat(heads, np.diff(np.append(heads, len(s))))
    return m[np.sort(by[(place % k == 0) | np.append(new[1:], True)])]


def chained(a: np.ndarray, b: np.ndarray, k: int, gap: float) -> list[np.ndarray]:
    """chain(); where each match may follow the one before at less cost than it adds, all are one chain."""
    da, db = np.diff(a), np.diff(b)
    if (da > 0).all() and (db > 0).all() and (gap * (da + db) < k).all():
        return [np.arange(len(a))]
    return chain(a, b, k, gap)


def paths(own: np.ndarray, s: Settings) -> list[np.ndarray]:
    """The chains (a, b) of the links of one pair of texts, which are thinned and in order."""
    return [x[:, 2:] for path in chained(own[:, 2], own[:, 3], s.k, s.gap) for x in apart(own[path], s.reach + s.k)]


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The whole numbers from each start, so many as its size says."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def all_paths(m: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of links (doc, other, a, b) that are thinned and in order: doc, other and number of matches of each chain, in order of doc, and the matches. As paths() pair by pair; pairs of which each match may follow the one before are done together."""
    steps = np.diff(m, axis=0)
    fresh = np.append(True, (steps[:, :2] != 0).any(axis=1))
    a, b = steps[:, 2], steps[:, 3]
    pair = np.cumsum(fresh) - 1
    hard = np.zeros(pair[-1] + 1, bool)
    hard[pair[1:][~fresh[1:] & ~((a > 0) & (b > 0) & (s.gap * (a + b) < s.k))]] = True
    plain = ~hard[pair]
    new = fresh | np.append(True, (a > s.reach + s.k) | (b > s.reach + s.k))
    rest = m[~plain]
    cuts = np.append(np.flatnonzero(np.diff(pair[~plain])) + 1, len(rest)).tolist() if len(rest) else []
    more = [(own[0, 0], own[0, 1], part) for lo, hi in zip([0, *cuts], cuts, strict=False) for own in [rest[lo:hi]] for part in paths(own, s)]
    heads = np.flatnonzero(new[plain])
    easy = m[plain]
    sizes = np.append(np.diff(np.append(heads, len(easy)))[: len(heads)], [len(p) for *_, p in more]).astype(np.int64)
    docs = np.append(easy[heads, 0], np.array([d for d, *_ in more], np.int64))
    others = np.append(easy[heads, 1], np.array([o for _, o, _ in more], np.int64))
    matches = np.concatenate([easy[:, 2:], *(p for *_, p in more)])
    by = np.argsort(docs, kind="stable")
    return docs[by], others[by], sizes[by], matches[ranges((np.cumsum(sizes) - sizes)[by], sizes[by])]


CHAINS = "doc bigint, chains array<struct<other:bigint,matches:array<struct<a:int,b:int>>>>, open boolean, n int, seen binary"


@textops.tidy
def _chains(batches: Iterator[pa.RecordBatch], s: Settings) -> Iterator[pa.RecordBatch]:
    """Links and places by the bucket of doc: a row for each text, with its chains, whether it was not linked with all who have its seeds, and its places (at, seed, rank)."""
    pair = pa.struct([("a", pa.int32()), ("b", pa.int32())])
    for _, columns in dealt(batches):
        m, seen = columns[:, columns[3] >= 0], columns[:, columns[3] < 0]
        owners, others, sizes, flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, 2), np.int64)
        if m.shape[1]:
            m = m[:, order(*m)].T
            m = thinned(m[np.append(True, (m[1:] != m[:-1]).any(axis=1))], s.k)  # rows may repeat
            owners, others, sizes, flat = all_paths(m, s)
        seen = seen[:, order(seen[0], seen[2])]
        heads = np.flatnonzero(np.append(True, seen[0, 1:] != seen[0, :-1])[: seen.shape[1]])
        docs, tails = seen[0, heads], np.append(heads[1:], seen.shape[1])
        values = pa.StructArray.from_arrays([pa.array(flat[:, 0].astype(np.int32)), pa.array(flat[:, 1].astype(np.int32))], fields=list(pair))
        matches = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), values)
        rows = pa.StructArray.from_arrays([pa.array(others, pa.int64()), matches], ["other", "matches"])
        lists = pa.ListArray.from_arrays(pa.array(np.append(np.searchsorted(owners, docs), len(owners)).astype(np.int32)), rows)
        places = pieces(planes([seen[2], seen[1], seen[3]], heads), list(zip(heads.tolist(), tails.tolist(), strict=True)))
        wanted = pa.array(np.minimum.reduceat(seen[3], heads) == -4)
        yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), lists, wanted, pa.array(tails - heads, pa.int32()), pa.array(places, pa.binary())], names=["doc", "chains", "open", "n", "seen"])


# Alignment


def outward(x: np.ndarray, y: np.ndarray) -> int:
    """How far two arrays of equal length agree from their beginning, a mismatch costing twice what a match gains, up to a fall of 8."""
    if not (x[:5] == y[:5]).any():
        return 0  # five mismatches are too far a fall
    score = np.cumsum(np.where(x == y, 1, -2))
    top = np.maximum.accumulate(np.maximum(score, 0))
    stop = np.flatnonzero(top - score > 8)
    score = score[: stop[0]] if len(stop) else score
    return int(np.argmax(score)) + 1 if len(score) and score.max() > 0 else 0


def equal_words(x: np.ndarray, y: np.ndarray) -> int:
    """The length of a longest common subsequence, as edit distance without replacement gives it.

    A row of the table of lengths is a number with a bit for each word of y: 0 where the length grows (Hyyro, 2004).
    """
    if len(x) == len(y) and np.array_equal(x, y):
        return len(x)
    at: dict[int, int] = {}
    for i, v in enumerate(y.tolist()):
        at[v] = at.get(v, 0) | 1 << i
    full = (1 << len(y)) - 1
    row = full
    for v in x.tolist():
        if v in at:
            hit = row & at[v]
            row = (row + hit | row - hit) & full
    return len(y) - row.bit_count()


def inner(x: np.ndarray, y: np.ndarray, matches: np.ndarray, x0: int, y0: int, s: Settings) -> tuple[int, int, int, int, int]:
    """Range in the text, range in the first text, and equal words, from the first match to the last, for slices that begin at words x0 and y0.

    Matches whose words differ, for all their hashes, are left out; without any other the range is empty.
    """
    a, b = matches[:, 0] - x0, matches[:, 1] - y0
    true = (x[a[:, None] + np.arange(s.k)] == y[b[:, None] + np.arange(s.k)]).all(axis=1)
    a, b = a[true], b[true]
    if not len(a):
        return x0, x0, y0, y0, 0
    lo_a, lo_b, hi_a, hi_b, same = int(a[0]), int(b[0]), int(a[0]) + s.k, int(b[0]) + s.k, s.k
    for i in range(1, len(a)):
        na, nb = int(a[i]), int(b[i])
        if na <= hi_a or nb <= hi_b:
            step = min(na + s.k - hi_a, nb + s.k - hi_b)  # new words of an overlapping match
            same += max(0, step)
        else:
            same += equal_words(x[hi_a:na], y[hi_b:nb]) + s.k
        hi_a, hi_b = na + s.k, nb + s.k
    return x0 + lo_a, x0 + hi_a, y0 + lo_b, y0 + hi_b, same


def extended(x: np.ndarray, y: np.ndarray, found: tuple[int, int, int, int, int], x0: int, y0: int, s: Settings) -> tuple[int, int, int, int, int]:
    """What inner() gives with the ends moved outward."""
    lo_a, hi_a, lo_b, hi_b, same = found[0] - x0, found[1] - x0, found[2] - y0, found[3] - y0, found[4]
    n = min(s.reach, lo_a, lo_b)
    left = outward(x[lo_a - n : lo_a][::-1], y[lo_b - n : lo_b][::-1])
    n = min(s.reach, len(x) - hi_a, len(y) - hi_b)
    right = outward(x[hi_a : hi_a + n], y[hi_b : hi_b + n])
    same += int((x[lo_a - left : lo_a] == y[lo_b - left : lo_b]).sum() + (x[hi_a : hi_a + right] == y[hi_b : hi_b + right]).sum())
    return x0 + lo_a - left, x0 + hi_a + right, y0 + lo_b - left, y0 + hi_b + right, same


def align(x: np.ndarray, y: np.ndarray, matches: np.ndarray, x0: int, y0: int, s: Settings) -> tuple[int, int, int, int, int]:
    """Range in the text, range in the first text, and equal words, ends included; empty without a match whose words are equal."""
    found = inner(x, y, matches, x0, y0, s)
    return extended(x, y, found, x0, y0, s) if found[4] else found


def agreed(x: np.ndarray, y: np.ndarray, matches: np.ndarray, x0: int, y0: int, s: Settings) -> list[tuple[int, int, int, int, int]]:
    """The passage of a chain that agrees from its first to its last match, with its ends if it still does; of one that does not, those of its parts before and after the widest gap."""
    agrees = lambda f: f[4] >= s.identity * max(f[1] - f[0], f[3] - f[2])
    out, todo = [], [matches]
    while todo:
        m = todo.pop()
        found = inner(x, y, m, x0, y0, s)
        if not found[4]:
            continue
        if agrees(found):
            wide = extended(x, y, found, x0, y0, s)
            out.append(wide if agrees(wide) else found)
            continue
        steps = np.diff(m, axis=0)
        at = int((steps.max(axis=1) + np.abs(steps[:, 0] - steps[:, 1])).argmax()) + 1
        todo += [m[:at], m[at:]]
    return out


def packed(text):
    """A text column compressed, which shortens what the joins shuffle; a null counts as empty."""

    @F.arrow_udf("binary")
    def run(texts: pa.Array) -> pa.Array:
        squeeze = zstandard.ZstdCompressor(level=1).compress
        return pa.array([squeeze((t.as_py() or "").encode()) for t in texts], pa.binary())

    return run(F.col(text))


#: Bytes of packed texts whose words are held at once, or one text.
TEXTS = 1 << 21


def words_of(data: list[bytes]) -> list[np.ndarray]:
    """The words of packed texts."""
    out = []
    for b in textops.blocks(pa.array([_loosen(x) for x in data], pa.large_binary()).cast(pa.large_string())):
        starts, ends, first = b.words()
        out += np.split(textops.hash_words(b.data, starts, ends), first[1:-1])
    return out


def portions(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most so much together, or of one row."""
    lo, held = 0, 0
    for i, n in enumerate(sizes):
        if held + n > most and i > lo:
            yield lo, i
            lo, held = i, 0
        held += n
    if lo < len(sizes):
        yield lo, len(sizes)


def unnested(lists: pa.Array) -> tuple[np.ndarray, list[pa.Array]]:
    """Of lists of structs: how many each has, and the fields of all."""
    offsets = lists.offsets.to_numpy()
    return np.diff(offsets), lists.flatten().flatten()


@textops.tidy
def _slices(batches: Iterator[pa.RecordBatch], s: Settings) -> Iterator[pa.RecordBatch]:
    """Rows (doc, chains, text): each chain with the words around it."""
    for batch in batches:
        texts = batch.column(2).to_pylist()
        for lo, hi in portions([len(t) for t in texts], TEXTS):
            own = words_of(texts[lo:hi])
            many, (others, matches) = unnested(batch.column(1)[lo:hi])
            sizes, (a, _) = unnested(matches)
            ends, a = np.cumsum(sizes), a.to_numpy()
            begin, end = np.maximum(0, a[ends - sizes] - s.reach), a[ends - 1] + s.k + s.reach
            of = np.repeat(np.arange(hi - lo), many)
            words = [own[i][x:y].tobytes() for i, x, y in zip(of.tolist(), begin.tolist(), end.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi].take(pa.array(of)), others, matches, pa.array(begin, pa.int32()), pa.array(words, pa.binary())], names=["doc", "other", "matches", "begin", "words"])


def outward_all(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray, n: np.ndarray, step: int, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """outward() of n words of x and of y from each i and j in the direction `step`, and how many of the words are equal."""
    far, same = np.zeros(len(i), np.int64), np.zeros(len(i), np.int64)

    def equal(rows: np.ndarray, most: int) -> np.ndarray:
        places = np.arange(min(most, int(n[rows].max(initial=0))))
        inside = places < n[rows, None]
        at = np.where(inside, places * step, 0)
        return inside & (x[np.where(inside, i[rows, None] + at, 0)] == y[np.where(inside, j[rows, None] + at, 0)])

    if len(x) and len(y):
        rows = np.flatnonzero(equal(np.arange(len(i)), 5).any(axis=1))  # else five mismatches are too far a fall
        if len(rows):
            hit = equal(rows, s.reach)
            score = np.cumsum(np.where(hit, 1, -2), axis=1)
            top = np.maximum.accumulate(np.maximum(score, 0), axis=1)
            gone = np.logical_or.accumulate((top - score > 8) | (np.arange(hit.shape[1]) >= n[rows, None]), axis=1)
            score[gone] = -9
            at = score.argmax(axis=1)
            far[rows] = np.where(score[np.arange(len(rows)), at] > 0, at + 1, 0)
            same[rows] = (hit & (np.arange(hit.shape[1]) < far[rows, None])).sum(axis=1)
    return far, same


def agreed_all(x: np.ndarray, y: np.ndarray, of: np.ndarray, a: np.ndarray, b: np.ndarray, spans: tuple[np.ndarray, ...], s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chains of matches (of, a, b), all in order of the chain `of`, in words x and y of which a chain has from x0 to x1 and from y0 to y1: whether agreed() takes a chain whole, its passage (lo_a, hi_a, lo_b, hi_b in x and y) and equal words."""
    x0, x1, y0, y1 = spans
    k = np.arange(s.k)
    whole = np.ones(len(x0), bool)
    whole[of[(x[a[:, None] + k] != y[b[:, None] + k]).any(axis=1)]] = False
    heads = np.flatnonzero(np.append(True, np.diff(of) > 0))
    tails = np.append(heads[1:], len(of)) - 1
    lo_a, hi_a, lo_b, hi_b = a[heads], a[tails] + s.k, b[heads], b[tails] + s.k
    inside = of[1:] == of[:-1]
    da, db = np.diff(a), np.diff(b)
    gain = np.where(inside, np.maximum(0, np.minimum(da, db)), 0)
    for i in np.flatnonzero(inside & (da > s.k) & (db > s.k)).tolist():
        gain[i] = s.k + equal_words(x[a[i] + s.k : a[i + 1]], y[b[i] + s.k : b[i + 1]])
    same = s.k + np.bincount(of[1:], gain, len(x0)).astype(np.int64)
    agrees = lambda same, n, m: same >= s.identity * np.maximum(n, m)
    whole &= agrees(same, hi_a - lo_a, hi_b - lo_b)
    left, more = outward_all(x, y, lo_a - 1, lo_b - 1, np.minimum(s.reach, np.minimum(lo_a - x0, lo_b - y0)), -1, s)
    right, again = outward_all(x, y, hi_a, hi_b, np.minimum(s.reach, np.minimum(x1 - hi_a, y1 - hi_b)), 1, s)
    wide = agrees(same + more + again, hi_a - lo_a + left + right, hi_b - lo_b + left + right)
    left, right, more = (np.where(wide, v, 0) for v in (left, right, more + again))
    return whole, np.stack([lo_a - left, hi_a + right, lo_b - left, hi_b + right]), same + more


def passages_in(x: np.ndarray, y: np.ndarray, of: np.ndarray, a: np.ndarray, b: np.ndarray, spans: tuple[np.ndarray, ...], s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """The chain, and lo_a, hi_a, lo_b, hi_b, equal words of all passages that agreed() gives for the chains of agreed_all()."""
    whole, places, same = agreed_all(x, y, of, a, b, spans, s)
    chains, found = np.flatnonzero(whole), np.append(places, [same], axis=0)[:, whole]
    cuts, owners, more = np.searchsorted(of, np.arange(len(whole) + 1)).tolist(), [], []
    for i in np.flatnonzero(~whole).tolist():
        x0, x1, y0, y1 = (int(v[i]) for v in spans)
        m = np.stack([a[cuts[i] : cuts[i + 1]] - x0, b[cuts[i] : cuts[i + 1]] - y0], axis=1)
        own = agreed(x[x0:x1], y[y0:y1], m, 0, 0, s)
        more += [(f[0] + x0, f[1] + x0, f[2] + y0, f[3] + y0, f[4]) for f in own]
        owners += [i] * len(own)
    return np.append(chains, np.array(owners, np.int64)), np.append(found, np.array(more, np.int64).reshape(-1, 5).T, axis=1)


@textops.tidy
def _align(batches: Iterator[pa.RecordBatch], s: Settings) -> Iterator[pa.RecordBatch]:
    """Rows (doc, other, matches, begin, words, first text): passages."""
    names = ["doc", "start", "end", "other", "other_start", "other_end", "same"]
    for batch in batches:
        firsts = batch.column(5)
        fresh = np.append(True, pc.not_equal(firsts[1:], firsts[:-1]).to_numpy(zero_copy_only=False))[: len(firsts)]
        for lo, hi in portions((pc.binary_length(batch.column(4)).to_numpy() + np.where(fresh, pc.binary_length(firsts).to_numpy(), 0)).tolist(), 2 * TEXTS):
            part, own = batch.slice(lo, hi - lo), fresh[lo:hi].copy()
            own[0] = True
            texts = words_of([part.column(5)[i].as_py() for i in np.flatnonzero(own).tolist()])
            y, y_at, which = np.concatenate(texts), np.cumsum([0, *map(len, texts)]), np.cumsum(own) - 1
            x = np.frombuffer(b"".join(part.column(4).to_pylist()), np.uint64)
            x_at = np.cumsum(np.append(0, pc.binary_length(part.column(4)).to_numpy() // 8))
            many, (a, b) = unnested(part.column(2))
            of, from_x, from_y = np.repeat(np.arange(hi - lo), many), x_at[:-1] - part.column(3).to_numpy(), y_at[which]
            chains, (start, end, other_start, other_end, same) = passages_in(x, y, of, a.to_numpy() + from_x[of], b.to_numpy() + from_y[of], (x_at[:-1], x_at[1:], from_y, y_at[which + 1]), s)
            from_x, from_y = from_x[chains], from_y[chains]
            docs, others = (c.take(pa.array(chains)) for c in part.columns[:2])
            yield pa.RecordBatch.from_arrays([docs, pa.array(start - from_x), pa.array(end - from_x), others, pa.array(other_start - from_y), pa.array(other_end - from_y), pa.array(same)], names=names)


# The other pairs


#: Bits of the filter of wanted keys; it goes to all tasks, and only saves work.
BITS = 27
#: Kinds of wanted keys: two seeds, a seed before, a seed after.
BOTH, BEFORE, AFTER = 0, 1, 2


def key(kind: int, a: np.ndarray, b: np.ndarray | None = None) -> np.ndarray:
    """A hash of a seed or of two in order."""
    h = textops.mix(a.view(np.uint64) * np.uint64(4) + np.uint64(kind))
    return (h if b is None else textops.mix(h + b.view(np.uint64))).view(np.int64)


def near(at: np.ndarray, i: np.ndarray, j: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of one of i and one of j, rising numbers of places, whose place lies after it by at most `most`."""
    lo, hi = np.searchsorted(at[j], at[i], "right"), np.searchsorted(at[j], at[i] + most, "right")
    n = hi - lo
    return np.repeat(i, n), j[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)]


def room(at: np.ndarray, s: Settings) -> np.ndarray:
    """For each of rising places the words from the first to the last one that a chain can reach from it."""
    new = np.append(True, np.diff(at) > s.reach + s.k)[: len(at)]
    heads = np.flatnonzero(new)
    tails = np.append(heads[1:], len(at)) - 1
    return (at[tails] - at[heads] + s.k)[np.cumsum(new) - 1]


def distinct(*columns: np.ndarray) -> list[np.ndarray]:
    """The different rows of some columns."""
    m = np.stack(columns)
    m = m[:, order(*m)]
    return list(m[:, np.append(True, (m[:, 1:] != m[:, :-1]).any(axis=0))[: m.shape[1]]])


def wanted(at: np.ndarray, seed: np.ndarray, rank: np.ndarray, cover: np.ndarray, s: Settings) -> list[tuple[int, list[np.ndarray]]]:
    """Kinds, and keys, words from seed to seed and room of seeds around words that no passage (rows start, end of `cover`) has, where either seed was not linked with all."""
    had = rank < -1
    at, seed, rank = at[had], seed[had], rank[had]
    size = room(at, s)
    cover = cover[np.argsort(cover[:, 0], kind="stable")]
    reached = np.maximum.accumulate(cover[:, 1])[:-1]
    out = []
    for g in np.flatnonzero((cover[1:, 0] > reached) & (cover[1:, 0] - reached <= s.reach)).tolist():
        lo, hi = int(reached[g]), int(cover[g + 1, 0])
        i, j = near(at, np.flatnonzero((at + s.k <= lo) & (at >= hi - s.reach - s.k)), np.flatnonzero((at >= hi) & (at <= lo + s.reach)), s.reach + s.k)
        some = (rank[i] == -4) | (rank[j] == -4)
        i, j = i[some], j[some]
        if len(i):
            out.append((BOTH, distinct(key(BOTH, seed[i], seed[j]), at[j] - at[i], size[i])))
            for kind, one in ((BEFORE, np.unique(i)), (AFTER, np.unique(j))):
                out.append((kind, distinct(key(kind, seed[one]), 0 * at[one], 0 * at[one])))
    return out


SPOTS = "array<struct<step:bigint,room:bigint>>"


def spots(of: np.ndarray, key: np.ndarray, step: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """The different (of, key), and the SPOTS of each: its steps, each with the greatest room, which allows what a smaller one does."""
    by = order(of, key, step, size)
    of, key, step, size = of[by], key[by], step[by], size[by]
    new = np.append(True, (of[1:] != of[:-1]) | (key[1:] != key[:-1]))[: len(of)]
    last = np.append(new[1:] | (step[1:] != step[:-1]), True)[: len(of)]
    heads = np.flatnonzero(new)
    ends = np.append(0, np.cumsum(last))[np.append(heads, len(of))]
    return of[heads], key[heads], pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.StructArray.from_arrays([pa.array(step[last]), pa.array(size[last])], ["step", "room"]))


@textops.tidy
def _wanted(batches: Iterator[pa.RecordBatch], s: Settings) -> Iterator[pa.RecordBatch]:
    """Rows (doc, n, seen, cover): doc, kind, key, spots; of a text and a key one row."""
    for batch in batches:
        own: dict[int, list[np.ndarray]] = {kind: [np.zeros((4, 0), np.int64)] for kind in (BOTH, BEFORE, AFTER)}
        for i, (n, seen, cover) in enumerate(zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True)):
            for kind, found in wanted(*joined([spread(seen, n)]), np.array([(c["start"], c["end"]) for c in cover], np.int64), s):
                own[kind].append(np.stack([np.full(len(found[0]), i), *found]))
        for kind, rows in own.items():
            of, keys, held = spots(*np.concatenate(rows, axis=1))
            if len(of):
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of)), pa.array(np.full(len(of), kind, np.int32)), pa.array(keys), held], names=["doc", "kind", "key", "spots"])


SLICE = BITS - 5


@textops.tidy
def _bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys by slice: the bits of each slice, packed."""
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        bits = batch.column(0).to_numpy() & ((1 << BITS) - 1)
        for part in np.unique(bits >> SLICE).tolist():
            held.setdefault(part, np.zeros(1 << SLICE, bool))[bits[bits >> SLICE == part] & ((1 << SLICE) - 1)] = True
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([zstandard.ZstdCompressor(level=1).compress(np.packbits(b).tobytes()) for b in held.values()], pa.binary())], names=["part", "bits"])


@textops.tidy
def _carriers(batches: Iterator[pa.RecordBatch], parts: dict[int, bytes], s: Settings) -> Iterator[pa.RecordBatch]:
    """Rows (doc, n, seen): other, and key and SPOTS of any two of its seeds that may be wanted; of a text and a key one row."""
    bits = np.zeros((1 << BITS) // 8, np.uint8)
    for part, data in parts.items():
        size = (1 << SLICE) // 8
        bits[part * size : (part + 1) * size] = np.frombuffer(zstandard.decompress(data), np.uint8)

    def may(keys: np.ndarray) -> np.ndarray:
        at = keys & ((1 << BITS) - 1)
        return bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1 > 0

    for batch in batches:
        sizes = batch.column(1).to_pylist()
        for lo, hi in portions(sizes, HELD >> 2):
            found = [spread(x, n) for x, n in zip(batch.column(2)[lo:hi].to_pylist(), sizes[lo:hi], strict=True)]
            at, seed, _ = joined(found)
            of = np.repeat(np.arange(hi - lo), sizes[lo:hi])
            far = at + of * (int(at.max()) + 2 * (s.reach + s.k))  # places of different texts are never near
            i, j = near(far, np.flatnonzero(may(key(BEFORE, seed))), np.flatnonzero(may(key(AFTER, seed))), s.reach + s.k)
            both = key(BOTH, seed[i], seed[j])
            kept = may(both)
            i, j, both = i[kept], j[kept], both[kept]
            if len(i):
                owners, keys, held = spots(of[i], both, at[j] - at[i], room(far, s)[i])
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi].take(pa.array(owners)), pa.array(keys), held], names=["other", "key", "other_spots"])


def met(mine: np.ndarray, theirs: np.ndarray, known: dict, of: int) -> np.ndarray:
    """Rows (a, b) of links() of the seeds of one text with those of another, which is number `of` of those whose sorted seeds are known."""
    if of not in known:
        by = np.argsort(theirs)
        ranked = theirs[by]
        known[of] = ranked, by, bool((ranked[1:] == ranked[:-1]).any())
    ranked, by, repeated = known[of]
    if not len(ranked):
        return np.zeros((0, 2), np.int64)
    at = np.searchsorted(ranked, mine)
    a = np.flatnonzero(ranked[np.minimum(at, len(ranked) - 1)] == mine)
    if not repeated or not len(a):
        return np.stack([a, by[at[a]]], axis=1)
    b = np.sort(by[np.isin(ranked, mine[a])])
    m = links(np.append(theirs[b], mine[a]), np.append(np.zeros(len(b), np.int64), np.ones(len(a), np.int64)), np.append(b, a)).T[:, 2:]
    return m[np.lexsort((m[:, 1], m[:, 0]))]


@textops.tidy
def _pairs(batches: Iterator[pa.RecordBatch], s: Settings) -> Iterator[pa.RecordBatch]:
    """Rows (doc, other, text, other text): passages of the whole pair."""
    names = ["doc", "start", "end", "other", "other_start", "other_end", "same"]
    for batch in batches:
        texts, firsts = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        for lo, hi in portions([len(t) + len(f) * (i == 0 or f != firsts[i - 1]) for i, (t, f) in enumerate(zip(texts, firsts, strict=True))], 2 * TEXTS):
            number = {t: i for i, t in enumerate(dict.fromkeys(texts[lo:hi] + firsts[lo:hi]))}
            words = words_of(list(number))
            x, begin = np.concatenate(words), np.cumsum([0, *map(len, words)])
            all_seeds = textops.windows(x, s.k) & SEED
            seeds = [all_seeds[a : max(a, z - s.k + 1)] for a, z in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)]
            i, j = (np.array([number[t] for t in own[lo:hi]], np.int64) for own in (texts, firsts))
            known: dict[int, tuple[np.ndarray, np.ndarray, bool]] = {}
            found = [met(seeds[p], seeds[q], known, q) for p, q in zip(i.tolist(), j.tolist(), strict=True)]
            of = np.repeat(np.arange(hi - lo), [len(m) for m in found])
            if not len(of):
                continue
            m = np.concatenate(found)
            owners, _, sizes, m = all_paths(thinned(np.stack([of, np.zeros(len(of), np.int64), m[:, 0], m[:, 1]], axis=1), s.k), s)
            of = np.repeat(np.arange(len(owners)), sizes)
            from_x, from_y = begin[i[owners]], begin[j[owners]]
            chains, (start, end, other_start, other_end, same) = passages_in(x, x, of, m[:, 0] + from_x[of], m[:, 1] + from_y[of], (from_x, begin[i[owners] + 1], from_y, begin[j[owners] + 1]), s)
            from_x, from_y = from_x[chains], from_y[chains]
            docs, others = (c[lo:hi].take(pa.array(owners[chains])) for c in batch.columns[:2])
            yield pa.RecordBatch.from_arrays([docs, pa.array(start - from_x), pa.array(end - from_x), others, pa.array(other_start - from_y), pa.array(other_end - from_y), pa.array(same)], names=names)


PASSAGES = "doc bigint, start bigint, end bigint, other bigint, other_start bigint, other_end bigint, same bigint"


def merged(asked: DataFrame, carriers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both with one key for all keys that the same texts have at the same spots, as those of the seeds of one phrase: (doc, key, spots), (key, other, other_spots).

    Spots are the same if all steps of a key are longer or shorter by one number than those of the other key; in the
    result a step is what it is above the least one that its key has in any text.
    """
    least = F.col("other_spots")[0]["step"]
    moved = lambda name, by: F.transform(name, lambda x: F.struct((x["step"] - by).alias("step"), x["room"].alias("room")))
    wide = carriers.select("key", least.alias("least"), *(F.xxhash64(F.lit(i), "other", moved("other_spots", least)).cast("decimal(20,0)").alias(f"h{i}") for i in (0, 1, 2)))
    sets = wide.groupBy("key").agg(
        F.count("*").alias("n"), F.min("least").alias("base"), F.sum("h0").alias("a"),
        *(F.sum(F.col(f"h{i}")).alias(f"w{i}") for i in (1, 2)), *(F.sum(F.col(f"h{i}") * F.col("least").cast("decimal(10,0)")).alias(f"s{i}") for i in (1, 2)),
    )
    # The sums are weighted by hashes of the texts, so that they tell which text has which step.
    same = ["n", "a", *(f"r{i}" for i in (1, 2))]
    sets = sets.select("key", "base", "n", "a", *((F.col(f"s{i}") - F.col(f"w{i}").cast("decimal(28,0)") * F.col("base").cast("decimal(10,0)")).alias(f"r{i}") for i in (1, 2)))
    kinds = cut_clear(sets.select("key", "base", F.min("key").over(Window.partitionBy(*same)).alias("kind")))
    asked = asked.join(kinds, "key").select("doc", F.col("kind").alias("key"), moved("spots", F.col("base")).alias("spots"))
    asked = asked.groupBy("doc", "key").agg(F.array_distinct(F.flatten(F.collect_list("spots"))).alias("spots"))
    return asked, carriers.join(kinds.where("key = kind").select("key", "base"), "key").select("key", "other", moved("other_spots", F.col("base")).alias("other_spots"))


def other_pairs(chains: DataFrame, found: DataFrame, texts: DataFrame, s: Settings) -> DataFrame | None:
    """Passages of the texts that have two seeds around words that no passage has; None if there are no such words."""
    cover = found.groupBy("doc").agg(F.collect_list(F.struct("start", "end")).alias("cover"))
    keys = cut_clear(chains.where("open").select("doc", "n", "seen").join(cover, "doc").mapInArrow(lambda it: _wanted(it, s), f"doc bigint, kind int, key bigint, spots {SPOTS}"))
    place = F.shiftright(F.col("key").bitwiseAND(F.lit((1 << BITS) - 1)), SLICE)
    parts: dict[int, bytes] = {}
    for r in keys.select("key").distinct().repartition(32, place).mapInArrow(_bits, "part int, bits binary").collect():
        parts[r["part"]] = bytes(r["bits"])
    if not parts:
        return None
    held = found.sparkSession.sparkContext.broadcast(parts)
    asked = keys.where(F.col("kind") == BOTH).select("doc", "key", "spots")
    carriers = chains.select("doc", "n", "seen").mapInArrow(lambda it: _carriers(it, held.value, s), f"other bigint, key bigint, other_spots {SPOTS}")
    carriers = cut_clear(carriers.join(asked.select("key").distinct(), "key", "left_semi"))
    asked, carriers = merged(asked, carriers)
    # An agreeing chain has at most as many equal words as either room, and a step that is longer in one text leaves the
    # difference unequal there.
    fits = lambda x, y: F.abs(x["step"] - y["step"]) <= (1 / s.identity - 1) * F.least(x["room"], y["room"])
    some = F.exists("spots", lambda x: F.exists("other_spots", lambda y: fits(x, y)))
    pairs = asked.join(carriers, "key").where((F.col("other") < F.col("doc")) & some).select("doc", "other").distinct()
    both = pairs.join(texts, "doc").join(texts.select(F.col("doc").alias("other"), F.col("text").alias("first_text")), "other")
    return both.select("doc", "other", "text", "first_text").mapInArrow(lambda it: _pairs(it, s), PASSAGES)


def all_chains(rows: DataFrame, s: Settings) -> DataFrame:
    """CHAINS of the texts (doc, text); what they are made of is not kept."""
    seeds = rows.mapInArrow(lambda it: _seeds(it, s), DEALT)
    matches = seeds.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_links, DEALT)
    return cut_clear(matches.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(lambda it: _chains(it, s), CHAINS))


def first_passages(chains: DataFrame, texts: DataFrame, s: Settings) -> DataFrame:
    """PASSAGES of the chains of CHAINS."""
    sliced = chains.where(F.size("chains") > 0).select("doc", "chains").join(texts, "doc").mapInArrow(lambda it: _slices(it, s), "doc bigint, other bigint, matches array<struct<a:int,b:int>>, begin int, words binary")
    both = sliced.join(texts.select(F.col("doc").alias("other"), F.col("text").alias("first_text")), "other").select("doc", "other", "matches", "begin", "words", "first_text")
    return cut_clear(both.mapInArrow(lambda it: _align(it, s), PASSAGES))


def shared_passages(docs: DataFrame, id_col: str = "doc_id", text: str = "text", s: Settings = Settings()) -> DataFrame:
    """doc, start, end, other, other_start, other_end, same: aligned passages of each text in those that have their seeds first, and last before it, and in all that may add words to these."""
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc"), F.col(text).alias("text"))
    chains = all_chains(rows, s)
    texts = rows.select("doc", packed("text").alias("text"))
    found = first_passages(chains, texts, s)
    more = other_pairs(chains, found, texts, s)
    return found if more is None else found.unionByName(more)


def united(passages: DataFrame, min_words: int) -> DataFrame:
    """Overlapping or touching passages of a text as one; those of min_words or more: doc, start, end, others, n_parts."""
    w = Window.partitionBy("doc").orderBy("start", "end", "other", "other_start")
    reached = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    begun = passages.withColumn("_new", F.when(reached.isNull() | (F.col("start") > reached), 1).otherwise(0)).withColumn("_part", F.sum("_new").over(w))
    found = begun.groupBy("doc", "_part").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.array_sort(F.collect_set("other")).alias("others"), F.count("*").alias("n_parts"))
    return found.where(F.col("end") - F.col("start") >= min_words).drop("_part")


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text: str = "text", s: Settings = Settings()) -> DataFrame:
    """id, start_word, end_word (exclusive), other_ids (texts that have parts of it first), n_parts: one row a passage."""
    found = united(shared_passages(docs, id_col, text, s), s.min_words)
    return found.select(F.col("doc").alias(id_col), F.col("start").alias("start_word"), F.col("end").alias("end_word"), F.col("others").alias("other_ids"), "n_parts")


def op5_shared_passages(spark, sf_dir: str) -> DataFrame:
    return repeated_passages(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
