"""Operator 2, BPE encoding and decoding with tree concatenation.

A short text is encoded in one piece. A long one is cut into halves, again and
again, down to leaves; the leaves become rows of their own and are encoded in
parallel. Then each pair of neighbours is joined: a window around the join is
encoded anew and doubled until it agrees exactly (ids and offsets of several
tokens in a row) with the left side and with the right side; its tokens replace
those between the two places. A run of BPE tokens is the encoding of its text if
each two neighbours are so, hence the joined tokens are those of the whole text.
If no window agrees, the last one is the whole text itself.

Within a piece, words between ASCII white space are encoded once and kept in a
bounded table, since neither merges nor the patterns of the vocabulary reach
across white space. The words of a block of texts are looked up together, by
hash, and only new ones are sent to the vocabulary's library. Of a leaf, only
the tokens near its ends carry offsets; a window that grows beyond them finds no
agreement there and becomes whole.

Defined results: a null or empty text has no tokens and decodes to an empty
text. Repeated rows give repeated results. Keys may be null. Only the named key
columns are returned besides the results.
"""

from __future__ import annotations

import json
import os
import re
import sys
from array import array
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesgrove.llm import textops
from seriesgrove.llm.wordtable import WordTable, ragged

#: Code points above which a text is cut, and of a leaf at most.
LONG, LEAF = 32768, 8192
#: Half the first window around a join, and the tokens in a row that must agree.
WINDOW, AGREE = 64, 4
#: Code points at either end of a leaf whose tokens carry offsets.
EDGE = 512
#: Bytes of text for which a worker holds results at once.
HELD = 1 << 20
#: Bytes of words and ids that a worker keeps from one task to the next, and bytes of a word that is kept.
KEPT, WORD = 64 << 20, 128

BLANK = re.compile("[\x20\x09-\x0d]")

#: Bytes from which a word's letter case may depend on more than each of its ASCII letters, since characters may be composed anew.
UNSURE = 0xC9

#: How a known vocabulary splits lower-case text, a fixed value; and, for all but the characters of NOT_SIMPLE, the same here.
KNOWN_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NOT_SIMPLE = re.compile("^.*[^\\n!-/0-9:-@\\[-`a-z{-~\xdf-\xf6\xf8-\xff\u0153].*$", re.M)
SPLIT = re.compile("\\n|'s|'t|'re|'ve|'m|'ll|'d|[a-z\xdf-\xf6\xf8-\xff\u0153]+|[0-9]|[^\\na-z0-9\xdf-\xf6\xf8-\xff\u0153]+")


class Encoder:
    """Encodes with one vocabulary; `table` keeps words and their ids."""

    def __init__(self, path: str, kept: int = KEPT):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task, one core
        from tokenizers import Tokenizer

        self.tokenizer, self.table = Tokenizer.from_file(path), WordTable(kept)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.tokens = [self.tokenizer.id_to_token(i) for i in range(self.tokenizer.get_vocab_size())]
        self.strings = pa.array(self.tokens, pa.string())
        # Only a vocabulary that lower-cases anyway gives capitals and small letters the same ids.
        self.folds = self.raw("A Q\u00c9") == self.raw("a q\u00e9")
        self.splits = self.folds and json.dumps(KNOWN_SPLIT) in self.tokenizer.to_str() and '"end_of_word_suffix":"</w>"' in self.tokenizer.to_str()
        self.last = np.array([t is not None and t.endswith("</w>") for t in self.tokens], bool)

    def raw(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def decode(self, ids: list[int]) -> str:
        """As the vocabulary's library does where it has no decoder, from a table; as it does in any case otherwise."""
        return " ".join(map(self.tokens.__getitem__, ids)) if self.tokenizer.decoder is None else self.tokenizer.decode(ids, skip_special_tokens=False)

    def decode_all(self, ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
        """decode() of stretches of ids."""
        if self.tokenizer.decoder is None and not self.strings.null_count:
            words = self.strings.take(pa.array(ids, pa.uint32()))
            return pc.binary_join(pa.LargeListArray.from_arrays(pa.array(bounds, pa.int64()), words), " ").cast(pa.string())
        return pa.array([self.decode(ids[a:z].tolist()) for a, z in zip(bounds, bounds[1:], strict=False)], pa.string())

    def parts(self, words: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their number for simple lower-case words, one a line; the parts that they are split into are encoded together and kept."""
        coded = pa.array(SPLIT.findall(words), pa.string()).dictionary_encode()
        codes, distinct = coded.indices.to_numpy(), coded.dictionary
        _, offsets, data = distinct.buffers()
        offsets = np.frombuffer(offsets, np.int32)[: len(distinct) + 1].astype(np.int64)
        data = np.frombuffer(data, np.uint8)
        starts, lengths = offsets[:-1], np.diff(offsets)
        line = (lengths == 1) & (data[starts] == 10)  # the breaks between the words are parts of their own
        hashes = textops.hash_words(data, starts, offsets[1:])
        own = np.flatnonzero(~line)
        at = self.table.lookup(hashes[own], data, starts[own], lengths[own])
        counts = np.zeros(len(distinct), np.int64)
        made: list[np.ndarray] = []
        new = own[at < 0]
        for lo in range(0, len(new), 1024):
            some = new[lo : lo + 1024]
            texts = distinct.take(pa.array(some)).to_pylist()
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(texts)], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) != len(some):
                each = [self.raw(t) for t in texts]
                ids, ends = np.array([i for e in each for i in e], np.uint32), np.cumsum([len(e) for e in each])
            counts[some] = np.diff(ends, prepend=0)
            made.append(ids)
        fresh = np.concatenate(made) if made else np.zeros(0, np.uint32)
        held, sizes = self.table.young.ids.take(at[at >= 0])
        counts[own[at >= 0]] = sizes
        flat = np.concatenate([held, fresh])
        begin = np.zeros(len(distinct), np.int64)
        order = np.concatenate([own[at >= 0], new])
        begin[order] = np.cumsum(counts[order]) - counts[order]
        if (at == -1).any():  # not of those whose hash another word has
            keep = own[at == -1]
            self.table.add(hashes[keep], data, starts[keep], lengths[keep], flat[ragged(begin[keep], counts[keep])], counts[keep])
        breaks = line[codes]
        word, inner = np.cumsum(breaks)[~breaks], codes[~breaks]
        return flat[ragged(begin[inner], counts[inner])], np.bincount(word, counts[inner], int(breaks.sum()) + 1).astype(np.int64)

    def learn(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their number for different words that are not held; those of at most WORD bytes are kept."""
        copy = data[np.minimum(ragged(starts, lengths + 1), len(data) - 1)]
        copy[np.cumsum(lengths + 1) - 1] = 10
        text = copy[:-1].tobytes().decode()
        words = text.split("\n")
        simple = (lengths <= WORD) & self.splits
        if simple.any() and (odd := set(NOT_SIMPLE.findall(text))):
            simple &= np.array([w not in odd for w in words], bool)
        ids: list[np.ndarray] = []
        counts = np.zeros(len(words), np.int64)
        easy, hard = np.flatnonzero(simple), np.flatnonzero(~simple)
        if len(easy):
            found, counts[easy] = self.parts(text if not len(hard) else "\n".join([words[i] for i in easy.tolist()]))
            ids.append(found)
        for i in hard.tolist():
            ids.append(np.array(self.raw(words[i]), np.uint32))
            counts[i] = len(ids[-1])
        flat, order = np.concatenate(ids), np.concatenate([easy, hard])
        begin = np.zeros(len(words), np.int64)
        begin[order] = np.cumsum(counts[order]) - counts[order]
        flat = flat[ragged(begin, counts)]
        keep = np.flatnonzero(lengths <= WORD)
        keep = keep[self.table.young.find(hashes[keep]) < 0]  # a word of one part is held already
        begin = np.cumsum(counts) - counts
        self.table.add(hashes[keep], data, starts[keep], lengths[keep], flat[ragged(begin[keep], counts[keep])], counts[keep])
        return flat, counts

    def block(self, b: textops.Block) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts of a block, one after another, and their number in each text."""
        self.table.turn()
        starts, ends, first = b.words()
        data = b.data
        if self.folds:
            data = textops.LOWER[data]
            latin = np.flatnonzero(data[:-1] == 0xC3) + 1  # the capitals of Latin-1
            data[latin[(data[latin] <= 0x9E) & (data[latin] != 0x97)]] += 0x20
            if len(high := np.flatnonzero(data >= UNSURE)):
                odd = np.unique(np.searchsorted(starts, high, "right") - 1)
                at = ragged(starts[odd], (ends - starts)[odd])
                data[at] = b.data[at]
        lengths = ends - starts
        hashes = textops.hash_words(data, starts, ends)
        order = np.argsort(hashes)  # any place of a word will do, so the order of equal ones does not matter
        hashes = hashes[order]
        new = np.append(True, hashes[1:] != hashes[:-1])[: len(hashes)]
        hashes, one, word = hashes[new], order[new], np.empty(len(order), np.int64)
        word[order] = np.cumsum(new) - 1
        own, size = starts[one], lengths[one]
        at = self.table.lookup(hashes, data, own, size)
        new, held = np.flatnonzero(at == -1), np.flatnonzero(at >= 0)
        flat, counts = self.table.young.ids.take(at[held])
        ids, begin, number = [flat], np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        number[held], begin[held] = counts, np.cumsum(counts) - counts
        if len(new):
            more, counts = self.learn(data, own[new], size[new], hashes[new])
            number[new], begin[new] = counts, np.cumsum(counts) - counts + len(flat)
            ids.append(more)
        ids, counts = np.concatenate(ids)[ragged(begin[word], number[word])], number[word]
        found = np.append(0, np.cumsum(counts))[first]
        # Texts with a special token, or a word whose hash another word has, go to the library as they are.
        alone = np.zeros(len(b), bool)
        same = lengths == size[word]
        whole_block = bool(same.all())
        as_long = slice(None) if whole_block else np.flatnonzero(same)
        length = lengths[as_long]
        read = data[~textops.IS_SPACE[b.data]] if whole_block else data[ragged(starts[as_long], length)]  # the bytes of these words, one after another
        differ = read != data[ragged(own[word][as_long], length)]
        if differ.any():
            same[np.repeat(np.arange(len(word))[as_long], length)[differ]] = False
        alone[np.searchsorted(first, np.flatnonzero(~same | (at[word] == -2)), "right") - 1] = True
        whole = b.data.tobytes()
        if b"<|" in whole:
            alone |= np.array([b"<|" in whole[a:z] for a, z in zip(b.bounds, b.bounds[1:], strict=False)], bool)
        if not alone.any():
            return ids, np.diff(found)
        each = [np.array(self.raw(whole[b.bounds[i] : b.bounds[i + 1]].decode()), np.uint32) if alone[i] else ids[found[i] : found[i + 1]] for i in range(len(b))]
        return np.concatenate(each), np.array([len(e) for e in each], np.int64)

    def pieces(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """By block of texts that are not cut: the first text, ids one after another, and their bounds (one more at the end)."""
        for b in textops.blocks(texts, HELD):
            ids, counts = self.block(b)
            yield b.first, ids, np.append(0, np.cumsum(counts))

    def piece(self, text: str) -> bytes:
        return b"".join(ids.astype("<u4").tobytes() for _, ids, _ in self.pieces(pa.array([text], pa.string())))

    def leaves(self, texts: list[str], at: list[int], edge: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Tokens of leaves: rows with offsets of the head, ids of the middle, rows of the tail; the middle begins and ends at white space."""
        cuts = []
        for text in texts:
            head, tail = BLANK.search(text, edge), BLANK.search(text[::-1], edge)
            a, z = (head.start() if head else len(text)), (len(text) - tail.start() if tail else 0)
            cuts.append((a, z) if a < z else (len(text), len(text)))
        middles = []
        for _, ids, bounds in self.pieces(pa.array([t[a:z] for t, (a, z) in zip(texts, cuts, strict=True)], pa.string())):
            middles += [ids[a:z].astype(np.int64) for a, z in zip(bounds, bounds[1:], strict=False)]
        return [(self.located(t[:a], o), m, self.located(t[z:], o + z)) for t, o, (a, z), m in zip(texts, at, cuts, middles, strict=True)]

    def located(self, text: str, at: int = 0) -> np.ndarray:
        """Rows of (id, start, end) of a text that begins at code point `at`."""
        e = self.tokenizer.encode(text, add_special_tokens=False)
        out = np.empty((len(e.ids), 3), np.int64)
        out[:, 0] = e.ids
        out[:, 1:] = np.array(e.offsets, np.int64).reshape(-1, 2) + at
        return out


_encoders: dict[str, Encoder] = {}


def unpack_ids(data: bytes) -> list[int]:
    out = array("I", data)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tolist()


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def agreement(side: np.ndarray, window: np.ndarray, last: bool, agree: int = AGREE) -> tuple[int, int] | None:
    """Rows (i of side, j of window) from which `agree` rows are equal: the first such in the window, or the last.

    The window's outer tokens are not used, nor a token that begins where the one before it does.
    """
    n = len(window) - agree
    for j in reversed(range(1, n)) if last else range(1, n):
        if window[j, 1] == window[j - 1, 1]:
            continue
        i = int(np.searchsorted(side[:, 1], window[j, 1], "left"))
        if i + agree <= len(side) and np.array_equal(side[i : i + agree], window[j : j + agree]):
            return i, j
    return None


def join(left: np.ndarray, right: np.ndarray, lo: int, middle: int, hi: int, encode: Callable[[int, int], np.ndarray], window: int = WINDOW) -> np.ndarray:
    """The tokens of [lo, hi) from those of [lo, middle) and [middle, hi)."""
    while True:
        a, z = max(lo, middle - window), min(hi, middle + window)
        fresh = encode(a, z)
        if a == lo and z == hi:
            return fresh
        first = (0, 0) if a == lo else agreement(left, fresh, last=False)
        final = (len(right), len(fresh)) if z == hi else agreement(right, fresh, last=True)
        if first and final and first[1] <= final[1] and (a == lo or fresh[first[1] + AGREE - 1, 2] <= middle) and (z == hi or fresh[final[1], 1] >= middle):
            return np.concatenate([left[: first[0]], fresh[first[1] : final[1]], right[final[0] :]])
        window *= 2


def whole_rows(head: np.ndarray, middle: np.ndarray, tail: np.ndarray) -> np.ndarray:
    """The rows of a leaf; tokens of the middle have a place, but an end that no token has."""
    between = np.full((len(middle), 3), -1, np.int64)
    between[:, 0] = middle
    between[:, 1] = head[-1, 2] if len(head) else 0
    return np.concatenate([head, between, tail])


def halves(length: int, leaf: int) -> list[int]:
    """Bounds of the leaves: each part above `leaf` is cut in the middle, to one depth for all."""
    n = 1
    while -(-length // n) > leaf:
        n *= 2
    return [length * i // n for i in range(n + 1)]


def concatenate(leaves: list[np.ndarray], bounds: list[int], encode: Callable[[int, int], np.ndarray], window: int = WINDOW) -> np.ndarray:
    """Joins neighbours pairwise until one run of tokens is left."""
    while len(leaves) > 1:
        leaves = [join(leaves[i], leaves[i + 1], bounds[i], bounds[i + 1], bounds[i + 2], encode, window) for i in range(0, len(leaves), 2)]
        bounds = bounds[::2]
    return leaves[0]


def by_tree(enc: Encoder, text: str, leaf: int = LEAF, window: int = WINDOW, edge: int = EDGE) -> np.ndarray:
    """Ids of a text by tree concatenation in one process."""
    bounds = halves(len(text), leaf)
    encode = lambda a, z: enc.located(text[a:z], a)
    return concatenate([whole_rows(*found) for found in enc.leaves([text[a:z] for a, z in zip(bounds, bounds[1:], strict=False)], bounds[:-1], edge)], bounds, encode, window)[:, 0]


def _names(keys: list[str], decode: bool) -> list[str]:
    return [*keys, "n_tokens", "ids", "decoded"][: len(keys) + 2 + decode]


@textops.tidy
def _whole(batches: Iterator[pa.RecordBatch], path: str, keys: list[str], decode: bool) -> Iterator[pa.RecordBatch]:
    enc = encoder(path)
    for batch in batches:
        for first, ids, bounds in enc.pieces(batch.column(len(keys))):
            part = batch.slice(first, len(bounds) - 1)
            data = pa.py_buffer(ids.astype("<u4", copy=False))
            packed = pa.Array.from_buffers(pa.binary(), len(part), [None, pa.py_buffer((4 * bounds).astype(np.int32)), data])
            results = [pa.array(np.diff(bounds), pa.int64()), packed, *([enc.decode_all(ids, bounds)] if decode else [])]
            yield pa.RecordBatch.from_arrays([*part.columns[: len(keys)], *results], names=_names(keys, decode))


@textops.tidy
def _cut(batches: Iterator[pa.RecordBatch], leaf: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = batch.num_columns - 1
        for row in range(batch.num_rows):
            text = batch.column(n)[row].as_py()
            bounds = halves(len(text), leaf)
            for lo in range(0, len(bounds) - 1, 256):
                cut = list(zip(bounds, bounds[1:], strict=False))[lo : lo + 256]
                same = [pa.repeat(c[row], len(cut)) for c in batch.columns[:n]]
                yield pa.RecordBatch.from_arrays([*same, pa.array([a for a, _ in cut], pa.int64()), pa.array([text[a:z] for a, z in cut], pa.string())], names=[*batch.schema.names[:n], "_at", "_piece"])


@textops.tidy
def _leaves(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    enc = encoder(path)
    for batch in batches:
        n = batch.num_columns
        at, pieces = batch.column(n - 2).to_pylist(), batch.column(n - 1).to_pylist()
        found = enc.leaves(pieces, at, EDGE)
        packed = [pa.array([f[i].astype("<u4").tobytes() for f in found], pa.binary()) for i in range(3)]
        yield pa.RecordBatch.from_arrays([*batch.columns, *packed], names=[*batch.schema.names, "_head", "_middle", "_tail"])


def _join(table: pa.Table, path: str, keys: list[str], decode: bool) -> pa.Table:
    """The tokens of one text from the rows of its leaves, once for each copy of the row."""
    enc = encoder(path)
    order = sorted(zip(table["_at"].to_pylist(), range(table.num_rows), strict=True))
    pieces = [table["_piece"][i].as_py() for _, i in order]
    part = lambda name, i: np.frombuffer(table[name][i].as_py(), "<u4").astype(np.int64)
    leaves = [whole_rows(part("_head", i).reshape(-1, 3), part("_middle", i), part("_tail", i).reshape(-1, 3)) for _, i in order]
    text = "".join(pieces)
    ids = concatenate(leaves, [a for a, _ in order] + [len(text)], lambda a, z: enc.located(text[a:z], a))[:, 0]
    copies = table["_copies"][0].as_py()
    same = [pa.repeat(table[k][0], copies) for k in keys]
    results = [pa.scalar(len(ids), pa.int64()), pa.scalar(ids.astype("<u4").tobytes(), pa.binary()), *([pa.scalar(enc.decode(ids.tolist()), pa.string())] if decode else [])]
    return pa.table([*same, *(pa.repeat(r, copies) for r in results)], names=_names(keys, decode))


def encode(docs: DataFrame, path: str, keys: tuple[str, ...] = ("doc_id",), text: str = "text", long: int = LONG, leaf: int = LEAF, decode: bool = True) -> DataFrame:
    """keys, n_tokens, ids (binary, little-endian unsigned 32-bit integers) and, unless not asked for, decoded text of every row.

    Only texts above `long` are shuffled: equal rows once, then by leaf, then by row.
    """
    names = list(keys)
    kept = [docs.schema[k] for k in names]
    result = T.StructType([*kept, T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType()), *([T.StructField("decoded", T.StringType())] if decode else [])])
    size = F.length(F.coalesce(F.col(text), F.lit("")))
    short = docs.where(size <= long).select(*names, F.col(text).alias("_text")).mapInArrow(partial(_whole, path=path, keys=names, decode=decode), result)
    rows = docs.where(size > long).groupBy(*names, F.sha2(text, 256).alias("_sha")).agg(F.count("*").alias("_copies"), F.first(text).alias("_text"))
    pieces = T.StructType([*kept, T.StructField("_sha", T.StringType()), T.StructField("_copies", T.LongType()), T.StructField("_at", T.LongType()), T.StructField("_piece", T.StringType())])
    cut = rows.mapInArrow(partial(_cut, leaf=leaf), pieces).repartition("_sha", "_at")
    done = cut.mapInArrow(partial(_leaves, path=path), T.StructType([*pieces, *(T.StructField(c, T.BinaryType()) for c in ("_head", "_middle", "_tail"))]))

    def join_rows(table: pa.Table) -> pa.Table:
        return _join(table, path, names, decode)

    joined = done.groupBy(*names, "_sha").applyInArrow(join_rows, result)
    return short.unionByName(joined)


def word_bpe() -> str:
    """The vocabulary file that the queries use."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def digests(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, and the digests of ids and decoded text."""
    return encoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_bpe_encode(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return digests(encode(docs, word_bpe()))
