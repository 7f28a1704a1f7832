"""Operator 7, token ids packed into rows of fixed length.

Documents are split without loss into pieces of at most the row length; full
pieces fill rows of their own. The other pieces of a pool are placed in falling
order of length, each in the row with the least room that still holds it. A
segment tree over the amounts of room finds that row: its leaves hold the rows
with exactly so much room, its inner nodes whether there are any below.

A pool is what a task has read of its partition, up to a number of tokens, so
nothing is shuffled and memory is bounded.

Defined results: a document without tokens is in no row. Repeated rows are
packed each. Null ids are kept as null in the list of documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesgrove.llm import bpe, textops

LENGTH, POOL, PAD = 2048, 1 << 20, 0
SCHEMA = "doc_ids array<bigint>, piece_starts array<bigint>, doc_tokens array<bigint>, cu_seqlens array<int>, n_tokens int, ids binary, positions binary"


class Room:
    """Rows by their room, from 0 to a limit."""

    def __init__(self, limit: int):
        self.size = 1 << limit.bit_length()
        self.any = np.zeros(2 * self.size, bool).tolist()
        self.rows: list[list[int]] = [[] for _ in range(self.size)]

    def put(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        i = self.size + room
        while i and not self.any[i]:
            self.any[i] = True
            i >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """Removes a row with the least room that is at least so much: (room, row)."""
        i = self.size + least
        while not self.any[i]:
            while i & 1:  # a right child: what is further right lies above
                i >>= 1
                if i <= 1:
                    return None
            i += 1
        while i < self.size:
            i = 2 * i if self.any[2 * i] else 2 * i + 1
        room = i - self.size
        row = self.rows[room].pop()
        if not self.rows[room]:
            while i and (i >= self.size or not (self.any[2 * i] or self.any[2 * i + 1])):
                self.any[i] = False
                i >>= 1
        return room, row


def best_fit(lengths: list[int], length: int) -> list[list[int]]:
    """The indices of the pieces in each row; lengths are from 1 to `length`."""
    rows: list[list[int]] = []
    room = Room(length)
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        found = room.take(lengths[i])
        if found is None:
            found = length, len(rows)
            rows.append([])
        left, row = found
        rows[row].append(i)
        if left > lengths[i]:
            room.put(left - lengths[i], row)
    return rows


def pack(pool: list[tuple[int | None, np.ndarray]], length: int, pad: int) -> pa.RecordBatch:
    """Rows of SCHEMA for some documents."""
    pieces = [(doc, at, len(ids), ids[at : at + length]) for doc, ids in pool for at in range(0, len(ids), length)]
    rows = best_fit([len(p[3]) for p in pieces], length)
    docs, starts, totals, ends, used, matrix, places = [], [], [], [], [], [], []
    for row in rows:
        own = [pieces[i] for i in row]
        lengths = [len(p[3]) for p in own]
        bounds = np.append(0, np.cumsum(lengths))
        n = int(bounds[-1])
        ids = np.full(length, pad, "<u4")
        ids[:n] = np.concatenate([p[3] for p in own])
        reset = np.zeros(length, "<u4")
        reset[:n] = np.arange(n) - np.repeat(bounds[:-1], lengths)
        docs.append([p[0] for p in own])
        starts.append([p[1] for p in own])
        totals.append([p[2] for p in own])
        ends.append(bounds.tolist())
        used.append(n)
        matrix.append(ids.tobytes())
        places.append(reset.tobytes())
    longs, ints = pa.list_(pa.int64()), pa.list_(pa.int32())
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(docs, longs), pa.array(starts, longs), pa.array(totals, longs), pa.array(ends, ints), pa.array(used, pa.int32()), pa.array(matrix, pa.binary()), pa.array(places, pa.binary())], names=names)


@textops.tidy
def _pools(batches: Iterator[pa.RecordBatch], length: int, pool: int, pad: int) -> Iterator[pa.RecordBatch]:
    held: list[tuple[int | None, np.ndarray]] = []
    tokens = 0
    for batch in batches:
        for doc, ids in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            found = np.frombuffer(ids.as_py() or b"", "<u4")
            held.append((doc, found))
            tokens += len(found)
            if tokens >= pool:
                yield pack(held, length, pad)
                held, tokens = [], 0
    if tokens:
        yield pack(held, length, pad)


def pack_tokens(encoded: DataFrame, id_col: str = "doc_id", ids: str = "ids", length: int = LENGTH, pool: int = POOL, pad: int = PAD) -> DataFrame:
    """Packed rows of a column of ids (binary, little-endian unsigned 32-bit integers).

    Of each row: its segments' documents, their first token in the document and the document's tokens; cu_seqlens, the
    bounds of the segments; n_tokens without padding; ids and positions, each `length` little-endian unsigned 32-bit
    integers, positions beginning again at 0 with each segment.
    """
    return encoded.select(F.col(id_col).cast("long"), F.col(ids)).mapInArrow(partial(_pools, length=length, pool=pool, pad=pad), SCHEMA)


def op7_pack_tokens(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack_tokens(bpe.encode(docs, bpe.word_bpe(), decode=False))
