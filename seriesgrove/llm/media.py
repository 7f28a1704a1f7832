"""Operator 3, media columns from ISO media containers.

A container is a tree of boxes. The reader walks nested boxes by their sizes
(32-bit, 64-bit, or to the end), decodes the sample tables of each track (stts,
stsc, stsz or stz2, stco or co64, stss) and the runs of its fragments (tfhd,
trun, with the defaults of trex), and gives codec, duration and the byte ranges
of the keyframes of every track. It reads headers only: payload bytes in mdat
are sliced when asked for and never decoded.

Defined results: null bytes, bytes without a moov box or a track, broken boxes
and offsets outside the bytes give null columns and the reason in `error`. A
track without stss has only keyframes. The flat columns are those of the first
track, `tracks` has all in their order. A fragmented track whose duration is 0
has that of its samples. For texts, a null counts as empty; equal texts give equal values.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesgrove.llm import textops

#: Boxes that hold boxes, as named by the container format.
PARENTS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf", b"udta", b"mvex", b"moof", b"traf"}
UNIT, GROUP, RATE = 64, 16, 8000


class Broken(ValueError):
    """The bytes are not a well-formed container."""


def boxes(data: memoryview, lo: int, hi: int) -> Iterator[tuple[bytes, int, int]]:
    """Type, first byte of the content and end of each box in a range."""
    while lo < hi:
        if hi - lo < 8:
            raise Broken("a box header is cut off")
        size, kind = struct.unpack_from(">I4s", data, lo)
        head = 8
        if size == 1:
            if hi - lo < 16:
                raise Broken("a box header is cut off")
            size, head = struct.unpack_from(">Q", data, lo + 8)[0], 16
        elif size == 0:
            size = hi - lo
        if size < head or lo + size > hi:
            raise Broken(f"box {kind!r} has a wrong size")
        yield kind, lo + head, lo + size
        lo += size


def walk(data: memoryview, lo: int = 0, hi: int | None = None, path: tuple[bytes, ...] = ()) -> Iterator[tuple[tuple[bytes, ...], int, int]]:
    """The paths and content ranges of all boxes, depth first."""
    todo = [(path, lo, len(data) if hi is None else hi)]
    while todo:
        path, lo, hi = todo.pop()
        inner = []
        for kind, a, z in boxes(data, lo, hi):
            yield (*path, kind), a, z
            if kind in PARENTS:
                inner.append(((*path, kind), a, z))
        todo += reversed(inner)


def table(data: memoryview, at: int, end: int, count: int, dtype: str, columns: int = 1) -> np.ndarray:
    if at + count * columns * np.dtype(dtype).itemsize > end:
        raise Broken("a table is cut off")
    return np.frombuffer(data, dtype, count * columns, at).astype(np.int64).reshape(count, columns)


@dataclass
class Track:
    number: int
    codec: str
    timescale: int
    duration: int
    offsets: np.ndarray
    sizes: np.ndarray
    durations: np.ndarray
    sync: np.ndarray

    def ranges(self) -> np.ndarray:
        """Byte ranges (start, end) of the keyframes."""
        return np.stack([self.offsets[self.sync], self.offsets[self.sync] + self.sizes[self.sync]], axis=1)


def tracks(data: bytes) -> list[Track]:
    """The tracks of a container, with the samples of its fragments."""
    view = memoryview(data)
    top = list(boxes(view, 0, len(view)))
    movies = [(a, z) for kind, a, z in top if kind == b"moov"]
    if not movies:
        raise Broken("no moov box")
    out, defaults = [], {}
    for lo, hi in movies:
        for path, a, z in walk(view, lo, hi):
            if path == (b"trak",):
                out.append(track(view, a, z))
            elif path == (b"mvex", b"trex"):
                number, _, *rest = words(view, a + 4, z, 5)
                defaults[number] = rest
    begin = 0
    for kind, a, z in top:
        if kind == b"moof":
            fragment(view, begin, a, z, {t.number: t for t in out}, defaults)
        begin = z
    for t in out:
        if t.duration == 0:
            t.duration = int(t.durations.sum())
    return out


def words(data: memoryview, at: int, end: int, n: int) -> tuple[int, ...]:
    """n unsigned 32-bit integers."""
    if at + 4 * n > end:
        raise Broken("a field is cut off")
    return struct.unpack_from(f">{n}I", data, at)


def fragment(data: memoryview, begin: int, lo: int, hi: int, named: dict[int, Track], defaults: dict[int, list[int]]) -> None:
    """Adds the samples of the movie fragment whose box begins at `begin` to their tracks."""
    before = begin  # where the data of the track before ends
    for kind, a, z in boxes(data, lo, hi):
        if kind != b"traf":
            continue
        inner = list(boxes(data, a, z))
        heads = [(x, y) for k, x, y in inner if k == b"tfhd"]
        if not heads:
            raise Broken("no tfhd box")
        x, y = heads[0]
        flags, number = words(data, x, y, 2)
        x += 8
        if number not in named:
            raise Broken("a fragment names a missing track")
        t, usual = named[number], list(defaults.get(number, [0, 0, 0]))
        base = begin if flags & 0x20000 else before
        if flags & 1:
            high, low = words(data, x, y, 2)
            base, x = high << 32 | low, x + 8
        x += 4 if flags & 2 else 0
        for i, bit in enumerate((8, 16, 32)):
            if flags & bit:
                (usual[i],), x = words(data, x, y, 1), x + 4
        at = base
        for k, x, y in inner:
            if k != b"trun":
                continue
            flags, n = words(data, x, y, 2)
            x += 8
            if flags & 1:
                (shift,), x = words(data, x, y, 1), x + 4
                at = base + (shift - (1 << 32) if shift >> 31 else shift)
            first = None
            if flags & 4:
                (first,), x = words(data, x, y, 1), x + 4
            fields = [bit for bit in (0x100, 0x200, 0x400, 0x800) if flags & bit]
            if not fields and n > len(data):
                raise Broken("more samples than bytes")
            rows = table(data, x, y, n, ">u4", len(fields)) if fields else np.zeros((n, 0), np.int64)
            times, sizes, marks = (rows[:, fields.index(bit)] if bit in fields else np.full(n, usual[i], np.int64) for i, bit in enumerate((0x100, 0x200, 0x400)))
            if first is not None and n:
                marks = marks.copy()
                marks[0] = first
            offsets = at + np.cumsum(sizes) - sizes if 0 <= at <= len(data) else np.full(n, -1)
            if n and (offsets.min() < 0 or (offsets + sizes).max() > len(data)):
                raise Broken("a sample is outside the bytes")
            at += int(sizes.sum())
            t.sync = np.append(t.sync, len(t.sizes) + np.flatnonzero(marks & 0x10000 == 0))
            t.offsets, t.sizes, t.durations = np.append(t.offsets, offsets), np.append(t.sizes, sizes), np.append(t.durations, times)
        before = at


def track(data: memoryview, lo: int, hi: int) -> Track:
    found = {path[-1]: (a, z) for path, a, z in walk(data, lo, hi)}

    def body(kind: bytes) -> tuple[int, int]:
        if kind not in found:
            raise Broken(f"no {kind.decode()} box")
        return found[kind]

    def number(at: int, end: int, form: str = ">I") -> int:
        if at + struct.calcsize(form) > end:
            raise Broken("a field is cut off")
        return struct.unpack_from(form, data, at)[0]

    a, z = body(b"tkhd") if b"tkhd" in found else (0, 0)
    named = number(a + (20 if number(a, z, ">B") == 1 else 12), z) if z else 0
    a, z = body(b"mdhd")
    long = number(a, z, ">B") == 1
    timescale = number(a + (20 if long else 12), z)
    duration = number(a + (24 if long else 16), z, ">Q" if long else ">I")
    a, z = body(b"stsd")
    codec = bytes(data[a + 12 : a + 16]).decode("latin-1") if number(a + 4, z) else ""
    a, z = body(b"stts")
    stts = table(data, a + 8, z, number(a + 4, z), ">u4", 2)
    if b"stsz" in found:
        a, z = found[b"stsz"]
        fixed, n = number(a + 4, z), number(a + 8, z)
        if fixed and n > len(data) // fixed:
            raise Broken("more samples than bytes")
        sizes = np.full(n, fixed, np.int64) if fixed else table(data, a + 12, z, n, ">u4")[:, 0]
    else:
        a, z = body(b"stz2")
        bits, n = number(a + 7, z, ">B"), number(a + 8, z)
        if bits == 4:
            pair = table(data, a + 12, z, (n + 1) // 2, ">u1")[:, 0]
            sizes = np.stack([pair >> 4, pair & 15], axis=1).ravel()[:n]
        else:
            sizes = table(data, a + 12, z, n, ">u1" if bits == 8 else ">u2")[:, 0]
    wide = b"co64" in found
    a, z = body(b"co64" if wide else b"stco")
    chunks = table(data, a + 8, z, number(a + 4, z), ">u8" if wide else ">u4")[:, 0]
    a, z = body(b"stsc")
    stsc = table(data, a + 8, z, number(a + 4, z), ">u4", 3)
    n = len(sizes)
    if stts[:, 0].sum() != n:
        raise Broken("stts and sample sizes disagree")
    durations = np.repeat(stts[:, 1], stts[:, 0])
    first = np.append(stsc[:, 0] - 1, len(chunks))
    if n and (not len(stsc) or first[0] != 0 or (np.diff(first) < 0).any()):
        raise Broken("stsc is not in order")
    per_chunk = np.repeat(stsc[:, 1], np.diff(first)) if len(stsc) else np.zeros(0, np.int64)
    if per_chunk.sum() != n:
        raise Broken("chunks and sample sizes disagree")
    chunk = np.repeat(np.arange(len(chunks)), per_chunk)
    before = np.cumsum(sizes) - sizes
    lead = np.cumsum(per_chunk) - per_chunk
    offsets = chunks[chunk] + before - before[lead[chunk]] if n else np.zeros(0, np.int64)
    if n and (chunks.min() < 0 or chunks.max() > len(data) or (offsets + sizes).max() > len(data)):  # offsets of 64 bits may wrap
        raise Broken("a sample is outside the bytes")
    sync = np.arange(n)
    if b"stss" in found:
        a, z = found[b"stss"]
        sync = table(data, a + 8, z, number(a + 4, z), ">u4")[:, 0] - 1
        if len(sync) and (sync.min() < 0 or sync.max() >= n):
            raise Broken("stss names a missing sample")
    return Track(named, codec, timescale, duration, offsets, sizes, durations, sync)


def stored(data: bytes, t: Track) -> bytes:
    """The bytes of all samples in order, in one slice per run of neighbours."""
    if not len(t.offsets):
        return b""
    cut = np.flatnonzero(t.offsets[1:] != (t.offsets + t.sizes)[:-1]) + 1
    a, z = np.append(0, cut), np.append(cut, len(t.offsets)) - 1
    return b"".join(data[lo:hi] for lo, hi in zip(t.offsets[a].tolist(), (t.offsets[z] + t.sizes[z]).tolist(), strict=True))


def box(kind: bytes, *parts: bytes) -> bytes:
    n = 8 + sum(map(len, parts))
    return (struct.pack(">I4s", n, kind) if n < 1 << 32 else struct.pack(">I4sQ", 1, kind, n + 8)) + b"".join(parts)


def full(kind: bytes, *parts: bytes) -> bytes:
    return box(kind, b"\0\0\0\0", *parts)


def container(payload: bytes, unit: int = UNIT, group: int = GROUP, rate: int = RATE) -> bytes:
    """One audio track of unsigned 8-bit samples at `rate`; a stored sample is `unit` of them, a chunk `group` of those, whose first is a keyframe."""
    n = len(payload) // unit
    if n * unit != len(payload) or not n:
        raise ValueError(f"the payload is not a positive multiple of {unit} bytes")
    chunks, rest = divmod(n, group)
    first = np.arange(0, n, group)
    kind = box(b"ftyp", b"isom\0\0\0\0isommp42")
    entry = box(b"raw ", bytes(6), struct.pack(">HQHHHHI", 1, 0, 1, 8, 0, 0, rate << 16))
    runs = ([(1, group, 1)] if chunks else []) + ([(chunks + 1, rest, 1)] if rest else [])
    matrix = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)

    def head(at: int, wide: bool) -> bytes:
        tables = [
            full(b"stsd", struct.pack(">I", 1), entry),
            full(b"stts", struct.pack(">3I", 1, n, unit)),
            full(b"stss", struct.pack(">I", len(first)), (first + 1).astype(">u4").tobytes()),
            full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">3I", *r) for r in runs)),
            full(b"stsz", struct.pack(">2I", unit, n)),
            full(b"co64" if wide else b"stco", struct.pack(">I", len(first)), (first * unit + at).astype(">u8" if wide else ">u4").tobytes()),
        ]
        media = box(b"minf", full(b"smhd", bytes(4)), box(b"dinf", full(b"dref", struct.pack(">I", 1), box(b"url ", b"\0\0\0\1"))), box(b"stbl", *tables))
        length = struct.pack(">4I", 0, 0, rate, len(payload)) if len(payload) < 1 << 32 else struct.pack(">QQIQ", 0, 0, rate, len(payload))
        v = b"\0\0\0\0" if len(payload) < 1 << 32 else b"\1\0\0\0"
        trak = box(
            b"trak",
            box(b"tkhd", b"\0\0\0\7", struct.pack(">5I", 0, 0, 1, 0, min(len(payload), (1 << 32) - 1)), bytes(8), struct.pack(">4H", 0, 0, 0x100, 0), matrix, bytes(8)),
            box(b"mdia", box(b"mdhd", v, length, struct.pack(">2H", 0x55C4, 0)), full(b"hdlr", bytes(4), b"soun", bytes(12), b"samples\0"), media),
        )
        movie = full(b"mvhd", struct.pack(">4I", 0, 0, rate, min(len(payload), (1 << 32) - 1)), struct.pack(">IH", 0x10000, 0x100), bytes(10), matrix, bytes(24), struct.pack(">I", 2))
        return box(b"moov", movie, trak)

    wide = len(payload) > (1 << 31)
    at = len(kind) + len(head(0, wide)) + (8 if len(payload) + 8 < 1 << 32 else 16)
    return kind + head(at, wide) + box(b"mdat", payload)


_KEYS = "array<struct<start:bigint,end:bigint>>"
COLUMNS = f"codec string, timescale bigint, duration bigint, n_samples bigint, keyframes {_KEYS}, tracks array<struct<track_id:bigint,codec:string,timescale:bigint,duration:bigint,n_samples:bigint,keyframes:{_KEYS}>>, error string"
_TRACK = {"codec": pa.string(), "timescale": pa.int64(), "duration": pa.int64(), "n_samples": pa.int64(), "keyframes": pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))}
_TYPES = _TRACK | {"tracks": pa.list_(pa.struct([("track_id", pa.int64()), *_TRACK.items()])), "error": pa.string()}


def describe(data: bytes | None) -> dict:
    """The columns of a container."""
    try:
        if data is None:
            raise Broken("no bytes")
        found = [
            {"track_id": t.number, "codec": t.codec, "timescale": t.timescale, "duration": t.duration, "n_samples": len(t.sizes), "keyframes": [{"start": a, "end": z} for a, z in t.ranges().tolist()]}
            for t in tracks(data)
        ]
        if not found:
            raise Broken("no track")
        return {k: found[0][k] for k in _TRACK} | {"tracks": found, "error": None}
    except Broken as e:
        return dict.fromkeys(_TYPES) | {"error": str(e)}


def media_columns(frame: DataFrame, data: str, into: str = "media") -> DataFrame:
    """Adds the struct of COLUMNS for a binary column under the name `into`, or the next free name."""

    @F.arrow_udf("struct<" + ",".join(x.replace(" ", ":", 1) for x in COLUMNS.split(", ")) + ">")
    def run(values: pa.Array) -> pa.Array:
        rows = [describe(v.as_py()) for v in values]
        return pa.StructArray.from_arrays([pa.array([r[k] for r in rows], t) for k, t in _TYPES.items()], names=list(_TYPES))

    return frame.withColumn(textops.fresh(frame.columns, into), run(F.col(data)))


def padded(text: str, unit: int = UNIT) -> bytes:
    raw = text.encode()
    return raw + bytes(-len(raw) % unit if raw else unit)


def text_media(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Each text stored as a container: id, n_bytes, the container in `media`."""

    @F.arrow_udf("struct<n_bytes:bigint,media:binary>")
    def store(values: pa.Array) -> pa.Array:
        raw = [v.as_py() or "" for v in values]
        return pa.StructArray.from_arrays([pa.array([len(x.encode()) for x in raw], pa.int64()), pa.array([container(padded(x)) for x in raw], pa.binary())], names=["n_bytes", "media"])

    name = textops.fresh([id_col], "stored")
    return docs.select(F.col(id_col), store(F.col(text)).alias(name)).select(F.col(id_col), f"{name}.*")


def digests(media: str):
    """For a column of containers: what the stored bytes hold, read back through the sample tables."""

    @F.arrow_udf("struct<payload_bytes:bigint,payload_sha256:string,tail_crc32:bigint,media_bytes:bigint,media_sha256:string,feature:string>")
    def run(values: pa.Array) -> pa.Array:
        out = []
        for v in values:
            data = v.as_py()
            t = tracks(data)[0]
            back = stored(data, t)
            keys = ";".join(f"{a}-{z}" for a, z in t.ranges().tolist())
            feature = f"codec={t.codec.strip()} timescale={t.timescale} duration={t.duration} samples={len(t.sizes)} keyframes={len(t.sync)} ranges_sha256={hashlib.sha256(keys.encode()).hexdigest()}"
            out.append((len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-UNIT:]), len(data), hashlib.sha256(data).hexdigest(), feature))
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        return pa.StructArray.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=names)

    return run(F.col(media))


def op3_media_columns(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = media_columns(text_media(docs), "media", "columns").withColumn("digests", digests("media"))
    return found.select("doc_id", "n_bytes", "digests.*", "columns.codec", "columns.duration", F.col("columns.n_samples").alias("n_samples"), F.size("columns.keyframes").cast("long").alias("n_keyframes"))
