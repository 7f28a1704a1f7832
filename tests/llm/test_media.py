import hashlib
import struct
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from seriesgrove.llm import media
from tests.llm.helpers import edge_rows, write_sf


@settings(max_examples=60, deadline=None)
@given(st.binary(min_size=1, max_size=5000))
def test_round_trip(data):
    payload = data + bytes(-len(data) % 64)
    box = media.container(payload)
    (t,) = media.tracks(box)
    assert media.stored(box, t) == payload
    assert t.duration == len(payload) and t.codec == "raw "
    n = len(payload) // 64
    assert t.sync.tolist() == list(range(0, n, 16))
    for (a, z), k in zip(t.ranges().tolist(), t.sync.tolist(), strict=True):
        assert box[a:z] == payload[64 * k : 64 * k + 64]


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=200), st.integers(0, 700), st.integers(0, 255))
def test_broken_bytes_give_a_reason(noise, at, value):
    box = bytearray(media.container(bytes(64 * 20)))
    box[at % len(box)] = value
    for data in (noise, bytes(box), bytes(box[: at % len(box)])):
        row = media.describe(data)
        assert row["error"] is None or row["codec"] is None


def test_other_tables():
    """64-bit box sizes and offsets, varying sizes, several chunk runs, no stss."""
    samples = [b"a" * 5, b"b" * 7, b"c", b"d" * 9]
    full = media.full
    def movie(base):
        offsets = [base, base + 12]
        return media.box(b"moov", media.box(b"trak", media.box(b"mdia", full(b"mdhd", bytes(8), struct.pack(">2I", 1000, 40)), media.box(b"minf", media.box(b"stbl",
            full(b"stsd", struct.pack(">I", 1), media.box(b"avc1", bytes(70))), full(b"stts", struct.pack(">5I", 2, 3, 10, 1, 12)), full(b"stsc", struct.pack(">4I", 1, 1, 2, 1)),
            full(b"stsz", struct.pack(">6I", 0, 4, 5, 7, 1, 9)), full(b"co64", struct.pack(">I2Q", 2, *offsets)))))))
    body = b"".join(samples)
    head = struct.pack(">I4sQ", 1, b"mdat", len(body) + 16)
    data = head + body + movie(16)
    row = media.describe(data)
    assert (row["codec"], row["timescale"], row["duration"], row["n_samples"]) == ("avc1", 1000, 40, 4)
    assert [data[k["start"] : k["end"]] for k in row["keyframes"]] == samples


def test_refuses_other_payloads():
    with pytest.raises(ValueError):
        media.container(b"abc")


def test_query(spark, tmp_path):
    rows = edge_rows()
    out = sorted(((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in media.op3_media_columns(spark, write_sf(spark, tmp_path, rows)).collect()), key=repr)
    want = []
    for i, t, *_ in rows:
        raw = (t or "").encode()
        p = raw + bytes(-len(raw) % 64 if raw else 64)
        want.append((i, len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])))
    assert out == sorted(want, key=repr)


def test_columns_of_null_bytes_and_clashing_names(spark):
    frame = spark.createDataFrame([(1, None), (2, bytearray(media.container(bytes(128))))], "media int, data binary")
    rows = {r.media: r.media_ for r in media.media_columns(frame, "data").collect()}
    assert rows[1].error == "no bytes" and rows[2].n_samples == 2
    assert media.media_columns(frame.limit(0), "data").collect() == []


def track(number, offsets, sizes, codec=b"avc1", wide=True, duration=40):
    n, full, box = len(sizes), media.full, media.box
    tables = [
        full(b"stsd", struct.pack(">I", 1), box(codec, bytes(70))), full(b"stts", struct.pack(">I", 1 if n else 0), struct.pack(">2I", n, 10) if n else b""), full(b"stsc", struct.pack(">I", 1 if n else 0), struct.pack(">3I", 1, 1, 1) if n else b""),
        full(b"stsz", struct.pack(">2I", 0, n), *(struct.pack(">I", s) for s in sizes)), full(b"co64" if wide else b"stco", struct.pack(">I", len(offsets)), *(struct.pack(">Q" if wide else ">I", o) for o in offsets)),
    ]
    return box(b"trak", full(b"tkhd", struct.pack(">5I", 0, 0, number, 0, 0), bytes(60)), box(b"mdia", full(b"mdhd", bytes(8), struct.pack(">2I", 1000, duration)), box(b"minf", box(b"stbl", *tables))))


def test_offsets_that_wrap_are_an_error():
    for offset in (1 << 63, (1 << 64) - 4, (1 << 63) - 2, 10_000):
        row = media.describe(media.box(b"moov", track(1, [offset], [4])))
        assert row["error"] == "a sample is outside the bytes" and row["tracks"] is None


def test_all_tracks_are_described():
    body = media.box(b"mdat", b"abcdefgh")
    data = body + media.box(b"moov", track(1, [8], [3]), track(7, [11, 14], [3, 2], b"mp4a", wide=False))
    row = media.describe(data)
    assert row["error"] is None and row["codec"] == "avc1" and [t["track_id"] for t in row["tracks"]] == [1, 7]
    assert [[data[k["start"] : k["end"]] for k in t["keyframes"]] for t in row["tracks"]] == [[b"abc"], [b"def", b"gh"]]


def test_fragments_add_their_samples():
    full, box = media.full, media.box

    def flagged(kind, flags, *parts):
        return box(kind, struct.pack(">I", flags), *parts)

    trex = full(b"trex", struct.pack(">5I", 1, 1, 20, 4, 0x10000))
    moov = box(b"moov", track(1, [], [], duration=0), track(2, [], [], b"mp4a", duration=0), box(b"mvex", trex, full(b"trex", struct.pack(">5I", 2, 1, 5, 3, 0))))

    def moof(one, two):
        first = box(b"traf", flagged(b"tfhd", 0x20000, struct.pack(">I", 1)), flagged(b"trun", 0x205, struct.pack(">IiI", 3, one, 0), struct.pack(">3I", 2, 4, 6)))
        second = box(b"traf", flagged(b"tfhd", 0x20008, struct.pack(">2I", 2, 7)), flagged(b"trun", 1, struct.pack(">Ii", 2, two)), flagged(b"trun", 0x400, struct.pack(">2I", 1, 0x10000)))
        return box(b"moof", full(b"mfhd", bytes(4)), first, second)

    size = len(moof(0, 0))
    data = moov + moof(size + 8, size + 20) + box(b"mdat", b"aabbbbccccccdddeeefff")
    video, audio = media.tracks(data)
    assert media.stored(data, video) == b"aabbbbcccccc" and media.stored(data, audio) == b"dddeeefff"
    assert (video.duration, audio.duration) == (60, 7 * 3) and video.durations.tolist() == [20, 20, 20]
    assert [data[a:z] for a, z in video.ranges().tolist()] == [b"aa"] and [data[a:z] for a, z in audio.ranges().tolist()] == [b"ddd", b"eee"]
    for at in range(len(data)):
        media.describe(data[:at] + b"\xff" + data[at + 1 :])
