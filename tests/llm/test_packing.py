import bisect
import random

import numpy as np

from seriesgrove.llm import bpe, packing
from tests.llm.helpers import edge_rows, write_sf


def plain_best_fit(lengths, length):
    rows, room = [], []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        fits = [(left, -k) for k, left in enumerate(room) if left >= lengths[i]]
        if fits:
            left = min(fits)[0]
            k = next(k for k in range(len(room)) if room[k] == left)
        else:
            rows.append([])
            room.append(length)
            k = len(rows) - 1
        rows[k].append(i)
        room[k] -= lengths[i]
    return rows


def test_rows_are_those_of_best_fit_decreasing():
    rng = random.Random(1)
    for length in (1, 7, 64, 100):
        for _ in range(60):
            lengths = [rng.randint(1, length) for _ in range(rng.randrange(0, 80))]
            got, want = packing.best_fit(lengths, length), plain_best_fit(lengths, length)
            assert sorted(i for r in got for i in r) == list(range(len(lengths)))
            used = lambda rows: sorted(sum(lengths[i] for i in r) for r in rows)  # noqa: E731,B023
            assert used(got) == used(want)


def test_tree_finds_the_least_room():
    rng = random.Random(2)
    room, held = packing.Room(50), []
    for step in range(3000):
        if rng.random() < 0.5:
            r = rng.randint(0, 50)
            room.put(r, step)
            bisect.insort(held, r)
        else:
            least = rng.randint(0, 50)
            at = bisect.bisect_left(held, least)
            got = room.take(least)
            assert (got is None) == (at == len(held))
            if got:
                assert got[0] == held.pop(at)


def unpack(rows, length):
    parts = {}
    for r in rows:
        ids, places = np.frombuffer(r.ids, "<u4"), np.frombuffer(r.positions, "<u4")
        assert len(ids) == len(places) == length and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens <= length
        assert not ids[r.n_tokens :].any()
        for doc, at, total, a, z in zip(r.doc_ids, r.piece_starts, r.doc_tokens, r.cu_seqlens[:-1], r.cu_seqlens[1:], strict=True):
            assert places[a:z].tolist() == list(range(z - a))
            parts.setdefault((doc, total), []).append((at, ids[a:z].tolist()))
    return parts


def test_packing_loses_nothing(spark):
    rng = np.random.default_rng(3)
    docs = {i: rng.integers(1, 49000, rng.choice([0, 1, 5, 31, 32, 33, 64, 200])).astype("<u4") for i in range(200)}
    frame = spark.createDataFrame([(i, bytearray(x.tobytes()), i) for i, x in docs.items()], "doc_id bigint, ids binary, positions int")
    parts = unpack(packing.pack_tokens(frame, length=32, pool=1000).collect(), 32)
    got = {doc: sum((p for _, p in sorted(found)), []) for (doc, _), found in parts.items()}
    assert got == {i: x.tolist() for i, x in docs.items() if len(x)}


def test_query_and_edges(spark, tmp_path):
    rows = edge_rows()
    parts = unpack(packing.op7_pack_tokens(spark, write_sf(spark, tmp_path, rows)).collect(), packing.LENGTH)
    enc = bpe.encoder(bpe.word_bpe())
    want = sorted(len(enc.raw(t)) for _, t, *_ in rows if t and enc.raw(t))
    assert sum(len(p) for found in parts.values() for _, p in found) == sum(want)
    empty = spark.createDataFrame([(1, None), (2, bytearray())], "doc_id bigint, ids binary")
    assert packing.pack_tokens(empty).collect() == [] and packing.pack_tokens(empty.limit(0)).collect() == []


def test_every_pool_is_packed_as_plain_best_fit_would(spark):
    """Rows of the operator against a plain packing of the same documents, pool by pool."""
    rng = np.random.default_rng(8)
    docs = [(i, rng.integers(1, 49000, int(n)).astype("<u4")) for i, n in enumerate(rng.choice([0, 3, 17, 40, 64, 65, 130, 500], 300))]
    frame = spark.createDataFrame([(i, bytearray(x.tobytes())) for i, x in docs], "doc_id bigint, ids binary").coalesce(1)
    got = sorted(r.n_tokens for r in packing.pack_tokens(frame, length=64, pool=4000).collect())
    want, pool, held = [], [], 0
    for _, x in docs:
        pool += [min(64, len(x) - at) for at in range(0, len(x), 64)]
        held += len(x)
        if held >= 4000:
            want += [sum(pool[i] for i in row) for row in plain_best_fit(pool, 64)]
            pool, held = [], 0
    want += [sum(pool[i] for i in row) for row in plain_best_fit(pool, 64)]
    assert got == sorted(want)
