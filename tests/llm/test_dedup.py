import random

import numpy as np

from seriesgrove.llm import dedup
from seriesgrove.llm.lineage import components
from tests.llm.helpers import DOCS, documents, edge_rows, plain_components, shingle_set, write_sf


def near_copies(seed=3, bases=6, copies=14, words=60):
    """Texts at all similarities around the threshold, and small sets."""
    rng = random.Random(seed)
    rows = []
    for b in range(bases):
        base = [f"t{b}w{i}" for i in range(rng.choice([4, 5, 7, 9, 20, words]))]
        for _ in range(copies):
            text = list(base)
            for _ in range(rng.randrange(0, max(2, len(text) // 9))):
                text[rng.randrange(len(text))] = f"x{rng.randrange(10**6)}"
            if rng.random() < 0.3:
                text = text[: -1 - rng.randrange(max(1, len(text) // 5))]
            sep = rng.choice([" ", "\n", "  "])
            rows.append((len(rows) + 1, sep.join(w.upper() if rng.random() < 0.2 else w for w in text)))
    rng.shuffle(rows)
    return rows


def test_components_match_all_pairs(spark, tmp_path):
    rows = near_copies()
    d = write_sf(spark, tmp_path, [(i, t, "en", "a", len(t)) for i, t in rows])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in dedup.op9_near_dedup(spark, d).collect()}
    assert got == plain_components(rows)


def test_blocks_within_a_bucket_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(dedup, "BLOCK", 3)
    rows = near_copies(seed=5, bases=3, copies=30, words=40)
    docs = documents(spark, [(i, t, "en", "a", 0) for i, t in rows])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in dedup.near_duplicates(docs).collect()}
    assert got == plain_components(rows)


def test_sketches_estimate_similarity():
    rng = np.random.default_rng(1)
    for j in (0.2, 0.75, 0.9):
        n = 4000
        both = int(2 * n * j / (1 + j))
        x = np.unique(rng.integers(0, 1 << 63, 2 * n - both).astype(np.uint64) * np.uint64(2) + np.uint64(1))
        a, b = np.sort(rng.permutation(x)[:n]), None
        shared = rng.permutation(a)[:both]
        b = np.unique(np.concatenate([shared, np.setdiff1d(x, a)[: n - both]]))
        equal = (dedup.sketch(a).view("<u2") == dedup.sketch(b).view("<u2")).mean()
        c = dedup.chance(n)
        assert abs((equal - c) / (1 - c) - j) < 4.5 * (j * (1 - j) / 128) ** 0.5 + 0.01
        sizes = np.array([len(b)])
        assert dedup.finely_possible(dedup.fine_sketch(a), dedup.fine_sketch(b)[None], len(a), sizes)[0] == (j > 0.5)


def test_small_sets_share_bands():
    rng = np.random.default_rng(2)
    missed = 0
    for _ in range(300):
        x = np.sort(rng.integers(1, 1 << 63, 4).astype(np.uint64) * np.uint64(2))
        y = np.delete(x, rng.integers(4))
        missed += not (dedup.sketch(x) == dedup.sketch(y)).any()
    assert missed == 0


def test_chance_is_that_of_unrelated_sets():
    rng = np.random.default_rng(3)
    n, equal = 1000, []
    for _ in range(60):
        a, b = (np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64) << np.uint64(1)) for _ in range(2))
        equal.append((dedup.sketch(a).view("<u2") == dedup.sketch(b).view("<u2")).mean())
    assert abs(np.mean(equal) - dedup.chance(n)) < 0.0015


def test_connected_components(spark):
    edges = [(i + 1, i) for i in range(1, 40)] + [(100, 101), (101, 102), (103, 102), (7, 7), (100, 101)] + [(200, i) for i in range(201, 230)]
    got = dict(components(spark.createDataFrame(edges, "u bigint, v bigint")).collect())
    assert got == {**{i: 1 for i in range(1, 41)}, **{i: 100 for i in range(100, 104)}, **{i: 200 for i in range(200, 230)}}
    assert components(spark.createDataFrame([], "u bigint, v bigint")).collect() == []


def test_edges(spark, tmp_path):
    rows = edge_rows()
    out = dedup.op9_near_dedup(spark, write_sf(spark, tmp_path, rows)).collect()
    assert len(out) == len(rows)
    by = {}
    for r in out:
        by.setdefault(r.doc_id, []).append(r)
    for i in (1, 2, 3):
        assert (by[i][0].n_shingles, by[i][0].component_id, by[i][0].kept) == (0, i, True)
    assert {r.component_id for i in (4, 5) for r in by[i]} == {4} and not by[5][0].kept
    assert by[9][0].component_id == 8
    assert sorted(((r.component_id, r.kept) for r in by[None]), key=repr) == [(4, False), (None, True)]
    assert dedup.near_duplicates(documents(spark, [], DOCS)).collect() == []


def test_keep_one(spark):
    docs = documents(spark, edge_rows()).selectExpr("*", "7 AS kept", "8 AS row_id", "9 AS component_id")
    kept = dedup.keep_one(docs)
    assert kept.columns == docs.columns
    rows = kept.collect()
    assert sorted((r.doc_id for r in rows), key=repr) == [1, 2, 3, 4, 6, 7, 8, None]
    assert [r.text for r in rows if r.doc_id is None] == [None]
    sets = [shingle_set(r.text) for r in rows if shingle_set(r.text)]
    assert all(100 * len(a & b) < 75 * len(a | b) for i, a in enumerate(sets) for b in sets[:i])
