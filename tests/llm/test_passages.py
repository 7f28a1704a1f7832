import random

import numpy as np
import pytest

from seriesgrove.llm import passages
from tests.llm.helpers import DOCS, documents, edge_rows


def test_fenwick_chains_score_as_all_pairs_do():
    rng = random.Random(1)
    for _ in range(200):
        found = sorted({(rng.randrange(60), rng.randrange(60)) for _ in range(rng.randrange(1, 40))})
        a, b = (np.array(x) for x in zip(*found, strict=True))
        out = passages.chain(a, b, 8, 0.1)
        assert sorted(i for c in out for i in c) == list(range(len(a)))
        for c in out:
            assert (np.diff(a[c]) > 0).all() and (np.diff(b[c]) > 0).all()
        f = []
        for i in range(len(a)):
            f.append(8 + max([0.0, *(f[j] - 0.1 * (a[i] - a[j] + b[i] - b[j]) for j in range(i) if a[j] < a[i] and b[j] < b[i])]))
        c = out[0]
        assert 8 * len(c) - 0.1 * (a[c[-1]] - a[c[0]] + b[c[-1]] - b[c[0]]) == pytest.approx(max(f))


def test_chains_are_cut_at_wide_gaps():
    rows = np.array([(1, 2, a, a + 5) for a in (0, 10, 20, 200, 210)])
    assert [len(x) for x in passages.apart(rows, 72)] == [3, 2]


def test_every_long_run_has_a_seed():
    rng = np.random.default_rng(2)
    h = rng.integers(0, 1 << 62, 500).astype(np.uint64)
    at = passages.minimizers(h, 16)
    assert np.diff(np.concatenate([[-1], at, [500]])).max() <= 16
    run = h[100:140]
    other = np.concatenate([rng.integers(0, 1 << 62, 77).astype(np.uint64), run, rng.integers(0, 1 << 62, 50).astype(np.uint64)])
    assert set(h[at].tolist()) & set(other[passages.minimizers(other, 16)].tolist()) & set(run.tolist())


def test_alignment():
    words = np.arange(100, 300).astype(np.uint64)
    y = np.concatenate([np.arange(40), words, np.arange(50)]).astype(np.uint64)
    x = words.copy()
    x[60], x[120] = 1, 2
    s = passages.Settings()
    matches = np.array([(10, 50), (70, 110), (130, 170)])
    assert passages.align(x, y, matches, 0, 0, s) == (0, 200, 40, 240, 198)
    assert passages.equal_words(np.array([1, 2, 3, 4]), np.array([1, 3, 4, 5])) == 3


def planted(spark, seed=5):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    shared, fuzzy = [word() for _ in range(60)], [word() for _ in range(120)]
    rows, want = [], {}
    for i in range(30):
        body = [word() for _ in range(rng.randint(80, 200))]
        if i % 5 == 0:
            at = rng.randrange(len(body))
            body[at:at] = shared
            want[i] = (at, at + 60)
        elif i % 5 == 1:
            text = [w if rng.random() > 0.03 else word() for w in fuzzy]
            at = rng.randrange(len(body))
            body[at:at] = text
            want[i] = (at, at + 120)
        rows.append((i, " ".join(body), "en", "a", 0))
    return documents(spark, rows), want


def test_planted_passages_are_found_and_others_left_alone(spark):
    docs, want = planted(spark)
    out = passages.repeated_passages(docs).collect()
    found = {}
    for r in out:
        found.setdefault(r.doc_id, []).append((r.start_word, r.end_word))
        assert set(r.other_ids) <= set(want) and min(r.other_ids) < r.doc_id
    assert set(found) == set(want) - {0, 1}
    for i, spans in found.items():
        a, z = want[i]
        covered = sum(max(0, min(z, y) - max(a, x)) for x, y in spans)
        assert covered >= 0.9 * (z - a) and all(x >= a - 3 and y <= z + 3 for x, y in spans)
    assert any(0 in r.other_ids for r in out) and any(1 in r.other_ids for r in out)


def test_edges(spark):
    docs = documents(spark, edge_rows()).selectExpr("*", "1 AS doc", "2 AS seed", "3 AS at")
    long = " ".join(f"w{i}" for i in range(70))
    more = docs.unionByName(documents(spark, [(50, long, "en", "a", 0), (51, "x " + long, "en", "a", 0), (51, "x " + long, "en", "a", 0)]), allowMissingColumns=True)
    out = passages.repeated_passages(more).collect()
    assert [(r.doc_id, r.start_word, r.end_word, r.other_ids) for r in out] == [(51, 1, 71, [50])]
    assert passages.repeated_passages(documents(spark, [], DOCS)).collect() == []
