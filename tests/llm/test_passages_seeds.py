import random

import numpy as np

from seriesgrove.llm import passages
from tests.llm.helpers import documents


def words(rng, n):
    return ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n)]


def spans(spark, texts):
    """doc -> (start, end) of its passages."""
    out = {}
    for r in passages.repeated_passages(documents(spark, [(i, " ".join(t), "en", "a", 0) for i, t in enumerate(texts)])).collect():
        out.setdefault(r.doc_id, []).append((r.start_word, r.end_word))
    return out


def test_a_passage_with_one_word_in_twelve_changed_is_found(spark):
    rng = random.Random(7)
    texts = []
    for i in range(40):
        passage = words(rng, 60)
        fuzzy = [w if at % 12 != 11 else words(rng, 1)[0] for at, w in enumerate(passage)]
        texts += [words(rng, 30) + passage + words(rng, 30), words(rng, 20) + fuzzy + words(rng, 20)]
    found = spans(spark, texts)
    assert set(found) == set(range(1, 80, 2))
    assert all(a <= 21 and z >= 78 for (a, z), *_ in found.values())


def test_dealt_columns_come_back():
    rng = np.random.default_rng(3)
    seeds = rng.integers(0, 1 << 64, 3000, dtype=np.uint64)
    docs, at = rng.integers(-(1 << 62), 1 << 62, 3000), rng.integers(0, 900, 3000)
    bucket = (seeds >> np.uint64(52)).astype(np.int32)
    got = [(s, *c) for own, columns in passages.dealt(passages.deal(bucket, [docs, at], seeds)) for s, c in zip(own.tolist(), columns.T.tolist(), strict=True)]
    assert sorted(got) == sorted(zip(seeds.tolist(), docs.tolist(), at.tolist(), strict=True))


def test_runs_are_thinned_without_a_gap():
    run = np.array([(1, 0, a, a + 5) for a in range(30)] + [(1, 0, 50, 90), (2, 0, 3, 3)])
    assert passages.thinned(run, 8)[:, 2].tolist() == [0, 8, 16, 24, 29, 50, 3]


def test_texts_are_linked_where_an_older_one_holds_a_part(spark):
    rng = random.Random(8)
    texts = []
    for held in (40, 45, 49, 52) * 5:
        passage = words(rng, 60)
        texts += [words(rng, 20) + passage[:held] + words(rng, 20), words(rng, 10) + passage + words(rng, 20), words(rng, 30) + passage + words(rng, 10)]
    found = spans(spark, texts)
    for a in range(0, len(texts), 3):
        assert found[a + 2] == [(30, 90)]


def test_a_seed_links_with_its_first_text_and_the_one_before():
    seeds = np.array([5, 5, 5, 5, 9, 7], np.uint64)
    out = passages.links(seeds, np.array([1, 4, 3, 3, 3, 2]), np.array([10, 40, 30, 35, 0, 0]))
    assert sorted(out.T.tolist()) == [[3, 1, 30, 10], [3, 1, 35, 10], [4, 1, 40, 10], [4, 3, 40, 30]]


def test_places_of_a_repeated_seed_meet_in_turn():
    seeds = np.array([5] * 7, np.uint64)
    out = passages.links(seeds, np.array([1, 1, 2, 2, 2, 2, 2]), np.array([10, 11, 20, 21, 22, 23, 24]))
    assert sorted(out.T.tolist()) == [[2, 1, 20, 10], [2, 1, 21, 11], [2, 1, 22, 10], [2, 1, 23, 11], [2, 1, 24, 10]]


def test_texts_that_repeat_themselves_are_found_whole(spark):
    rng = random.Random(9)
    line = words(rng, 12)
    texts = [words(rng, 20) + line * 9 + words(rng, 5), words(rng, 7) + line * 11 + words(rng, 9), ["of"] * 90, words(rng, 30) + ["of"] * 300]
    found = spans(spark, texts)
    assert found == {1: [(7, 7 + 132)], 3: [(30, 330)]}


def test_matches_whose_words_differ_do_not_count():
    s = passages.Settings()
    x, y = np.arange(100, 200).astype(np.uint64), np.arange(500, 600).astype(np.uint64)
    y[40:60] = x[20:40]
    assert passages.align(x, y, np.array([(2, 2), (20, 40), (28, 48)]), 0, 0, s) == (20, 40, 40, 60, 20)
    assert passages.align(x, y, np.array([(2, 2)]), 0, 0, s)[4] == 0


def test_the_query_finds_what_all_pairs_of_runs_give(spark, tmp_path):
    """Against a brute-force version: maximal exact runs of 50 words or more between any two texts."""
    from tests.llm.helpers import write_sf

    rng = random.Random(10)
    pool = [words(rng, n) for n in (50, 55, 64, 80)]
    texts = [words(rng, rng.randrange(5, 60)) + (pool[i % 4] if i % 3 else []) + words(rng, rng.randrange(5, 60)) + (pool[(i + 1) % 4] if i % 5 == 0 else []) for i in range(36)]
    want = {}
    for i, x in enumerate(texts):
        marked = set()
        for y in texts[:i]:
            at = {}
            for b in range(len(y) - 7):
                at.setdefault(tuple(y[b : b + 8]), []).append(b)
            for a in range(len(x) - 7):
                for b in at.get(tuple(x[a : a + 8]), []):
                    n = 8
                    while a + n < len(x) and b + n < len(y) and x[a + n] == y[b + n]:
                        n += 1
                    marked.update(range(a, a + n))
        runs, begin = [], None
        for w in range(len(x) + 1):
            if w in marked and begin is None:
                begin = w
            if w not in marked and begin is not None:
                if w - begin >= 50:
                    runs.append((begin, w))
                begin = None
        if runs:
            want[i] = runs
    rows = [(i, " ".join(t), "en", "a", 0) for i, t in enumerate(texts)]
    got = {}
    for r in passages.op5_shared_passages(spark, write_sf(spark, tmp_path, rows)).collect():
        got.setdefault(r.doc_id, []).append((r.start_word, r.end_word))
    assert {i: sorted(v) for i, v in got.items()} == want
