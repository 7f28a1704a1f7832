"""What is done for many texts at once gives what is done one by one, and shuffles do not outlive their step."""

import random
import time
from pathlib import Path

import numpy as np

from seriesgrove.llm import passages
from tests.llm.helpers import documents
from tests.llm.test_passages_seeds import words


def shuffle_files(spark):
    folders = spark._jsc.sc().env().blockManager().diskBlockManager().localDirs()
    return {f.name for folder in folders for f in Path(folder.getPath()).rglob("shuffle_*")}


def test_shuffles_of_seeds_and_links_are_gone_after_their_step(spark):
    """They are most of the disk that the query takes; the JVM's collector may leave them to the end."""
    rng = random.Random(21)
    shared = words(rng, 60)
    docs = documents(spark, [(i, " ".join(words(rng, 30) + shared + words(rng, 30)), "en", "a", 0) for i in range(20)])
    rows = docs.selectExpr("doc_id AS doc", "text")
    before = shuffle_files(spark)
    chains = passages.all_chains(rows, passages.Settings())
    end = time.time() + 5
    while shuffle_files(spark) - before and time.time() < end:  # other hosts are told, not waited for
        time.sleep(0.1)
    assert shuffle_files(spark) - before == set()
    assert chains.count() == 20


def test_order_is_that_of_lexsort():
    rng = np.random.default_rng(22)
    for columns in ([rng.integers(0, 9, 4000), rng.integers(-5, 5, 4000), rng.integers(0, 7, 4000)], [rng.integers(-(1 << 63), 1 << 63, 700), rng.integers(-(1 << 62), 1 << 62, 700)], [rng.integers(0, 3, 20)]):
        rows = np.stack(columns)
        assert (rows[:, passages.order(*columns)] == rows[:, np.lexsort(columns[::-1])]).all()


def longest(x, y):
    row = [0] * (len(y) + 1)
    for v in x:
        new = [0]
        for j, w in enumerate(y):
            new.append(row[j] + 1 if v == w else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


def test_equal_words_are_a_longest_common_subsequence():
    rng = np.random.default_rng(23)
    for _ in range(300):
        x, y = rng.integers(0, 6, rng.integers(0, 90)).astype(np.uint64), rng.integers(0, 6, rng.integers(0, 90)).astype(np.uint64)
        assert passages.equal_words(x, y) == longest(x.tolist(), y.tolist())


def test_chains_and_passages_of_many_pairs_are_those_of_each():
    rng, s = np.random.default_rng(24), passages.Settings()
    texts, pairs = [], []
    for i in range(120):
        y = rng.integers(0, 1 << 40, 400).astype(np.uint64) if i % 3 else rng.integers(0, 2, 150).astype(np.uint64)
        x = y[int(rng.integers(0, 100)) :].copy()
        for _ in range(int(rng.integers(0, 60))):
            at, n = int(rng.integers(0, len(x))), int(rng.integers(0, 4))
            x = np.concatenate([x[:at], rng.integers(0, 1 << 40, n).astype(np.uint64), x[at + int(rng.integers(0, 4)) :]])
        texts += [x, y]
        seeds = [passages.textops.windows(t, s.k) & passages.SEED for t in (x, y)]
        m = passages.met(*seeds, {}, 0)
        want = passages.links(np.append(seeds[1], seeds[0]), np.repeat([0, 1], [len(seeds[1]), len(seeds[0])]), np.append(np.arange(len(seeds[1])), np.arange(len(seeds[0]))))
        assert sorted(map(tuple, m.tolist())) == sorted(map(tuple, want[2:].T.tolist()))
        pairs.append(passages.thinned(np.insert(m, [0, 0], [i, 7], axis=1), s.k))
    owners, others, sizes, m = passages.all_paths(np.concatenate(pairs), s)
    cuts = np.split(m, np.cumsum(sizes)[:-1])
    want = [(i, p.tolist()) for i, own in enumerate(pairs) if len(own) for p in passages.paths(own, s)]
    assert set(others.tolist()) == {7} and sorted((int(i), c.tolist()) for i, c in zip(owners, cuts, strict=True)) == sorted(want)
    begin = np.cumsum([0, *map(len, texts)])
    of, at = np.repeat(np.arange(len(owners)), sizes), 2 * owners
    found = passages.passages_in(flat := np.concatenate(texts), flat, of, m[:, 0] + begin[at][of], m[:, 1] + begin[at + 1][of], (begin[at], begin[at + 1], begin[at + 1], begin[at + 2]), s)
    got = sorted((int(c), *(f - begin[2 * owners[c] + np.array([0, 0, 1, 1])]).tolist(), int(n)) for c, *f, n in zip(found[0], *found[1], strict=True))
    want = sorted((c, *map(int, f)) for c, own in enumerate(cuts) for f in passages.agreed(texts[2 * owners[c]], texts[2 * owners[c] + 1], own, 0, 0, s))
    assert got == want and len(want) > 200


def test_a_text_that_repeats_itself_has_one_row_a_key():
    n = np.arange(60)
    of, key, held = passages.spots(n // 30, 0 * n + 5, n % 30 // 2, n)
    assert of.tolist() == [0, 1] and key.tolist() == [5, 5]
    assert [[(x["step"], x["room"]) for x in row] for row in held.to_pylist()] == [[(i, 30 * d + 2 * i + 1) for i in range(15)] for d in (0, 1)]


def test_keys_that_the_same_texts_have_are_joined_as_one(spark):
    at = lambda step, room=40: [(step, room)]
    asked = spark.createDataFrame([(9, k, at(20 + k)) for k in range(1, 11)] + [(9, 11, at(20)), (9, 12, at(20)), (8, 3, at(30)), (8, 13, at(7))], f"doc bigint, key bigint, spots {passages.SPOTS}")
    held = [(other, k, at(20 + k + other)) for k in range(1, 11) for other in range(1, 5)] + [(1, 11, at(20))] + [(o, 12, at(21 - o)) for o in range(1, 5)] + [(o, 13, at(20 + o, 41)) for o in range(1, 5)]
    one, carriers = passages.merged(asked, spark.createDataFrame(held, f"other bigint, key bigint, other_spots {passages.SPOTS}"))
    assert sorted((r.doc, r.key, [tuple(x) for x in r.spots]) for r in one.collect()) == [(8, 1, at(6)), (8, 13, at(-14)), (9, 1, at(-1)), (9, 11, at(0)), (9, 12, at(3))]
    assert sorted((r.key, r.other, *r.other_spots[0]) for r in carriers.collect()) == [(1, o, o - 1, 40) for o in range(1, 5)] + [(11, 1, 0, 40)] + [(12, o, 4 - o, 40) for o in range(1, 5)] + [(13, o, o - 1, 41) for o in range(1, 5)]
