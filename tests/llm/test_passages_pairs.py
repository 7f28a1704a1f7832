import random
from dataclasses import replace

import numpy as np
import pyarrow as pa

from seriesgrove.llm import passages, textops
from tests.llm.helpers import documents
from tests.llm.test_passages_seeds import spans, words


def scattered(rng, pieces, back):
    """The pieces among other words, in order or back to front."""
    return sum((piece + words(rng, 80) for piece in (pieces[::-1] if back else pieces)), words(rng, 80))


def test_a_text_between_the_first_and_the_last_is_met(spark):
    """The pieces of a fuzzy passage stand alone in the first text and in the one before; only one between them has the whole."""
    rng = random.Random(11)
    texts, want = [], {}
    for n_between in (1, 3, 6):
        passage = words(rng, 60)
        fuzzy = [w if at % 12 != 11 else words(rng, 1)[0] for at, w in enumerate(passage)]
        pieces = [passage[i : i + 11] for i in range(0, 60, 12)]
        texts += [scattered(rng, pieces, i % 2 == 1) for i in range(n_between)]
        texts += [words(rng, 30) + passage + words(rng, 30), scattered(rng, pieces, True), scattered(rng, pieces, False), words(rng, 20) + fuzzy + words(rng, 20)]
        want[len(texts) - 1] = (20, 79)
    found = spans(spark, texts)
    assert set(found) == set(want)
    for doc, (a, z) in want.items():
        assert len(found[doc]) == 1 and found[doc][0][0] <= a and found[doc][0][1] >= z


def test_an_equal_run_is_kept_where_its_chain_agrees_too_little(spark):
    rng = random.Random(12)
    run, tail = words(rng, 60), words(rng, 30)
    texts = [words(rng, 5) + run + words(rng, 60) + tail, words(rng, 9) + run + words(rng, 60) + tail]
    assert spans(spark, texts) == {1: [(9, 69)]}


def hashes(text):
    for b in textops.blocks(pa.array([" ".join(text)], pa.string())):
        starts, ends, _ = b.words()
        return textops.hash_words(b.data, starts, ends)


def test_no_word_that_any_pair_gives_is_lost(spark):
    """Against chains and alignments of all pairs of texts; words beyond the ends of a chain aside."""
    rng = random.Random(13)
    s = passages.Settings()
    pool = [[words(rng, rng.randrange(8, 25)) for _ in range(4)] for _ in range(3)]
    texts = []
    for i in range(45):
        text = words(rng, rng.randrange(0, 9))
        for _ in range(rng.randrange(1, 5)):
            chosen = rng.choice(pool)
            for piece in rng.sample(chosen, 4) if i % 3 else chosen:
                text += piece + words(rng, rng.choice((0, 1, 1, 2, 30)))
        texts.append(text)
    ids = [hashes(t) for t in texts]
    want = {i: set() for i in range(len(texts))}
    for i, x in enumerate(ids):
        for j, y in enumerate(ids[:i]):
            mine, theirs = (textops.windows(h, s.k) & passages.SEED for h in (x, y))
            m = passages.links(np.append(theirs, mine), np.append(np.zeros(len(theirs), np.int64), np.ones(len(mine), np.int64)), np.append(np.arange(len(theirs)), np.arange(len(mine)))).T
            if len(m):
                for part in passages.paths(passages.thinned(m[np.lexsort((m[:, 3], m[:, 2]))], s.k), s):
                    for f in passages.agreed(x, y, part, 0, 0, replace(s, reach=0)):
                        want[i].update(range(f[0], f[1]))
    got = {i: set() for i in range(len(texts))}
    for r in passages.shared_passages(documents(spark, [(i, " ".join(t), "en", "a", 0) for i, t in enumerate(texts)])).collect():
        got[r.doc].update(range(r.start, r.end))
    assert sum(map(len, want.values())) > 1000
    assert {i: sorted(want[i] - got[i]) for i in want if want[i] - got[i]} == {}
