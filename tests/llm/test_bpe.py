import hashlib
import random

import numpy as np
import pytest

from seriesgrove.llm import bpe
from tests.llm.helpers import DOCS, documents, edge_rows, write_sf

pytest.importorskip("public_tokenizers")
PIECES = ["the", "ing", " and ", " isn't ", "we're", "world" * 3, "aaaaaaaa", "''''s", "!!!'ll", "é́", "한국어", "가", "<|endoftext|>", "<|", "\n", " ", " ", "　", "ẞİſ", "ΣσςΟ", "中文字", "😀👩‍👩‍👧", "123", "²¼", "_", "Ǆǅǆ", "x" * 20]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.word_bpe())


@pytest.fixture(scope="module")
def enc():
    return bpe.encoder(bpe.word_bpe())


def texts(n, seed):
    rng = random.Random(seed)
    for _ in range(n):
        parts = [rng.choice(PIECES) if rng.random() < 0.7 else chr(rng.choice([rng.randrange(32, 0x250), rng.randrange(0x250, 0x3000)])) for _ in range(rng.choice([1, 5, 30, 150]))]
        yield "".join(parts)


def test_pieces_match_the_library(library, enc):
    for t in texts(800, 1):
        want = library.encode(t, add_special_tokens=False).ids
        got = bpe.unpack_ids(enc.piece(t))
        assert got == want, t
        assert enc.decode(got) == library.decode(want, skip_special_tokens=False)


def test_trees_match_the_library(library, enc):
    rng = random.Random(2)
    for t in texts(600, 3):
        t = t.replace(" ", "") if rng.random() < 0.4 else t
        want = library.encode(t, add_special_tokens=False).ids
        assert bpe.by_tree(enc, t, leaf=rng.choice([1, 3, 8, 40]), window=rng.choice([1, 2, 4, 16])).tolist() == want, t


def test_windows_grow_until_they_agree(enc):
    text = "a" * 3001
    calls = []
    bounds = [0, 1500, 3001]
    located = lambda a, z: (calls.append(z - a), enc.located(text[a:z], a))[1]
    out = bpe.concatenate([enc.located(text[:1500]), enc.located(text[1500:], 1500)], bounds, located, window=2)
    assert out[:, 0].tolist() == enc.raw(text)
    assert calls == sorted(calls) and len(calls) > 1


def test_halves():
    assert bpe.halves(5, 8) == [0, 5]
    b = bpe.halves(100, 8)
    assert len(b) == 17 and max(np.diff(b)) <= 8 and b[0] == 0 and b[-1] == 100


def test_query_and_edges(spark, tmp_path, library):
    rows = edge_rows()
    out = bpe.op2_bpe_encode(spark, write_sf(spark, tmp_path, rows))
    got = sorted(map(tuple, out.collect()), key=repr)
    want = []
    for i, t, *_ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and got == sorted(want, key=repr)


def test_cut_rows_keys_and_copies(spark, library):
    """Long rows with null keys, repeated rows and several keys."""
    text = next(t for t in texts(50, 9) if len(t) > 200)
    docs = documents(spark, [(1, text, "en", None, 1), (1, text, "en", None, 1), (None, text, "de", "b", 1), (2, "", None, None, None)]).selectExpr("*", "1 AS ids", "2 AS n_tokens")
    out = bpe.encode(docs, bpe.word_bpe(), keys=("doc_id", "lang"), long=50, leaf=16).collect()
    n = len(library.encode(text, add_special_tokens=False).ids)
    assert sorted(((r.doc_id, r.lang, r.n_tokens) for r in out), key=repr) == sorted([(1, "en", n), (1, "en", n), (None, "de", n), (2, None, 0)], key=repr)
    assert bpe.encode(documents(spark, [], DOCS), bpe.word_bpe()).collect() == []
