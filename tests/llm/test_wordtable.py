import random

import numpy as np
import pyarrow as pa
import pytest

from seriesgrove.llm import bpe, textops, wordtable

pytest.importorskip("public_tokenizers")


def encoded(enc, texts):
    return [ids[a:z].tolist() for _, ids, bounds in enc.pieces(pa.array(texts, pa.string())) for a, z in zip(bounds, bounds[1:], strict=False)]


def some_texts(n, seed):
    rng = random.Random(seed)
    stems = ["straße", "Émile", "İstanbul", "don't", "we'll", "x1y2", "***", "H̱", "ǰ", "the", "END", "a" * 200, "<|endoftext|>", "co-op", "''s", "ÀÉÞß×÷"]
    return [" ".join(rng.choice(stems) + rng.choice(["", ".", ",", str(rng.randrange(50)), rng.choice(stems)]) for _ in range(rng.randrange(0, 60))) for _ in range(n)]


def test_blocks_match_the_library_whatever_is_held():
    enc = bpe.Encoder(bpe.word_bpe(), kept=20_000)
    texts = some_texts(400, 1)
    want = [enc.raw(t) for t in texts]
    turns = 0
    for _ in range(3):
        for lo in range(0, len(texts), 40):
            before = enc.table.young
            assert encoded(enc, texts[lo : lo + 40]) == want[lo : lo + 40]
            turns += enc.table.young is not before
    assert turns > 2 and enc.table.young.size + enc.table.old.size < 60_000


def test_clashing_hashes_change_nothing(monkeypatch):
    monkeypatch.setattr(textops, "hash_words", lambda data, starts, ends, lower=False: data[starts].astype(np.uint64) % np.uint64(3))
    enc = bpe.Encoder(bpe.word_bpe())
    texts = some_texts(60, 2)
    for lo in range(0, 60, 7):
        assert encoded(enc, texts[lo : lo + 7]) == [enc.raw(t) for t in texts[lo : lo + 7]]


def test_decoding_all_is_decoding_each():
    enc = bpe.Encoder(bpe.word_bpe())
    for _, ids, bounds in enc.pieces(pa.array([*some_texts(50, 3), "", " "], pa.string())):
        assert enc.decode_all(ids, bounds).to_pylist() == [enc.tokenizer.decode(ids[a:z].tolist(), skip_special_tokens=False) for a, z in zip(bounds, bounds[1:], strict=False)]


def test_pool_and_ragged():
    pool = wordtable.Pool(np.uint8)
    rng = np.random.default_rng(1)
    want = [rng.integers(0, 255, rng.integers(0, 400)).astype(np.uint8) for _ in range(3000)]
    for lo in range(0, 3000, 100):
        some = want[lo : lo + 100]
        pool.add(np.concatenate(some), np.array([len(x) for x in some]))
    at = rng.permutation(3000)[:500]
    data, lengths = pool.take(at)
    assert data.tolist() == np.concatenate([want[i] for i in at]).tolist() and lengths.tolist() == [len(want[i]) for i in at]
