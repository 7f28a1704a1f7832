import random

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from seriesgrove.llm import bpe, repetition, secrets
from tests.llm.helpers import DOCS, WORD, documents, edge_rows, plain_components, write_sf

pytest.importorskip("public_tokenizers")


def corpus():
    rng = random.Random(8)
    words = [f"{a}{b}" for a in ("tho", "ing", "er", "ea", "st", "wh") for b in ("re", "nd", "le", "an", "is", "ou")]
    rows = []
    for i in range(60):
        text = " ".join(rng.choice(words) + str(rng.randrange(100)) for _ in range(rng.randint(12, 80)))
        if i % 10 == 3:
            text += " token = abcdefghijklmnop0123"
        if i % 9 == 4:
            text = rows[-1][1]
        if i % 12 == 5:
            text = "too short"
        if i % 12 == 7:
            text = "one two three four five six " * 10
        rows.append((i, text, "en", f"s{i % 4}", len(text)))
    return [*rows, (70, None, None, None, None), (71, "", "en", "s1", 0)]


def test_stages_in_order(spark, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "secret_scan", "mix_sources", "bpe_encode"]
    docs = documents(spark, corpus()).selectExpr("*", "1 AS kept", "2 AS mix", "3 AS row_id")
    rows, names = docs, docs.columns
    kept = []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, rows, str(tmp_path))
        if i < 4:
            assert out.columns == names
        out.write.mode("overwrite").parquet(f"{tmp_path}/{name}")
        rows = spark.read.parquet(f"{tmp_path}/{name}")
        kept.append(rows.collect())
    texts = {i: t for i, t, *_ in corpus()}
    good = {i for i, t in texts.items() if repetition.measure(pa.array([t], pa.string()), repetition.Limits())["kept"][0]}
    assert {r.doc_id for r in kept[0]} == good
    parts = plain_components([(i, texts[i]) for i in good])
    assert sorted(r.doc_id for r in kept[1]) == sorted({c for _, c in parts.values()})
    for r in kept[2]:
        assert not secrets.Scanner().spans(r.text)[1] and r.n_chars == len(r.text)
    assert any("[SECRET]" in r.text for r in kept[2])
    clean = {r.doc_id: r.text for r in kept[2]}
    assert all(r.text in clean[r.doc_id] and r.n_chars == len(r.text) for r in kept[3])
    total = sum(len(WORD.findall(t)) for t in clean.values())
    assert abs(sum(len(WORD.findall(r.text)) for r in kept[3]) - 1.5 * total) < 0.02 * total + 4
    enc = bpe.encoder(bpe.word_bpe())
    want = sorted((r.doc_id, len(enc.raw(r.text))) for r in kept[3])
    assert sorted((r.doc_id, r.n_tokens) for r in kept[4]) == want


def test_run(spark, tmp_path):
    d = write_sf(spark, tmp_path, corpus())
    one, two = (sorted(map(tuple, corpus_pipeline.run(spark, d).collect())) for _ in range(2))
    assert one == two and one
    assert corpus_pipeline.ORACLE_SQL is None


def test_edges(spark, tmp_path):
    for rows in ([], edge_rows()):
        out = documents(spark, rows, DOCS)
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, out, str(tmp_path))
        assert np.isfinite(out.count())


def plain_redacted(text):
    """The text with each run of overlapping spans replaced once."""
    if not text:
        return text
    out, at, end = [], 0, 0
    for a, z, _ in sorted(secrets.Scanner().spans(text)[1]):
        if a >= end:
            out += [text[at:a], "[SECRET]"]
        end = max(end, z)
        at = end
    return "".join(out) + text[at:]


def plain_taken(docs):
    """(doc_id, text) of each row that the mix takes, from the SQL of the mix alone."""
    import duckdb
    import pandas as pd

    from seriesgrove.llm import mixing

    base = duckdb.connect()
    base.register("documents", pd.DataFrame(docs, columns=["doc_id", "text", "source"]))
    clip = "greatest(0, least(size, {} - before))".format
    ranges = f"{clip('first * block')} AS a, {clip('(first + extra) * block')} AS b, {clip('greatest(0, first + extra - blocks) * block')} AS c"
    sql = mixing.OP6_SQL.rsplit("SELECT doc_id, size, n AS source_size", 1)[0] + f"SELECT doc_id, rounds, {ranges} FROM y"
    texts = {i: t for i, t, _ in docs}
    for i, rounds, a, b, c in base.sql(sql).fetchall():
        words = list(WORD.finditer(texts[i] or ""))
        a, b, c = int(a), int(b), int(c)
        spans = [(0, c), (a, b)] if not (c and b > a and c == a) else [(0, b)]
        for lo, hi in [(0, len(words))] * int(rounds) + [s for s in spans if s[1] > s[0]]:
            if lo == 0 and hi == len(words):
                yield i, texts[i]
            else:
                yield i, texts[i][0 if lo == 0 else words[lo].start() : len(texts[i]) if hi == len(words) else words[hi - 1].end()]


def test_the_whole_run_matches_a_plain_version(spark, tmp_path):
    import hashlib

    rows = [r for r in corpus() if r[0] is not None]
    out = sorted(map(tuple, corpus_pipeline.run(spark, write_sf(spark, tmp_path, rows)).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()))
    texts = {i: t for i, t, *_ in rows}
    good = [i for i in texts if repetition.measure(pa.array([texts[i]], pa.string()), repetition.Limits())["kept"][0]]
    parts = plain_components([(i, texts[i]) for i in good])
    kept = [(i, plain_redacted(t), s) for i, t, _, s, _ in rows if i in parts and parts[i][1] == i]
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.word_bpe())
    want = []
    for i, t in plain_taken(kept):
        ids = library.encode(t, add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert out == sorted(want) and len(out) > 40
