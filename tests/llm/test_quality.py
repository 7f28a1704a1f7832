import math
import random
from collections import Counter

import pyarrow as pa
import pytest

from seriesgrove.llm import quality, textops
from tests.llm.helpers import documents, edge_rows, write_sf

LABELS = "doc_id bigint, quality int, toxic int"


def codes(text):
    points = [quality.EDGE] * 3 + [min(ord(c), quality.REST) for c in text]
    return [tuple(points[i : i + 4]) for i in range(len(text))]


def number(g):
    """The signed 64-bit integer of an n-gram."""
    n = sum(c << 16 * i for i, c in enumerate(reversed(g)))
    return n - (1 << 64) if n >= 1 << 63 else n


def test_grams_match_the_plain_version():
    texts = ["", "a", "Ab é", "x\n\n中😀!", None, "hello world, 123", "\uffff\ufffe豈 \u8000"]
    for limit in (1, 8, 1000):
        got = []
        for b in textops.blocks(pa.array(texts), limit):
            code, first = quality.grams(b)
            got += [code[a:z].tolist() for a, z in zip(first, first[1:], strict=False)]
        assert got == [[number(g) for g in codes(t or "")] for t in texts]


def plain_model(texts):
    """Interpolated modified Kneser-Ney over 4-grams of characters, by dictionaries."""
    counts = [None, None, None, Counter(g for t in texts for g in codes(t))]
    for n in (2, 1, 0):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    d = [quality.discounts([sum(v == i for v in c.values()) for i in (1, 2, 3, 4)]) for c in counts]
    rows = [{} for _ in counts]
    for c, of in zip(counts, rows, strict=True):
        for g, v in c.items():
            of.setdefault(g[:-1], {})[g] = v

    def p(g):
        if not g:
            return 1 / (len(counts[0]) + 1)
        own = rows[len(g) - 1].get(g[:-1])
        lower = p(g[1:])
        if not own:
            return lower
        cut = lambda v: d[len(g) - 1][min(v, 3) - 1]
        total = sum(own.values())
        return (max(0, own[g] - cut(own[g])) / total if g in own else 0) + sum(map(cut, own.values())) / total * lower

    return p


def test_probabilities_match_the_plain_model(spark):
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["the", "cat", "sat", "on", "a", "mät", "猫\ufffd"]) for _ in range(rng.randint(1, 12))) + "." for _ in range(30)]
    model = quality.kneser_ney(quality.count_grams(spark.createDataFrame([(t,) for t in texts], "text string")))
    p = plain_model(texts)
    seen = list({g for t in texts for g in codes(t)})
    letters = sorted({c for g in seen for c in g} - {0}) + [ord("Q")]  # Q stands for all that were never seen
    asked = {*seen, *((*g[:3], c) for g in seen[:40] for c in letters), *((ord("Q"), ord("x"), ord("a"), c) for c in letters)}
    frame = spark.createDataFrame([(number(g),) for g in asked], "code bigint")
    got = {r.code: r.p for r in quality.probabilities(frame, model).collect()}
    assert len(got) == len(asked)
    for g in asked:
        assert got[number(g)] == pytest.approx(p(g), rel=1e-9)
    for g in seen[:40]:
        assert sum(got[number((*g[:3], c))] for c in letters) == pytest.approx(1)


def corpus(n=240, seed=4):
    rng = random.Random(seed)
    words = {"en": ["the", "cat", "ing", "and", "ouse", "ther", "of"], "de": ["der", "und", "sch", "keit", "über", "ein"]}
    rows, labels, good = [], [], {}
    for i in range(n):
        lang = rng.choice(["en", "de"])
        text = " ".join("".join(rng.choice(words[lang]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(20, 90))) + "."
        junk = i % 8 == 0
        if junk:
            text = rng.choice([text.upper().replace(" ", "!! "), " ".join(w + rng.choice(["***", "###", "%%%"]) for w in text.split())])
        rows.append((i, text, lang, "a", len(text)))
        good[i] = not junk
        if rng.random() < 0.5:
            labels.append((i, int(not junk), 0))
    return rows, labels, good


def test_held_out_documents_are_told_apart(spark):
    rows, labels, good = corpus()
    known = {i for i, *_ in labels}
    out = quality.classify(documents(spark, rows), spark.createDataFrame(labels, LABELS)).collect()
    assert len(out) == len(rows)
    held = [r for r in out if r.doc_id not in known]
    assert all(r.kept == good[r.doc_id] for r in held)


def test_the_query_matches_a_plain_version(spark, tmp_path):
    """Perplexities, thresholds and decisions of the whole query, from dictionaries."""
    rows, labels, _ = corpus(640, seed=11)
    rows += [(900, None, "en", "a", 0), (901, "", "fr", "a", 0), (902, "the cat 中😀", None, "a", 3), (903, rows[1][1], "de", "b", 1)]
    labels += [(1, 1, 1), (902, 1, 0)]
    sf = write_sf(spark, tmp_path, rows)
    spark.createDataFrame(labels, LABELS).write.parquet(f"{sf}/labels.parquet")
    out = {r.doc_id: r for r in quality.op4_quality_classifier(spark, sf).collect()}
    assert set(out) == {r[0] for r in rows}
    rule = quality.Rule()
    ids = sorted({i for i, *_ in labels})
    held = {r.i for r in spark.createDataFrame([(i,) for i in ids], "i bigint").where(f"pmod(xxhash64(i), {rule.held_out}) = 0").collect()}
    good = {i for i in ids if all(q == 1 and t == 0 for j, q, t in labels if j == i)}
    bad = {i for i in ids if any(q == 0 for j, q, t in labels if j == i)}
    texts = {r[0]: (r[2], r[1] or "") for r in rows}
    p = plain_model([texts[i][1] for i in good - held])
    bits = {i: sum(-math.log2(p(g)) for g in codes(t)) for i, (_, t) in texts.items()}
    own = [i for i in good & held if texts[i][1]]
    mean = lambda some: sum(bits[i] for i in some) / sum(len(texts[i][1]) for i in some)
    langs = {lang: [i for i in own if texts[i][0] == lang] for lang in {texts[i][0] for i in own}}
    means = {lang: mean(some) for lang, some in langs.items() if len(some) >= rule.least}
    assert len(means) in (1, 2)
    value = {i: 2 ** ((bits[i] + rule.prior * means.get(lang, mean(own))) / (len(t) + rule.prior)) for i, (lang, t) in texts.items()}
    quantile = lambda some: sorted(value[i] for i in some)[math.ceil(rule.quantile * len(some)) - 1]
    limit = {i: quantile(langs[lang]) if lang in means else quantile(own) for i, (lang, _) in texts.items()}
    shares = Counter()
    for i in [*own, *(i for i in bad if texts[i][1])]:
        shares[math.ceil(min(value[i] / limit[i], 4) * 1000), i in bad] += 1
    factor = quality.fit_factor([(at, shares[at, False], shares[at, True]) for at in {a for a, _ in shares}], rule.factor)
    for i, r in out.items():
        assert r.perplexity == pytest.approx(value[i], rel=1e-9) and r.threshold == pytest.approx(limit[i] * factor, rel=1e-9)
        assert r.kept == (not texts[i][1] or value[i] <= limit[i] * factor) and r.n_chars == len(texts[i][1])


def test_edges(spark):
    rows, labels, _ = corpus(60)
    odd = [(1000 + i if i is None else i + 1000, *rest) if i is not None else (None, *rest) for i, *rest in edge_rows()]
    docs = documents(spark, rows + odd).selectExpr("*", "1 AS kept", "2 AS bits", "3 AS _id")
    out = quality.classify(docs, spark.createDataFrame([*labels, (None, None, None), (2, 0, 0), (2, 1, 0)], LABELS))
    got = out.collect()
    assert len(got) == len(rows) + len(odd)
    empty = [r for r in got if r.doc_id in (1001, 1002)]
    assert all(r.kept and r.n_chars == 0 and r.perplexity > 0 for r in empty)
    nobody = quality.classify(docs, spark.createDataFrame([], LABELS)).collect()
    assert len(nobody) == len(got) and all(r.kept and r.perplexity is None and r.threshold is None for r in nobody)
    assert quality.classify(docs.limit(0), spark.createDataFrame(labels, LABELS)).collect() == []


def test_discounts_are_sane():
    assert quality.discounts([0, 0, 0, 0]) == (0.5, 0.75, 0.9)
    d = quality.discounts([100, 40, 20, 12])
    assert 0 < d[0] < d[1] < d[2] < 3 and math.isclose(d[0], 1 - 2 * (100 / 180) * 0.4)
