import random

from hypothesis import given, settings
from hypothesis import strategies as st

from seriesgrove.llm import repetition
from tests.llm.helpers import DOCS, documents, edge_rows, plain_rules, write_sf


def columns(texts):
    import pyarrow as pa

    return repetition.measure(pa.array(texts, pa.string()), repetition.Limits())


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab \n\t#é中|\x0b\x85", max_size=200)), max_size=6))
def test_base_measures_match_the_plain_version(texts):
    got = columns(texts)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert [tuple(got[c][i] for c in names) for i in range(len(texts))] == [plain_rules(t) for t in texts]


def test_coverage_counts_characters_inside_repeated_ngrams():
    rng = random.Random(1)
    words = ["w%d" % i for i in range(60)]
    passage = ["p%d" % i for i in range(12)]
    rng.shuffle(words)
    text = " ".join(passage + words[:30] + passage + words[30:])
    got = columns([text])
    assert got["n_repeat_words"] == [24]
    assert got["ngram_chars"][0] == [2 * sum(map(len, passage))] * 6
    assert got["base_failed"] == [True]


def test_method_rejects_long_repeats_that_the_base_lets_pass():
    words = [f"w{i}" for i in range(100)]
    heavy = "x" * 40
    text = " ".join(words[:50] + [heavy] * 1 + ["a", "b", "c", "d", "e", heavy, "f", "g", "h", "i"] + words[50:] + ["a", "b", "c", "d", "e", heavy, "f", "g", "h", "i"])
    got = columns([text])
    assert got["base_failed"] == [False] and got["kept"] == [False]


def test_a_line_twice_in_a_good_text_is_kept():
    line = "The and attion to thanedble the, anea. Eriner thanea."
    body = " ".join(f"word{i}" for i in range(90))
    assert columns([f"{line}\n{body}\n{line}"])["kept"] == [True]


def test_edges_and_clashing_columns(spark):
    docs = documents(spark, edge_rows()).selectExpr("*", "1 AS rules", "2 AS kept", "3 AS n_words")
    out = repetition.repetition_rules(docs)
    assert out.columns == [*docs.columns, "rules_"]
    assert out.count() == docs.count()
    assert repetition.keep_good(docs).columns == docs.columns
    kept = {r.doc_id for r in repetition.keep_good(docs).collect()}
    assert kept == {4, 5, 6, None}
    assert repetition.keep_good(documents(spark, [], DOCS)).collect() == []


def test_query(spark, tmp_path):
    d = write_sf(spark, tmp_path, edge_rows())
    out = repetition.op10_repetition_rules(spark, d)
    assert out.columns[:8] == ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    got = sorted(((r.doc_id, r.n_words, r.n_repeat_words) for r in out.collect()), key=repr)
    assert got == sorted(((i, plain_rules(t)[0], plain_rules(t)[4]) for i, t, *_ in edge_rows()), key=repr)
