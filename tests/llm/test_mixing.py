import heapq
from collections import defaultdict
from fractions import Fraction

from hypothesis import given, settings
from hypothesis import strategies as st

from seriesgrove.llm import mixing
from tests.llm.helpers import DOCS, WORD, documents, edge_rows, table, write_sf


def plain_seats(claims, seats, limits):
    given_, heap = [0] * len(claims), [(-Fraction(c), i) for i, c in enumerate(claims) if c > 0 and limits[i] > 0]
    heapq.heapify(heap)
    for _ in range(seats):
        if not heap:
            break
        _, i = heapq.heappop(heap)
        given_[i] += 1
        if given_[i] < limits[i]:
            heapq.heappush(heap, (-Fraction(claims[i]) / (2 * given_[i] + 1), i))
    return given_


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 500), st.integers(0, 40)), min_size=1, max_size=8), st.integers(0, 150))
def test_seats_go_to_the_highest_quotients(parties, seats):
    claims, limits = [c for c, _ in parties], [n for _, n in parties]
    assert mixing.sainte_lague(claims, seats, limits) == plain_seats(claims, seats, limits)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 1000), max_size=12))
def test_targets_match_sharing_the_excess_again(sizes):
    weights = [(3, 1, 2)[i % 3] for i in range(len(sizes))]
    out, open_, left = [Fraction(0)] * len(sizes), set(range(len(sizes))), Fraction(3, 2) * sum(sizes)
    while open_:
        w = sum(weights[i] for i in open_)
        over = {i for i in open_ if left * weights[i] / w > 2 * sizes[i]}
        if not over:
            for i in open_:
                out[i] = left * weights[i] / w
            break
        for i in over:
            out[i] = Fraction(2 * sizes[i])
        left -= sum(out[i] for i in over)
        open_ -= over
    assert mixing.targets(sizes, mixing.Mix()) == out


def test_taken_words_come_near_the_targets(spark, tmp_path):
    rows = [(i, " ".join(f"w{j}" for j in range(1 + (i * 37) % 200)), "en", None if i % 7 == 0 else f"s{i % 7}", 0) for i in range(400)]
    d = write_sf(spark, tmp_path, rows)
    out = mixing.op6_mix_sources(spark, d)
    assert out.columns == ["doc_id", "size", "source_size", "target", "taken"]
    again = mixing.op6_mix_sources(spark, write_sf(spark, tmp_path / "b", list(reversed(rows))))
    assert table(out) == table(again)
    source = {i: s for i, _, _, s, _ in rows}
    taken, goal = defaultdict(int), {}
    for r in out.collect():
        assert r.size == 1 + (r.doc_id * 37) % 200 and 0 <= r.taken <= 2 * r.size
        taken[source[r.doc_id]] += r.taken
        goal[source[r.doc_id]] = r.target
    for s, t in goal.items():
        assert abs(taken[s] - t) <= max(3, 0.01 * t)


def test_cut_rows_hold_what_is_taken(spark):
    rows = [(i, "  " + " \n".join(f"w{i}.{j}" for j in range(1 + i % 40)) + "\t", "en", f"s{i % 3}", 0) for i in range(120)]
    docs = documents(spark, rows).selectExpr("*", "5 AS mix", "6 AS part")
    mixed = mixing.mix_sources(docs, mix=mixing.Mix(shard_words=300, slice_shards=2), into="mix_of_mine")
    taken = {r.doc_id: r.mix_of_mine.taken for r in mixed.collect()}
    out = mixing.write_out(mixed, "mix_of_mine", docs.columns, length="n_chars")
    assert out.columns == docs.columns
    found, texts = defaultdict(int), {i: t for i, t, *_ in rows}
    for r in out.collect():
        n = len(WORD.findall(r.text))
        assert n and r.text in texts[r.doc_id] and (n < 1 + r.doc_id % 40 or r.text == texts[r.doc_id])
        assert r.text == texts[r.doc_id] or r.n_chars == len(r.text)
        found[r.doc_id] += n
    assert {k: v for k, v in taken.items() if v} == dict(found)


def test_edges(spark, tmp_path):
    rows = edge_rows()
    out = mixing.op6_mix_sources(spark, write_sf(spark, tmp_path, rows)).collect()
    assert sorted(((r.doc_id, r.size) for r in out), key=repr) == sorted(((i, len(WORD.findall(t or ""))) for i, t, *_ in rows), key=repr)
    assert all(r.taken <= 2 * r.size for r in out)
    assert mixing.mix_sources(documents(spark, [], DOCS)).collect() == []
    blank = mixing.mix_sources(documents(spark, [(1, None, None, None, None), (2, "", "x", "s", 0)])).collect()
    assert [(r.mix.size, r.mix.taken) for r in blank] == [(0, 0), (0, 0)]
