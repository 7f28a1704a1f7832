import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesgrove.operators import search, tree
from seriesgrove.sources import index_store, series_files
from seriesgrove.streaming import search_stream

K = 5


@pytest.fixture(scope="module")
def series(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("series_id"), F.col("embedding").alias("values")).cache()


@pytest.fixture(scope="module")
def queries(series):
    return series.where("series_id % 25 = 0").select(F.col("series_id").alias("query_id"), "values")


@pytest.fixture(scope="module")
def index(series):
    return search.build(series, tree.TreeSettings(leaf_size=30))


def rows(frame):
    return sorted((r.query_id, r.rank, r.series_id, round(r.d2, 9)) for r in frame.collect())


@pytest.fixture(scope="module")
def truth(queries, series):
    return search.brute_force(queries, series, K, exclude_self=True)


def test_brute_force_matches_numpy(series, queries, truth):
    x = {r.series_id: np.array(r["values"], float) for r in series.collect()}
    want = []
    for q in queries.collect():
        d = sorted((float(((v - np.array(q["values"], float)) ** 2).sum()), i) for i, v in x.items() if i != q.query_id)[:K]
        want += [(q.query_id, k + 1, i, round(v, 9)) for k, (v, i) in enumerate(d)]
    assert rows(truth) == sorted(want)
    assert rows(search.top_k(search.distances(queries, series, True), K)) == sorted(want)


def test_blocks_of_queries_change_nothing(series, queries, truth, monkeypatch):
    monkeypatch.setattr(search, "BLOCK", 3)
    monkeypatch.setattr(search.blocks, "__defaults__", (3,))
    assert rows(search.brute_force(queries, series, K, True)) == rows(truth)


def test_exact_search_equals_brute_force(queries, index, truth):
    found, visits = search.exact(queries, index, K, exclude_self=True)
    assert rows(found) == rows(truth)
    states = visits.groupBy("query_id").agg(F.count_if(F.col("state") == "resident").alias("r"), F.count("*").alias("n")).collect()
    assert all(s.r == 1 and s.n == len(index.leaves) for s in states)


def test_more_neighbours_than_a_leaf_holds(queries, series, index):
    found, _ = search.exact(queries, index, 80, exclude_self=True)
    assert rows(found) == rows(search.brute_force(queries, series, 80, True))


def test_budgets_and_approximate_search(queries, index):
    _, visits = search.exact(queries, index, K, exclude_self=True, max_leaves=2)
    assert max(r["n"] for r in visits.where("state IN ('scanned', 'resident')").groupBy("query_id").agg(F.count("*").alias("n")).collect()) <= 2
    found, visits = search.exact(queries, index, K, exclude_self=True, approximate=True)
    assert visits.where("state = 'scanned'").count() == 0 and found.count() > 0
    _, visits = search.exact(queries, index, K, exclude_self=True, max_series=70)
    assert visits.where("state = 'budget'").count() > 0


def test_filters_prune_only_with_k_answers(queries, index, truth):
    nothing = lambda x, leaf, lb, bsf: np.zeros(len(x), bool)
    found, _ = search.exact(queries, index, K, exclude_self=True, prune=nothing)
    assert rows(found) == rows(truth)
    everything = lambda x, leaf, lb, bsf: np.ones(len(x), bool)
    found, visits = search.exact(queries, index, 400, exclude_self=True, prune=everything)
    assert visits.where("state = 'filter'").count() == 0 and found.count() == 400 * queries.count()


def test_leaves_partition_the_series_and_bounds_hold(series, index):
    held = index.members.collect()
    assert sorted(r.series_id for r in held) == sorted(r.series_id for r in series.collect())
    x, leaf = np.array([r["values"] for r in held], float), np.array([r.leaf_id for r in held])
    for at in index.leaves:
        lb = tree.bound(x[:100], index.envelopes[at])
        d = ((x[:100][:, None] - x[leaf == at][None]) ** 2).sum(-1).min(axis=1)
        assert (lb <= d + 1e-9).all()
    sizes = {n.node_id: n.n for n in index.nodes if n.is_leaf}
    assert max(sizes.values()) <= 30 and sum(sizes.values()) == len(held)


@pytest.mark.parametrize("size", [1, 2, 5, 200])
def test_bounds_hold_for_leaves_of_any_size(size):
    """A single member sets both ends of a range, and halves have deviations of their own length."""
    rng = np.random.default_rng(size)
    x, q = rng.normal(size=(size, 16)), rng.normal(size=(50, 16))
    for parts in ([(0, 16)], [(0, 8), (8, 8)], [(0, 4), (4, 5), (9, 7)]):
        e = np.array([(a, n, m.min(), m.max(), s.min(), s.max()) for a, n in parts for m, s in [tree._stats(x, a, n)]])
        assert (tree.bound(q, e) <= ((q[:, None] - x[None]) ** 2).sum(-1).min(axis=1) + 1e-9).all()


def test_degenerate_groups_stay_one_leaf():
    x = np.ones((50, 8))
    assert [n.is_leaf for n in tree.fit_rows(x, tree.TreeSettings(), 10)] == [True]
    nodes = tree.fit_rows(np.concatenate([x, 2 * x[:3]]), tree.TreeSettings(), 10)
    assert sorted(n.n for n in nodes if n.is_leaf) == [3, 50]


def test_more_than_two_children_take_the_first_break():
    x = np.repeat(np.arange(9.0)[:, None], 8, axis=1)
    nodes = tree.fit_rows(x, tree.TreeSettings(children=3, leaf_size=3), 3)
    assert sorted(n.n for n in nodes if n.is_leaf) == [3, 3, 3]
    assert len(set(tree.route(nodes, x).tolist())) == 3


def test_the_number_of_leaves_is_bounded():
    x = np.random.default_rng(1).normal(size=(500, 8))
    assert sum(n.is_leaf for n in tree.fit_rows(x, tree.TreeSettings(max_leaves=7), 5)) == 7


def test_a_tree_of_a_sample_still_holds_every_row(series, queries, truth):
    small = search.build(series, tree.TreeSettings(leaf_size=30, sample_rows=100))
    found, _ = search.exact(queries, small, K, exclude_self=True)
    assert rows(found) == rows(truth)


def test_index_round_trip(spark, index, queries, truth, tmp_path):
    index_store.save_index(index, str(tmp_path))
    again = index_store.load_index(spark, str(tmp_path))
    found, _ = search.exact(queries, again, K, exclude_self=True)
    assert rows(found) == rows(truth)
    alphas = spark.createDataFrame([(1, 0, 0, 0.25)], "leaf_id bigint, batch_id bigint, error_i bigint, alpha double")
    index_store.save_alphas_text(alphas, f"{tmp_path}/alphas")
    assert index_store.load_alphas_text(spark, f"{tmp_path}/alphas").collect() == alphas.collect()
    index_store.save_table(alphas, str(tmp_path), "alphas_table")
    assert index_store.load_table(spark, str(tmp_path), "alphas_table").count() == 1


def test_raw_files(spark, series, tmp_path):
    path = f"{tmp_path}/series.bin"
    n = series_files.write_raw(series, path)
    back = series_files.read_raw(spark, path, 64)
    assert n == back.count() == series.count()
    assert [r["values"] for r in back.orderBy("series_id").limit(5).collect()] == [r["values"] for r in series.orderBy("series_id").limit(5).collect()]


def test_series_from_rows(spark):
    rows = spark.createDataFrame([(1, 0, 2.0), (1, 2, 3.0), (1, 2, 1.0), (2, 5, 1.0)], "k bigint, p int, v double")
    out = {r.series_id: r["values"] for r in series_files.from_rows(rows, "k", F.col("p"), F.col("v"), 3).collect()}
    assert out == {1: [2.0, 0.0, 4.0]}


def test_stream_of_queries(spark, index, queries, truth, tmp_path):
    queries.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(queries.schema).parquet(f"{tmp_path}/in")
    search_stream.answer_stream(stream, index, K, f"{tmp_path}/out", f"{tmp_path}/state", exclude_self=True).awaitTermination(120)
    assert rows(spark.read.parquet(f"{tmp_path}/out")) == rows(truth)


def test_no_queries_and_no_series(spark, index, series, queries):
    none = queries.limit(0)
    assert search.brute_force(none, series, K).collect() == []
    assert search.exact(none, index, K)[0].collect() == []
    assert search.exact(queries, search.build(series.limit(0)), K)[0].collect() == []
