import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesgrove.config import Config
from seriesgrove.operators import calibration, filters, lifecycle, search, training, tree
from seriesgrove.sources import index_store, series_files

K = 1


@pytest.fixture(scope="module")
def data(spark):
    """Series of six shapes, which bounds by segments hardly tell apart, and queries near them."""
    rng = np.random.default_rng(5)
    shapes = rng.normal(size=(6, 32))
    shapes -= shapes.reshape(6, 4, 8).mean(axis=2).repeat(8, axis=1)  # what the segments' means do not tell apart
    x = (2 * shapes[rng.integers(0, 6, 900)] + rng.normal(size=(900, 32))).astype(np.float32)
    q = x[rng.integers(0, 900, 260)] + rng.normal(scale=0.3, size=(260, 32)).astype(np.float32)
    series = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "series_id bigint, values array<float>").cache()
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "query_id bigint, values array<float>").cache()
    return series, queries


def config(**more):
    settings = dict(
        series_length=32, leaf_size=90, n_nearest_neighbor=K, exact_search=True, require_neurofilter=True, filter_train_num_global_example=200, filter_train_val_split=0.5, filter_train_nepoch=150, learning_rate=0.005,
        filter_is_conformal=True, filter_conformal_recall=0.99, filter_conformal_coverage=0.9, filter_conformal_num_batches=10, filter_model_setting="mlp_2_16", filter_fixed_node_size_threshold=20,
    )
    return Config(**(settings | more))


@pytest.fixture(scope="module")
def trained(spark, data):
    series, queries = data
    return lifecycle.run(spark, config(), series, queries.where("query_id < 200"))


def rows(frame):
    return sorted((r.query_id, r.rank, r.series_id) for r in frame.collect())


def test_a_trained_index_reaches_its_recall_and_coverage(spark, data, trained):
    """The self check: filtered search against exact search in one run."""
    held = data[1].where("query_id >= 200")
    result = lifecycle.evaluate(trained, held)
    told = result.coverage.first()
    assert told.mean_recall >= 0.99 and told.coverage >= 0.9
    states = {r.state: r["count"] for r in result.visits.groupBy("state").count().collect()}
    assert states["resident"] == held.count() and states.get("filter", 0) > 0  # trained filters do prune
    assert rows(result.truth) == rows(search.brute_force(held, data[0], K))


def test_save_load_recalibrate_and_reallocate(spark, data, trained, tmp_path):
    path = str(tmp_path / "index")
    lifecycle.save(trained, path)
    loaded = dict(load_index=True, load_filters=True, index_load_folderpath=path)
    again = lifecycle.run(spark, config(**loaded))
    held = data[1].where("query_id >= 200")
    assert rows(lifecycle.answers(again, held)[0]) == rows(lifecycle.answers(trained, held)[0])
    assert spark.read.parquet(f"{path}/filters").select("core").distinct().first().core == "discrete"
    other = lifecycle.run(spark, config(**loaded, filter_conformal_recall=0.5))
    alphas = lambda s: {r.leaf_id: r.alpha for r in s.chosen.collect()}
    assert set(alphas(other)) == set(alphas(again))  # batches were kept, so another target can be met
    one = again.filters.agg(F.max("memory_mb")).first()[0]
    small = lifecycle.run(spark, config(**loaded, filter_reallocate_single=True, filter_max_gpu_memory_mb=1.5 * one))
    assert small.filters.where("active").count() == 1
    anew = lifecycle.run(spark, config(**loaded, filter_retrain_=True, filter_train_nepoch=5))
    assert anew.filters.where("weights IS NOT NULL").count() == again.filters.count()
    lifecycle.close(anew)


def test_reports_are_written_for_all_places(spark, data, trained, tmp_path):
    held = data[1].where("query_id >= 200")
    lifecycle.write_reports(trained, lifecycle.evaluate(trained, held), str(tmp_path))
    read = lambda n: spark.read.option("header", True).csv(f"{tmp_path}/{n}")
    assert read("query_results_comparison").count() == held.count() * K and read("nodes_statistics").count() == held.count() + 1
    places = trained.alphas.select("error_i").distinct().count()
    assert len(read("batch_error_summary").columns) == 2 + places and len(read("query_recall_by_batch").columns) == 2 + places


def test_confidence_spline_gain_and_candidates(spark, data, tmp_path):
    series, queries = data
    base = lifecycle.build(spark, config(), series)
    state = lifecycle.train(base, queries.where("query_id < 120"))
    at = lambda **more: {r.leaf_id: r.alpha for r in lifecycle.calibrate(lifecycle.replace(state, config=config(**more))).chosen.collect()}
    low, high = at(filter_conformal_recall=-1, filter_conformal_confidence=0.3), at(filter_conformal_recall=-1, filter_conformal_confidence=0.95)
    assert all(low[k] <= high[k] for k in high) and low != high
    assert set(at(filter_conformal_num_batches=1, filter_conformal_is_smoothened=True)) == set(at(filter_conformal_num_batches=1)) == set(high)
    told = lifecycle.allocate(lifecycle.calibrate(lifecycle.replace(state, config=config(filter_allocate_is_gain=True, filter_fixed_node_size_threshold=-1))))
    assert told.filters.where("active").count() >= 1
    names = ["mlp_2_4", "cnn_2_2"]
    assert lifecycle.best_setting(lifecycle.replace(base, config=config(filter_trial_nnode=2, filter_train_nepoch=20)), queries.where("query_id < 60"), names) in names


def test_navigated_search_by_its_own_probabilities(spark, data):
    series, queries = data
    c = config(require_neurofilter=False, navigator_is_learned=True, dim_latent=16, filter_train_nepoch=400, learning_rate=2.0, search_max_nnode=3)
    state = lifecycle.run(spark, c, series, queries.where("query_id < 200"))
    result = lifecycle.evaluate(state, queries.where("query_id >= 200"))
    seen = result.visits.where("state IN ('resident', 'scanned')").groupBy("query_id").count()
    assert seen.agg(F.max("count")).first()[0] <= 3
    assert result.coverage.first().mean_recall > 0.8


def test_local_synthesis_keeps_near_queries(spark, data):
    index = search.build(data[0], tree.TreeSettings(leaf_size=90))
    stats = spark.createDataFrame([(leaf, 1e9, 0.0, 5) for leaf in index.leaves], "leaf_id bigint, lnn_mean double, lnn_std double, n bigint")
    tried = training.local_attempts(index.members, index.sizes, 4, seed=3)
    assert {r.leaf_id: r["count"] for r in tried.groupBy("leaf_id").count().collect()} == dict.fromkeys(index.leaves, 12)
    assert tried.select("query_id").distinct().count() == 12 * len(index.leaves) and tried.agg(F.max("query_id")).first()[0] < 0
    made = training.local_synthesis(index.members, index.sizes, stats, 4, seed=3).collect()
    assert len(made) == 4 * len(index.leaves) and all(len(r["values"]) == 32 for r in made)
    none = stats.withColumn("lnn_mean", F.lit(-1.0))
    assert training.local_synthesis(index.members, index.sizes, none, 4, seed=3).collect() == []
    assert training.one_per_leaf(index.members, index.sizes, seed=3).count() == len(index.leaves)


def test_sketches_route_and_bound(spark, data):
    """A sketch that holds the values times a half: bounds of it hold for the values, too."""
    series, queries = data
    half = lambda f: f.withColumn("sketch", F.transform("values", lambda x: x * 0.5))
    index = search.build(half(series), tree.TreeSettings(leaf_size=90))
    held = queries.where("query_id < 40")
    found, visits = search.exact(half(held), index, 3)
    assert index.sketched and rows(found) == rows(search.brute_force(held, series, 3))
    assert visits.where("state = 'resident'").count() == 40


def test_null_and_ragged_series(spark, data):
    odd = spark.createDataFrame([(9000, None), (9001, [1.0, None] + [0.0] * 30)], "series_id bigint, values array<float>")
    series, queries = data
    few = queries.where("query_id < 5")
    assert rows(search.brute_force(few, series.unionByName(odd), 2)) == rows(search.brute_force(few, series, 2))
    index = search.build(series.unionByName(odd), tree.TreeSettings(leaf_size=90))
    assert sum(index.sizes.values()) == 900
    for wrong in ([[1.0, 2.0], None], [[1.0, 2.0], [1.0]], [[1.0, None]]):
        with pytest.raises(tree.Ragged):
            tree.matrix(__import__("pyarrow").array(wrong))


def test_more_wanted_leaves_than_a_thousand(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(5000, 8)).astype(np.float32)
    series = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "series_id bigint, values array<float>")
    index = search.build(series, tree.TreeSettings(leaf_size=3))
    queries = series.where("series_id < 1500").withColumnRenamed("series_id", "query_id")
    assert len(index.leaves) > 1000
    found, _ = search.exact(queries, index, 2, exclude_self=True)
    assert rows(found) == rows(search.brute_force(queries, series, 2, exclude_self=True))


def test_texts_of_alphas_have_limits(spark, tmp_path):
    alphas = spark.createDataFrame([(1, b, i, 0.25 * i + b) for b in range(3) for i in range(4)] + [(7, 0, 0, 1.5)], "leaf_id bigint, batch_id bigint, error_i bigint, alpha double")
    index_store.save_alphas_text(alphas, f"{tmp_path}/a")
    assert sorted(index_store.load_alphas_text(spark, f"{tmp_path}/a").collect()) == sorted(alphas.collect())
    good = "TYPE_SIZE=8\nNUM_BATCHES=1\nBATCH_0_SIZE=2\n0.5\n1.5"
    assert index_store.parse_alphas(good) == [[0.5, 1.5]]
    for wrong in (good.replace("NUM_BATCHES=1", "NUM_BATCHES=101"), good.replace("SIZE=2", "SIZE=10001"), good.replace("SIZE=2", "SIZE=-2"), good.replace("1.5", ""), "", good.replace("TYPE", "X")):
        with pytest.raises(ValueError):
            index_store.parse_alphas(wrong)


def test_raw_files_in_several_parts(spark, tmp_path):
    x = np.random.default_rng(1).normal(size=(5000, 4)).astype("<f4")
    (tmp_path / "x.bin").write_bytes(x.tobytes())
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    back = series_files.read_raw(spark, f"{tmp_path}/x.bin", 4).orderBy("series_id").collect()
    assert [r.series_id for r in back] == list(range(5000)) and np.array_equal(np.array([r["values"] for r in back], "<f4"), x)
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == old
    parts = series_files.raw_parts(series_files.read_raw(spark, f"{tmp_path}/x.bin", 4), rows=1000).orderBy("first").collect()
    assert b"".join(bytes(r.data) for r in parts) == x.tobytes() and sum(r.n for r in parts) == 5000


def test_command_line(spark, data, tmp_path):
    series, queries = data
    series_files.write_raw(series, f"{tmp_path}/db.bin")
    series_files.write_raw(queries.withColumnRenamed("query_id", "series_id"), f"{tmp_path}/q.bin")
    result = lifecycle.main([f"--db_filepath={tmp_path}/db.bin", f"--query_filepath={tmp_path}/q.bin", "--series_length=32", "--query_size=20", "--leaf_size=90", "--n_nearest_neighbor=3", "--exact_search", "--ground_truth", f"--results_path={tmp_path}/out"], spark)
    assert result.recall.where("recall = 1").count() == 20


def test_relevance_vectors_fit_a_bump(spark):
    rng = np.random.default_rng(4)
    x = rng.uniform(size=(60, 2))
    y = np.exp(-((x - 0.5) ** 2).sum(axis=1) / 0.05) + 0.1
    weights, centres = calibration.relevance(x, y, 0.2)
    phi = np.hstack([np.ones((60, 1)), np.exp(-((x[:, None] - x[centres][None]) ** 2).sum(-1) / 0.08)])
    assert np.abs(phi @ weights - y).max() < 0.1 and len(centres) < 60
    points = spark.createDataFrame([(1, float(a), float(b), float(c)) for (a, b), c in zip(x, y, strict=True)], "leaf_id bigint, recall double, coverage double, alpha double")
    for kernel in (False, True):
        fits = calibration.fit_bivariate(points, kernel, 0.2)
        assert calibration.bivariate_alphas(fits, 0.5, 0.5).first().alpha >= 0


def test_vertical_splits_agree_with_the_fitted_tree(spark, data):
    """The declarative split of one group is the first split of the tree fitted on its rows."""
    x = np.array([r["values"] for r in data[0].orderBy("series_id").collect()], float)
    s = tree.TreeSettings(segments=4, leaf_size=1)
    one = data[0].withColumn("leaf_id", F.lit(1).cast("long"))
    got = tree.all_splits(one, tree.fn.segments(32, 4), s).first()
    gain, on_std, start, n, breaks, parts = tree._candidates(x, tree.Node(0, None, 0, tree.fn.segments(32, 4)), s)
    assert (got.kind == "std", got.start, got.len, got.vertical) == (on_std, start, n, len(parts) == 5)
    assert got.score == pytest.approx(gain) and got.break_at == pytest.approx(breaks[0])


def test_scalar_functions_grow_in_proportion(spark):
    """A z-normalised expression of four times the length takes about four times as long, not 64 times."""
    import time

    from seriesgrove.functions import series as fn

    def took(length):
        rows = spark.range(40).select(F.transform(F.sequence(F.lit(1), F.lit(length)), lambda i: i.cast("double") % 7).alias("v"))
        made = rows.select(F.sum(fn.total(fn.znormalize(fn.noisy("v", F.lit(3), 0.1)))))
        made.collect()
        began = time.perf_counter()
        made.collect()
        return time.perf_counter() - began

    took(32)
    assert took(512) < 10 * (took(128) + 0.2)


def test_filters_can_be_switched(spark):
    made = filters.initialise(spark.createDataFrame([(1, 10), (2, 20)], "leaf_id bigint, size bigint"), "mlp_2_4")
    assert filters.active_count(made).first().active == 0
    with pytest.raises(ValueError):
        filters.initialise(spark.createDataFrame([(1, 10)], "leaf_id bigint, size bigint"), "san_1")
    chosen = spark.createDataFrame([(1, True), (2, True)], "leaf_id bigint, active boolean")
    assert filters.active_count(filters.activate(made, chosen)).first().active == 0  # none has weights
