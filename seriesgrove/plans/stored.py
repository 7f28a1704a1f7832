"""Queries whose rows went through a source or a sink of this package, and their SQL.

Each writes to a fresh folder beside the checkpoints, which all hosts share, reads it back and goes on from there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesgrove.functions import series as fn
from seriesgrove.operators import filters, reports, search, training, tree
from seriesgrove.operators.lineage import scratch
from seriesgrove.plans import catalog, engine
from seriesgrove.plans.queries import K, LENGTH, SQL, Tables, query, rounded
from seriesgrove.sources import index_store, series_files

_PLACED = "SELECT row_number() OVER (ORDER BY series_id) - 1 AS place, * FROM series"


def _raw(t: Tables, series: DataFrame, length: int) -> DataFrame:
    """The series as a headerless file, read back; ids are places."""
    path = f"{scratch(t.spark)}/series.bin"
    series_files.write_raw(series, path)
    return series_files.read_raw(t.spark, path, length)


def _sketches(t: Tables) -> DataFrame:
    """Means of 16 pieces of each series, rounded so that 32 bits hold them alike everywhere."""
    parts = [(4 * i, 4) for i in range(16)]
    stats = fn.segment_stats(F.col("values"), parts)
    return t.series.select("series_id", F.transform(stats, lambda p: (F.round(p["mean"] * 1024) / 1024).cast("float")).alias("values"))


_MEANS = "[{}]".format(", ".join(f"round(list_avg(v[{4 * i + 1} : {4 * i + 4}]::DOUBLE[]) * 1024) / 1024 + 0.0" for i in range(16)))


# Sources


@query(f"SELECT place AS series_id, list_transform(v, lambda x: x::DOUBLE) AS values FROM ({_PLACED})")
def raw_scan(t: Tables):
    return _raw(t, t.series, LENGTH).select("series_id", F.transform("values", lambda x: x.cast("double")).alias("values"))


@query(f"SELECT place AS series_id, {_MEANS} AS sketch FROM ({_PLACED})")
def sketch_scan(t: Tables):
    """Series and their sketches, each from a file of its own."""
    both = series_files.with_sketch(_raw(t, t.series, LENGTH), _raw(t, _sketches(t), 16))
    return both.select("series_id", F.transform("sketch", lambda x: x.cast("double") + 0.0).alias("sketch"))


@query(f"SELECT query_id, series_id, rank, round(d2, 6) AS d2 FROM (SELECT a.place AS query_id, b.place AS series_id, list_sum(list_transform(list_zip(a.v, b.v), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE))) AS d2, row_number() OVER (PARTITION BY a.place ORDER BY d2, b.place) AS rank FROM ({_PLACED}) a, ({_PLACED}) b WHERE a.place % 100 = 0 AND a.place <> b.place) WHERE rank <= {K}")
def sketched_search(t: Tables):
    """Exact search whose tree is routed and bounded by sketches: means of pieces of four, whose distances are at most half those of the series."""
    pieces = lambda f: f.withColumn("sketch", F.transform("sketch", lambda x: x.cast("double")))
    series = pieces(series_files.with_sketch(_raw(t, t.series, LENGTH), _raw(t, _sketches(t), 16)))
    held = search.build(series, tree.TreeSettings(leaf_size=50))
    queries = series.where("series_id % 100 = 0").withColumnRenamed("series_id", "query_id")
    return rounded(search.exact(queries, held, K, exclude_self=True)[0].select("query_id", "series_id", "rank", "d2"), "d2")


@query(f"SELECT place AS query_id, list_transform(v, lambda x: x::DOUBLE) AS values FROM ({_PLACED}) WHERE place < 20")
def training_query_file(t: Tables):
    """Training queries from the file that the settings name."""
    from seriesgrove.config import Config
    from seriesgrove.operators import lifecycle

    path = f"{scratch(t.spark)}/queries.bin"
    series_files.write_raw(t.series, path)
    c = Config(series_length=LENGTH, filter_query_filepath=path, filter_train_nexample=20)
    found = lifecycle.training_queries(lifecycle.State(c, engine.index(t)))
    return found.select("query_id", F.transform("values", lambda x: x.cast("double")).alias("values"))


# Indexes


def _loaded(t: Tables) -> search.Index:
    path = scratch(t.spark)
    held = engine.index(t)
    index_store.save_index(held, path)
    held.close()
    return index_store.load_index(t.spark, path)


@query(SQL["search_exact"])
def index_round_trip(t: Tables):
    """Exact search over an index that was written and read: nodes, splits, envelopes, members by leaf."""
    found, _ = search.exact(t.queries, _loaded(t), K, exclude_self=True)
    return rounded(found.select("query_id", "series_id", "leaf_id", "rank", "d2"), "d2")


@query(SQL["search_visits"])
def index_round_trip_visits(t: Tables):
    _, visits = search.exact(t.queries, _loaded(t), K, exclude_self=True)
    return rounded(visits.select("query_id", "leaf_id", "lb2", "visit", "state"), "lb2")


@query("SELECT leaf_id, count(*) AS n, min(series_id) AS first, max(series_id) AS last FROM f_series WHERE leaf_id IN (3, 7) GROUP BY leaf_id")
def leaf_scan(t: Tables):
    """Two leaves of a stored index; the others' files are not read."""
    rows = _loaded(t).members.where(F.col("leaf_id").isin(3, 7))
    return rows.groupBy("leaf_id").agg(F.count("*").alias("n"), F.min("series_id").alias("first"), F.max("series_id").alias("last"))


_UNDER = "SELECT * FROM (VALUES " + ", ".join(f"({n}, {leaf})" for n in engine.TREE for leaf in engine.LEAVES if leaf == n or n == 0 or (n == 1 and leaf in (3, 4)) or (n == 2 and leaf in (5, 7, 8)) or (n == 6 and leaf in (7, 8))) + ") t(node_id, leaf)"


@query(f"SELECT CAST(node_id AS BIGINT) AS node_id, CAST(CASE WHEN node_id = 0 THEN 0 WHEN node_id < 3 THEN 1 WHEN node_id < 7 THEN 2 ELSE 3 END AS BIGINT) AS depth, node_id NOT IN (0, 1, 2, 6) AS is_leaf, count(series_id) AS n FROM ({_UNDER}) u LEFT JOIN f_series f ON f.leaf_id = u.leaf GROUP BY node_id")
def tree_log(t: Tables):
    """Depth and size of every node of a loaded tree."""
    held = _loaded(t)
    return tree.to_frame(t.spark, tree.with_sizes(held.nodes, held.sizes)).select("node_id", F.col("depth").cast("long").alias("depth"), "is_leaf", "n")


# Tables of an index


def _kept(t: Tables, frame: DataFrame, name: str) -> DataFrame:
    path = scratch(t.spark)
    index_store.save_table(frame, path, name)
    return index_store.load_table(t.spark, path, name)


@query(SQL["filter_predictions"])
def filters_stored(t: Tables):
    """Predictions of filters that were written with their core and read."""
    held = _kept(t, index_store.with_core(engine.fixed_filters(t), "discrete"), "filters")
    return rounded(filters.predict(held.where("core = 'discrete'").drop("core"), t.queries), "pred")


@query(SQL["alphas_sorted"])
def alphas_stored(t: Tables):
    """Alphas that were written as text and read."""
    path = f"{scratch(t.spark)}/alphas"
    index_store.save_alphas_text(t.alphas(), path)
    return index_store.load_alphas_text(t.spark, path)


@query(SQL["knn_nodes_count"])
def knn_stored(t: Tables):
    return _kept(t, t.knn(), "knn").select("query_id", "leaf_id", "n")


@query(SQL["synth_queries_portable"])
def synth_queries_stored(t: Tables):
    held = _kept(t, training.synthesize(t.series), "queries")
    return held.select("query_id", F.transform("values", lambda x: fn.signed_round(x)).alias("values"))


@query(SQL["local_queries"])
def local_examples_stored(t: Tables):
    """Local examples in a folder for each leaf."""
    path = f"{scratch(t.spark)}/local"
    found = t.nearest()
    index_store.save_by_leaf(training.local_queries(found, training.leaf_statistics(found), 3).select("query_id", "leaf_id", "rank"), path)
    return index_store.load_by_leaf(t.spark, path).select("query_id", "leaf_id", "rank")


@query(SQL["calib_batches_uniform"])
def calibration_ids_stored(t: Tables):
    """The queries of each calibration batch, as lines of text."""
    path = f"{scratch(t.spark)}/ids"
    index_store.save_ids_text(t.batches(), path)
    return index_store.load_ids_text(t.spark, path)


@query(SQL["answer_comparison"])
def answer_comparison_csv(t: Tables):
    path = f"{scratch(t.spark)}/comparison"
    report = rounded(reports.compare(t.truth(), t.approximate()), "true_d2", "found_d2")
    reports.write_csv(report, path)
    return t.spark.read.option("header", True).schema(report.schema).csv(path)


@query(SQL["node_statistics"])
def node_statistics_csv(t: Tables):
    path = f"{scratch(t.spark)}/statistics"
    report = catalog.rounded(reports.leaf_statistics(t.visits()), "pruning_ratio")
    reports.write_csv(report, path)
    return t.spark.read.option("header", True).schema(report.schema).csv(path)


# Routing with more than two children, and sets


_THREE = [-0.012, 0.012]


@query(f"SELECT series_id, CASE WHEN {engine._stat('v[1:16]', False)} < {_THREE[0]} THEN 1 WHEN {engine._stat('v[1:16]', False)} < {_THREE[1]} THEN 2 ELSE 3 END::BIGINT AS leaf_id FROM series")
def tree_route_multiway(t: Tables):
    """Three children: the first break that a series lies below decides."""
    root = tree.Node(0, None, 0, t.parts, 0, False, False, 0, 16, list(_THREE), [1, 2, 3])
    leaves = [tree.Node(i, 0, 1, t.parts) for i in (1, 2, 3)]
    return tree.assign(t.series.select("series_id", "values"), [root, *leaves]).select("series_id", "leaf_id")


@query("SELECT DISTINCT leaf_id FROM alphas")
def distinct_filters(t: Tables):
    """The leaves with a filter that was calibrated, each once."""
    return filters.distinct(t.alphas())


@query("SELECT leaf_id, size FROM f_sizes")
def leaf_list(t: Tables):
    """All leaves of an index with members, and their sizes."""
    held = engine.index(t)
    return t.spark.createDataFrame([(leaf, held.sizes[leaf]) for leaf in held.leaves], "leaf_id bigint, size bigint")
