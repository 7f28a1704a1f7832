"""An index with learned filters, from series to answers, driven by Config.

build -> train (synthetic queries, examples, models, batches, alphas) -> calibrate (alphas for a recall and a coverage)
-> allocate (the budget) -> search, with save and load in between. Every step gives a new State; what grows with the
data is in DataFrames.

Null series are left out (tree.regular). Without training queries, or with no leaf large enough for a filter, there are
no filters, and searches are exact.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesgrove.config import Config
from seriesgrove.functions import models
from seriesgrove.operators import allocation, calibration, filters, reports, search, training
from seriesgrove.operators.lineage import cut
from seriesgrove.sources import index_store, series_files

#: Microseconds a series and a prediction, where they are not measured: fixed, so that results repeat.
SERIES_US, MODEL_US = 0.05, 5.0


@dataclass(frozen=True)
class State:
    """What a step leaves for the next ones."""

    config: Config
    index: search.Index
    queries: DataFrame | None = None  # query_id, values: the global training queries
    predicted: DataFrame | None = None  # query_id, leaf_id, lb2, lnn, visit, bsf, pred of the queries kept for calibration
    knn: DataFrame | None = None  # query_id, leaf_id, n of the training queries
    filters: DataFrame | None = None
    batches: DataFrame | None = None  # query_id, batch_id
    alphas: DataFrame | None = None  # leaf_id, batch_id, error_i, alpha
    chosen: DataFrame | None = None  # leaf_id, alpha for the targets
    navigator: models.Navigator | None = None


@dataclass(frozen=True)
class Result:
    """Answers and visits of the exact and of the chosen search, and how they compare."""

    truth: DataFrame
    found: DataFrame
    visits: DataFrame
    recall: DataFrame  # query_id, recall
    batches: DataFrame  # batch_id, recall, queries
    coverage: DataFrame  # one row: mean_recall, coverage, batches


def _read(spark: SparkSession, path: str, length: int, sketches: str = "", sketch: int = 0) -> DataFrame:
    """Series of a raw file, with their sketches if there are any."""
    rows = series_files.read_raw(spark, path, length)
    return series_files.with_sketch(rows, series_files.read_raw(spark, sketches, sketch)) if sketches and sketch > 0 else rows


def read_series(spark: SparkSession, c: Config) -> DataFrame:
    return _read(spark, c.db_filepath, c.series_length, c.train_sketch_filepath if c.is_sketch_provided else "", c.sketch_length)


def read_queries(spark: SparkSession, c: Config) -> DataFrame:
    rows = _read(spark, c.query_filepath, c.series_length, c.query_sketch_filepath if c.is_sketch_provided else "", c.sketch_length)
    return rows.withColumnRenamed("series_id", "query_id")


def build(spark: SparkSession, c: Config, series: DataFrame | None = None) -> State:
    """An index over the series, or over the raw file that the settings name."""
    if wrong := c.check():
        raise ValueError("; ".join(wrong))
    if series is None:
        series = read_series(spark, c)
        series = series.where(F.col("series_id") < c.db_size) if c.db_size > 0 else series
    return State(c, search.build(series, c.tree()))


def threshold(c: Config, costs: tuple[float, float] | None = None) -> float:
    """The size from which a leaf may have a filter."""
    if c.filter_fixed_node_size_threshold > 0:
        return float(c.filter_fixed_node_size_threshold)
    series_us, model_us = costs or (SERIES_US, MODEL_US)
    return allocation.size_threshold(model_us, series_us, max(c.filter_default_node_size_threshold, c.filter_node_size_threshold))


def _sizes(state: State) -> DataFrame:
    """leaf_id, size: at most max_leaves rows."""
    return state.index.members.sparkSession.createDataFrame(list(state.index.sizes.items()), "leaf_id bigint, size bigint")


def training_queries(state: State, seed: int = 1) -> DataFrame:
    """query_id, values: the file that the settings name, or noisy z-normalised series of the eligible leaves."""
    c, spark = state.config, state.index.members.sparkSession
    if c.filter_query_filepath:
        rows = series_files.read_raw(spark, c.filter_query_filepath, c.series_length, "query_id")
        return rows.where(F.col("query_id") < c.filter_train_nexample) if c.filter_train_nexample > 0 else rows
    n = c.filter_train_num_global_example if c.filter_train_num_global_example > 0 else max(c.filter_train_nexample, 0)
    least = threshold(c)
    if c.filter_num_synthetic_query_per_filter > 0:
        n = training.synthetic_query_count(_sizes(state), least, c.filter_num_synthetic_query_per_filter).first()[0]
    eligible = [leaf for leaf, size in state.index.sizes.items() if size >= least]
    return training.random_queries(state.index.members.where(F.col("leaf_id").isin(eligible)), n, seed, c.filter_query_min_noise, c.filter_query_max_noise)


def _examples(state: State, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Examples of all queries and leaves, and their nearest series by leaf."""
    k = state.config.n_nearest_neighbor
    nearest = training.leaf_nearest(queries, state.index.members, exclude_self=False, k=k)
    found, visits = search.exact(queries, state.index, k)
    told = cut(training.examples(nearest, visits.select("query_id", "leaf_id", "lb2"), k))
    return told, cut(training.knn_leaves(found))


def _batches(c: Config, ids: DataFrame, seed: int) -> DataFrame:
    if c.filter_conformal_use_combinatorial:
        return calibration.combinatorial_batches(ids, c.filter_conformal_num_batches, c.filter_conformal_n_parts, c.filter_conformal_k_parts, seed).select("query_id", "batch_id")
    return calibration.uniform_batches(ids, c.filter_conformal_num_batches, seed)


def train(state: State, queries: DataFrame | None = None, seed: int = 1, setting: str | None = None) -> State:
    """Filters of all eligible leaves, and what calibration needs; or the navigator, if the settings ask for that."""
    c = state.config
    queries = cut(training_queries(state, seed) if queries is None else queries)
    if c.navigator_is_learned:
        found, _ = search.exact(queries, state.index, c.navigator_train_k_nearest_neighbor)
        targets = training.navigator_targets(training.knn_leaves(found), c.navigator_train_k_nearest_neighbor)
        width = c.dim_latent if c.dim_latent > 0 else 500
        return replace(state, queries=queries, navigator=training.fit_navigator(queries, targets, state.index.leaves, width, c.filter_train_nepoch, c.learning_rate, seed))
    told, knn = _examples(state, queries)
    split = cut(training.split(queries.select("query_id"), c.filter_train_val_split))
    eligible = allocation.eligible(_sizes(state), threshold(c)).select("leaf_id")
    known = told.join(eligible, "leaf_id", "left_semi").join(split.where("is_train"), "query_id", "left_semi").select("query_id", "leaf_id", "lnn").join(queries, "query_id")
    if c.filter_train_num_local_example > 0:
        sizes = {leaf: n for leaf, n in state.index.sizes.items() if n >= threshold(c)}
        local = training.local_synthesis(state.index.members, sizes, training.leaf_statistics(told), c.filter_train_num_local_example, seed, low=c.filter_query_min_noise, high=c.filter_query_max_noise)
        known = known.unionByName(local.select("query_id", "leaf_id", "lnn", "values"))
    made = cut(filters.train_filters(known, setting or c.filter_model_setting or "mlp", c.training()))
    held = queries.join(split.where("NOT is_train"), "query_id", "left_semi")
    predicted = cut(told.join(filters.predict(made, held, c.training()), ["query_id", "leaf_id"]))
    return with_alphas(replace(state, queries=queries, predicted=predicted, knn=knn, filters=made, batches=cut(_batches(c, held.select("query_id"), seed))))


def with_alphas(state: State) -> State:
    """The sorted residuals of each filter and batch."""
    residuals = calibration.residuals(state.predicted).join(state.batches, "query_id")
    errors = calibration.with_sentinels(residuals, ["leaf_id", "batch_id"])
    return replace(state, alphas=cut(calibration.sorted_alphas(errors, ["leaf_id", "batch_id"])))


def _held(state: State) -> DataFrame:
    """Nearest series by leaf of the queries that are in a batch."""
    return state.knn.join(state.batches.select("query_id").distinct(), "query_id", "left_semi")


def calibrate(state: State) -> State:
    """Alphas for the target recall and coverage, or, without a target, at the confidence level of all residuals."""
    c, k = state.config, state.config.n_nearest_neighbor
    if state.alphas is None:
        return state
    if c.filter_conformal_recall > 0 and c.filter_conformal_num_batches > 1:
        chosen = calibration.calibrate(state.batches, _held(state), state.predicted, state.alphas, k, c.filter_conformal_recall, c.filter_conformal_coverage)
    elif c.filter_conformal_recall > 0:
        recalls = calibration.batch_recall(state.batches, _held(state), state.predicted, state.alphas, k).groupBy("error_i").agg(F.avg("recall").alias("recall"))
        largest = calibration.largest_alphas(state.alphas)
        if c.filter_conformal_is_smoothened:
            chosen = calibration.alpha_by_recall_spline(recalls, largest, c.filter_conformal_recall, c.filter_conformal_smoothen_core)
        else:
            chosen = calibration.alpha_for_recall(recalls, largest, c.filter_conformal_recall)
    elif c.filter_is_conformal:
        errors = calibration.with_sentinels(calibration.residuals(state.predicted), ["leaf_id"])
        chosen = calibration.alpha_at(calibration.sorted_alphas(errors, ["leaf_id"]), ["leaf_id"], c.filter_conformal_confidence)
    else:
        chosen = state.filters.select("leaf_id", F.lit(0.0).alias("alpha"))
    return replace(state, chosen=cut(chosen))


def allocate(state: State, costs: tuple[float, float] | None = None) -> State:
    """Activates the filters that the memory budget allows: those of the greatest gain, or of the largest leaves."""
    c = state.config
    if state.filters is None:
        return state
    series_us, model_us = costs or (SERIES_US, MODEL_US)
    alphas = state.chosen if state.chosen is not None else state.filters.select("leaf_id", F.lit(0.0).alias("alpha"))
    scored = _sizes(state).join(allocation.bound_pruning(state.predicted), "leaf_id").join(allocation.model_pruning(state.predicted, alphas), "leaf_id")
    told = allocation.reassign(allocation.gains(scored, series_us, model_us), state.filters, c.filter_max_gpu_memory_mb, c.filter_allocate_is_gain)
    return replace(state, filters=cut(filters.activate(state.filters, told)))


def best_setting(state: State, queries: DataFrame, settings: list[str]) -> str:
    """The model setting that prunes most often on a sample of leaves, at the trial's confidence; of equal ones the first by name."""
    c = state.config
    told, _ = _examples(state, queries)
    leaves = allocation.trial_leaves(allocation.eligible(_sizes(state), threshold(c)), c.filter_trial_nnode)
    made = cut(filters.trial(told.select("query_id", "leaf_id", "lnn").join(queries, "query_id"), leaves, settings, c.training()))
    pruned = None
    for setting in settings:  # a few names
        guessed = told.join(filters.predict(made.where(F.col("model") == setting), queries, c.training()), ["query_id", "leaf_id"])
        errors = calibration.with_sentinels(calibration.residuals(guessed), ["leaf_id"])
        alphas = calibration.alpha_at(calibration.sorted_alphas(errors, ["leaf_id"]), ["leaf_id"], c.filter_trial_confidence_level)
        each = allocation.model_pruning(guessed, alphas).withColumn("model", F.lit(setting))
        pruned = each if pruned is None else pruned.unionByName(each)
    return allocation.trial_pruning(pruned).orderBy(F.desc("model_pruned"), "model").first().model


def run(spark: SparkSession, c: Config, series: DataFrame | None = None, queries: DataFrame | None = None, costs: tuple[float, float] | None = None) -> State:
    """A State that is ready to search: loaded, or built, and trained as far as the settings ask for."""
    if c.load_index:
        state = load(spark, c)
        if c.filter_retrain_ and state.filters is not None:
            state = train(replace(state, filters=filters.deactivate(state.filters)), state.queries if queries is None else queries)
        elif c.require_neurofilter and state.filters is None or c.navigator_is_learned and state.navigator is None:
            state = allocate(calibrate(train(state, queries)), costs)
        state = calibrate(state) if state.filters is not None else state
        return allocate(state, costs) if c.filter_reallocate_single or c.filter_reallocate_multi or c.filter_retrain_ else state
    state = build(spark, c, series)
    if c.require_neurofilter or c.navigator_is_learned:
        setting = None
        if c.filter_candidate_settings_filepath:
            names = [x for (x,) in spark.read.text(c.filter_candidate_settings_filepath).where("trim(value) <> ''").select(F.trim("value")).collect()]
            setting = best_setting(state, training_queries(state) if queries is None else queries, names)
        state = allocate(calibrate(train(state, queries, setting=setting)), costs)
    if c.dump_index:
        save(state, c.index_dump_folderpath)
    return state


def answers(state: State, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Answers and visits of the search that the settings describe."""
    c = state.config
    prune = order = None
    if state.filters is not None and c.require_neurofilter:
        alphas = {r.leaf_id: r.alpha for r in state.chosen.collect()} if state.chosen is not None else {}  # at most max_leaves rows
        prune = filters.pruner(state.filters, alphas, c.training())
    if state.navigator is not None:
        order = training.Navigated(state.navigator, c.navigator_combined_lambda if c.navigator_is_combined else None)
    limit = lambda n: n if n > 0 else None
    return search.exact(queries, state.index, c.n_nearest_neighbor, prune=prune, order=order, max_leaves=limit(c.search_max_nnode), max_series=limit(c.search_max_nseries), approximate=not c.exact_search)


def evaluate(state: State, queries: DataFrame) -> Result:
    """The chosen search beside the exact one: recall by query and batch, and the share of batches that reach the target."""
    c = state.config
    truth = cut(search.brute_force(queries, state.index.members, c.n_nearest_neighbor) if c.ground_truth else search.exact(queries, state.index, c.n_nearest_neighbor)[0])
    found, visits = answers(state, queries)
    found = cut(found)
    recall = reports.recall_by_query(truth, found, c.n_nearest_neighbor)
    batches = reports.recall_by_batch(recall)
    return Result(truth, found, visits, recall, batches, reports.achieved_coverage(batches, max(c.filter_conformal_recall, 0.0)))


def write_reports(state: State, result: Result, path: str) -> None:
    """Answers side by side, leaf statistics, batch recalls and, if filters were calibrated, their summaries, as CSV."""
    reports.write_csv(reports.compare(result.truth, result.found), f"{path}/query_results_comparison")
    reports.write_csv(reports.leaf_statistics(result.visits.join(_sizes(state), "leaf_id")), f"{path}/nodes_statistics")
    reports.write_csv(result.batches, f"{path}/batch_recall")
    if state.alphas is None:
        return
    k = state.config.n_nearest_neighbor
    recalls = cut(calibration.recall_coverage(calibration.batch_recall(state.batches, _held(state), state.predicted, state.alphas, k)))
    told = cut(reports.filter_summary(recalls, state.alphas))
    means = recalls.groupBy("error_i").agg(F.avg("recall").alias("recall"), F.avg("coverage").alias("coverage"))
    each = calibration.query_recall(state.batches, _held(state), state.predicted, state.alphas, k)
    reports.write_csv(reports.wide(told, ["leaf_id", "batch_id"], "error_i", "alpha", prefix="error_"), f"{path}/batch_error_summary")
    reports.write_csv(reports.wide(told, ["leaf_id", "error_i"], "batch_id", "alpha", prefix="batch_").join(means, "error_i"), f"{path}/recall_coverage_error_summary")
    reports.write_csv(reports.wide(each, ["batch_id", "query_id"], "error_i", "recall", prefix="recall_"), f"{path}/query_recall_by_batch")


TABLES = ("queries", "predicted", "knn", "filters", "batches", "alphas", "chosen")


def save(state: State, path: str) -> None:
    """The index and all that belongs to it; batches are kept, so that a loaded index can be calibrated for another target."""
    spark = state.index.members.sparkSession
    index_store.save_index(state.index, path)
    for name in TABLES:
        if (table := getattr(state, name)) is not None:
            table = index_store.with_core(table, state.config.filter_conformal_core_type) if name == "filters" else table
            index_store.save_table(table, path, name)
    if state.navigator is not None:
        names, shapes, values = models.flat(state.navigator.weights)
        row = [(state.navigator.length, state.navigator.leaves, state.navigator.width, names, shapes, values)]
        index_store.save_table(spark.createDataFrame(row, "length int, leaves array<bigint>, width int, names array<string>, shapes array<array<int>>, weights array<double>"), path, "navigator")
    index_store.save_table(spark.createDataFrame([(n, getattr(state, n) is not None) for n in (*TABLES, "navigator")], "name string, held boolean").coalesce(1), path, "contents")


def load(spark: SparkSession, c: Config) -> State:
    """The State saved in index_load_folderpath; filters only if load_filters asks for them."""
    path = c.index_load_folderpath
    held = {r.name for r in index_store.load_table(spark, path, "contents").where("held").collect()}
    tables = {n: index_store.load_table(spark, path, n) for n in TABLES if n in held and (c.load_filters or n == "queries")}
    if "filters" in tables:
        tables["filters"] = tables["filters"].drop("core")
    navigator = None
    if "navigator" in held and c.navigator_is_learned:
        r = index_store.load_table(spark, path, "navigator").first()
        navigator = models.Navigator(r.length, list(r.leaves), r.width, models.unflat(list(r.names), [list(x) for x in r.shapes], list(r.weights)))
    return State(c, index_store.load_index(spark, path), **tables, navigator=navigator)


def close(state: State) -> None:
    """Gives back what the state holds of the members."""
    state.index.close()


def main(arguments: list[str], spark: SparkSession | None = None) -> Result | None:
    """As the command line does: build or load, save, search the query file, write the reports."""
    c = Config.parse(arguments)
    spark = spark or SparkSession.builder.getOrCreate()
    state = run(spark, c)
    if not c.query_filepath:
        return None
    queries = read_queries(spark, c)
    queries = queries.where(F.col("query_id") < c.query_size) if c.query_size > 0 else queries
    result = evaluate(state, queries)
    write_reports(state, result, c.results_path)
    return result
