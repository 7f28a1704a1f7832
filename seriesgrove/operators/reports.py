"""Recall, coverage, counters and the wide reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def hits(truth: DataFrame, found: DataFrame) -> DataFrame:
    """The true answers that were found, as sets of (query, series)."""
    return truth.join(found.select("query_id", "series_id"), ["query_id", "series_id"], "left_semi")


def recall_by_query(truth: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """query_id, recall: hits over k, also where fewer than k came back."""
    n = hits(truth, found).groupBy("query_id").agg(F.count("*").alias("n"))
    return truth.select("query_id").distinct().join(n, "query_id", "left").select("query_id", (F.coalesce("n", F.lit(0)) / F.lit(float(k))).alias("recall"))


def recall_by_batch(recalls: DataFrame, batches: int = 100) -> DataFrame:
    """batch_id, recall, queries: means over runs of ceil(queries / batches) queries in order of id."""
    n = recalls.agg(F.ceil(F.count("*") / batches).alias("_per"))
    w = Window.orderBy("query_id")
    placed = recalls.withColumn("_p", F.row_number().over(w) - 1).crossJoin(n)  # one row
    return placed.groupBy(F.floor(F.col("_p") / F.col("_per")).cast("long").alias("batch_id")).agg(F.avg("recall").alias("recall"), F.count("*").alias("queries"))


def achieved_coverage(batches: DataFrame, target: float) -> DataFrame:
    """One row: the mean recall and the share of batches at the target or above."""
    return batches.agg(F.avg("recall").alias("mean_recall"), F.avg(F.when(F.col("recall") >= target, 1.0).otherwise(0.0)).alias("coverage"), F.count("*").alias("batches"))


def compare(truth: DataFrame, found: DataFrame) -> DataFrame:
    """True and found answers side by side for each query and rank; is_match tells whether the found series is a true answer."""
    t = truth.select("query_id", "rank", F.col("series_id").alias("true_series"), F.col("leaf_id").alias("true_leaf"), F.col("d2").alias("true_d2"))
    f = found.select("query_id", "rank", F.col("series_id").alias("found_series"), F.col("leaf_id").alias("found_leaf"), F.col("d2").alias("found_d2"))
    known = truth.select("query_id", F.col("series_id").alias("found_series"), F.lit(True).alias("_m")).distinct()
    return t.join(f, ["query_id", "rank"], "left").join(known, ["query_id", "found_series"], "left").withColumn("is_match", F.coalesce("_m", F.lit(False))).drop("_m")


def leaf_statistics(visits: DataFrame) -> DataFrame:
    """Visited and pruned leaves and series of each query, and a row of totals without query_id; visits: state, size."""
    seen = F.col("state").isin("scanned", "resident")
    out = visits.rollup("query_id").agg(F.count_if(seen).alias("visited_leaves"), F.sum(F.when(seen, F.col("size")).otherwise(0)).alias("visited_series"), F.count_if(~seen).alias("pruned_leaves"), F.sum(F.when(~seen, F.col("size")).otherwise(0)).alias("pruned_series"))
    return out.withColumn("pruning_ratio", F.col("pruned_leaves") / (F.col("visited_leaves") + F.col("pruned_leaves")))


def wide(rows: DataFrame, by: list[str], across: str, value: str, columns: list[int] | None = None, prefix: str = "") -> DataFrame:
    """A row for each `by`, a column for each value of `across`: all that occur, in order, unless they are listed."""
    if columns is None:
        columns = [r[0] for r in rows.select(across).distinct().orderBy(across).collect()]  # as many as the report has columns
    out = rows.groupBy(*by).pivot(across, columns).agg(F.first(value))
    return out.select(*by, *(F.col(str(c)).alias(f"{prefix}{c}") for c in columns))


def along(rows: DataFrame, by: list[str], across: str, *values: str) -> DataFrame:
    """The same with a fixed schema: a row for each `by`, and of each value an array in order of `across`, all of them."""
    held = rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(across, *values))).alias("_all"))
    return held.select(*by, *(F.col("_all")[v].alias(f"{v}s") for v in values))


def filter_summary(recalls: DataFrame, alphas: DataFrame) -> DataFrame:
    """leaf_id, batch_id, error_i, recall, coverage, alpha: what the summaries of a filter show, wide by place or by batch. recalls: with coverage."""
    return alphas.join(recalls, ["batch_id", "error_i"]).select("leaf_id", "batch_id", "error_i", "recall", "coverage", "alpha")


def pruning_by_batch(told: DataFrame) -> DataFrame:
    """Of each batch and place: the share of leaves with a nearest series that were pruned, and of leaves without a filter; told: pruned, n, has_filter."""
    wrong = F.col("pruned") & (F.col("n") > 0)
    return told.groupBy("batch_id", "error_i").agg(F.avg(F.when(wrong, 1.0).otherwise(0.0)).alias("wrong_pruned_ratio"), F.avg(F.when(F.col("has_filter"), 0.0).otherwise(1.0)).alias("no_filter_ratio"), F.count("*").alias("leaves"))


def access_by_query(told: DataFrame) -> DataFrame:
    """Of each batch, place and query: the shares of leaves that were visited, and wrongly pruned."""
    wrong = F.col("pruned") & (F.col("n") > 0)
    return told.groupBy("batch_id", "error_i", "query_id").agg(F.avg(F.when(F.col("pruned"), 0.0).otherwise(1.0)).alias("accessed_ratio"), F.avg(F.when(wrong, 1.0).otherwise(0.0)).alias("wrong_pruned_ratio"), F.count("*").alias("leaves"))


def access_by_batch(told: DataFrame, nodes: int) -> DataFrame:
    """Of each batch and place: mean numbers of visited and wrongly pruned leaves a query, over the number of nodes."""
    wrong = F.col("pruned") & (F.col("n") > 0)
    each = told.groupBy("batch_id", "error_i", "query_id").agg(F.count_if(~F.col("pruned")).alias("a"), F.count_if(wrong).alias("w"))
    return each.groupBy("batch_id", "error_i").agg((F.avg("a") / nodes).alias("accessed_ratio"), (F.avg("w") / nodes).alias("wrong_pruned_ratio"))


def write_csv(report: DataFrame, path: str) -> None:
    """A report as CSV files with a header."""
    report.write.mode("overwrite").option("header", True).csv(path)
