"""Which leaves get a filter: costs, gains and the budget."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def size_threshold(model_us: float, series_us: float, least: int) -> float:
    """The leaf size from which a model pays off."""
    return max(model_us / series_us, float(least))


def eligible(sizes: DataFrame, threshold: float) -> DataFrame:
    return sizes.where(F.col("size") >= threshold)


def trial_leaves(sizes: DataFrame, n: int) -> DataFrame:
    """n leaves at even strides of the order by size, the largest first."""
    w = Window.orderBy(F.desc("size"), "leaf_id")
    placed = sizes.withColumn("place", (F.row_number().over(w) - 1).cast("long")).crossJoin(sizes.agg(F.count("*").alias("_n")))
    step = F.greatest(F.lit(1), F.floor(F.col("_n") / n))
    return placed.where((F.col("place") % step == 0) & (F.floor(F.col("place") / step) < n)).drop("_n")


def bound_pruning(examples: DataFrame) -> DataFrame:
    """leaf_id, bound_pruned: how often the bound alone prunes a leaf."""
    return examples.groupBy("leaf_id").agg(F.avg(F.when(F.col("lb2") > F.col("bsf"), 1.0).otherwise(0.0)).alias("bound_pruned"))


def model_pruning(examples: DataFrame, alphas: DataFrame) -> DataFrame:
    """leaf_id, model_pruned: how often the calibrated prediction prunes a leaf."""
    told = examples.join(alphas, "leaf_id")
    return told.groupBy("leaf_id").agg(F.avg(F.when(F.col("pred") - F.col("alpha") > F.col("bsf"), 1.0).otherwise(0.0)).alias("model_pruned"))


def gains(leaves: DataFrame, series_us: float, model_us: float) -> DataFrame:
    """Adds gain = size * (1 - bound_pruned) * model_pruned * (series_us - model_us / size)."""
    return leaves.withColumn("gain", F.col("size") * (1 - F.col("bound_pruned")) * F.col("model_pruned") * (series_us - model_us / F.col("size")))


def best_models(scored: DataFrame) -> DataFrame:
    """The model with the greatest gain of each leaf; scored: leaf_id, model, gain."""
    return scored.groupBy("leaf_id").agg(F.max_by(F.struct("model", "gain"), F.struct("gain", "model")).alias("b")).select("leaf_id", "b.*")


def allocate(leaves: DataFrame, budget_mb: float, by: str, least: float | None = None) -> DataFrame:
    """Adds used_mb and active: leaves by `by`, the greatest first, until the first that does not fit; memory in memory_mb."""
    rows = leaves if least is None else leaves.where(F.col(by) > least)
    w = Window.orderBy(F.desc(by), "leaf_id").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("used_mb", F.sum("memory_mb").over(w)).withColumn("active", F.col("used_mb") <= budget_mb)


def measure_costs(length: int, model, weights, rounds: int = 200, seed: int = 1) -> tuple[float, float]:
    """(microseconds a series, microseconds a prediction) on this machine. Give fixed numbers instead where results must repeat."""
    import time

    import numpy as np

    rng = np.random.default_rng(seed)
    x, q = rng.normal(size=(1000, length)), rng.normal(size=(1, length))
    began = time.perf_counter()
    for _ in range(rounds):
        ((x - q) ** 2).sum(axis=1)
    series_us = (time.perf_counter() - began) / rounds / len(x) * 1e6
    began = time.perf_counter()
    for _ in range(rounds):
        model.forward(weights, q)
    return series_us, (time.perf_counter() - began) / rounds * 1e6


def trial_pruning(trials: DataFrame) -> DataFrame:
    """model, model_pruned: the mean of each model over the sampled leaves."""
    return trials.groupBy("model").agg(F.avg("model_pruned").alias("model_pruned"))


def assign(leaves: DataFrame, budget_mb: float, by_gain: bool = True, least: float | None = None) -> DataFrame:
    """allocate() by gain; by size where that is asked for, or where no leaf has a gain above 0. leaves: leaf_id, size, gain, memory_mb."""
    if not by_gain or (leaves.agg(F.max("gain")).first()[0] or 0) <= 0:
        return allocate(leaves, budget_mb, "size", least)
    return allocate(leaves, budget_mb, "gain", 0.0)


def reassign(leaves: DataFrame, filters: DataFrame, budget_mb: float, by_gain: bool = True) -> DataFrame:
    """assign() on a loaded index: only leaves whose filter has weights can be chosen, at those filters' memory."""
    trained = filters.where("weights IS NOT NULL").select("leaf_id", F.col("memory_mb").alias("_mb"))
    return assign(leaves.drop("memory_mb").join(trained, "leaf_id").withColumnRenamed("_mb", "memory_mb"), budget_mb, by_gain)
