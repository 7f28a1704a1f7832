"""Learned filters: one model per leaf, trained in Spark tasks, and search that skips leaves by them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesgrove.functions import models
from seriesgrove.functions import series as fn
from seriesgrove.operators import search

FILTERS = "leaf_id bigint, model string, names array<string>, shapes array<array<int>>, weights array<double>, loss double, examples bigint, memory_mb double, active boolean"


def initialise(sizes: DataFrame, setting: str) -> DataFrame:
    """FILTERS without weights for every leaf of (leaf_id, size): not trained, not active."""
    models.ModelSetting.parse(setting)
    none = lambda kind: F.lit(None).cast(kind)
    return sizes.select("leaf_id", F.lit(setting).alias("model"), none("array<string>").alias("names"), none("array<array<int>>").alias("shapes"), none("array<double>").alias("weights"), none("double").alias("loss"), F.lit(0).cast("long").alias("examples"), none("double").alias("memory_mb"), F.lit(False).alias("active"))


def train_filters(examples: DataFrame, setting: str = "mlp", t: models.Training = models.Training()) -> DataFrame:
    """FILTERS: a model for each leaf from (leaf_id, query_id, values, lnn); one task per leaf, whose examples are bounded by the training queries."""
    return train_models(examples.withColumn("model", F.lit(setting)), t)


def train_models(examples: DataFrame, t: models.Training = models.Training()) -> DataFrame:
    """FILTERS for each leaf and model setting of (leaf_id, model, query_id, values, lnn)."""

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("query_id", kind="stable")
        setting = rows["model"].iloc[0]
        x, y = np.stack(rows["values"].to_numpy()).astype(np.float64), rows["lnn"].to_numpy(np.float64)
        found = models.train(models.make(setting, x.shape[1], t), x, y, t)
        names, shapes, values = models.flat(found.weights)
        return pd.DataFrame({"leaf_id": [rows["leaf_id"].iloc[0]], "model": [setting], "names": [names], "shapes": [shapes], "weights": [values], "loss": [found.loss], "examples": [len(rows)], "memory_mb": [models.memory_mb(found.weights)], "active": [True]})

    return examples.select("leaf_id", "model", "query_id", "values", "lnn").groupBy("leaf_id", "model").applyInPandas(fit, FILTERS)


def trial(examples: DataFrame, leaves: DataFrame, settings: list[str], t: models.Training = models.Training()) -> DataFrame:
    """FILTERS of all candidate settings on the sampled leaves (leaf_id)."""
    candidates = F.explode(F.array(*(F.lit(x) for x in settings)))
    return train_models(examples.join(leaves.select("leaf_id"), "leaf_id", "left_semi").withColumn("model", candidates), t)


def deactivate(filters: DataFrame, leaves: DataFrame | None = None) -> DataFrame:
    """The same filters, none of them active, or none of the given leaves': they can be trained or chosen anew."""
    if leaves is None:
        return filters.withColumn("active", F.lit(False))
    off = leaves.select("leaf_id", F.lit(True).alias("_off")).distinct()
    return filters.join(off, "leaf_id", "left").withColumn("active", F.col("active") & F.col("_off").isNull()).drop("_off").select(*filters.columns)


def activate(filters: DataFrame, chosen: DataFrame) -> DataFrame:
    """The same filters; active are those with weights whose leaf is chosen (leaf_id, active) as active."""
    told = chosen.select("leaf_id", F.col("active").alias("_on"))
    return filters.join(told, "leaf_id", "left").withColumn("active", F.col("weights").isNotNull() & F.coalesce("_on", F.lit(False))).drop("_on").select(*filters.columns)


def distinct(rows: DataFrame) -> DataFrame:
    """leaf_id of the filters that rows are about, each once."""
    return rows.select("leaf_id").dropDuplicates()


def active_count(filters: DataFrame) -> DataFrame:
    """One row: leaves with a filter, and with an active one; a leaf counts once."""
    return filters.agg(F.countDistinct("leaf_id").alias("filters"), F.countDistinct(F.when(F.col("active"), F.col("leaf_id"))).alias("active"))


def predict(filters: DataFrame, queries: DataFrame, t: models.Training = models.Training()) -> DataFrame:
    """query_id, leaf_id, pred of every query and active filter; each filter meets the queries in blocks of bounded size."""
    made = []
    for ids, x in search.blocks(queries):
        sent = filters.sparkSession.sparkContext.broadcast((ids, x))

        def run(batches, sent=sent):
            ids, x = sent.value
            for rows in batches:
                for r in rows.itertuples():
                    p = models.unflat(list(r.names), [list(s) for s in r.shapes], list(r.weights))
                    y = models.make(r.model, x.shape[1], t).forward(p, x)
                    yield pd.DataFrame({"query_id": ids, "leaf_id": r.leaf_id, "pred": y * y if t.remove_square else y})

        made.append(filters.where("active").mapInPandas(run, "query_id bigint, leaf_id bigint, pred double"))
    return search._all(made, filters.sparkSession, "query_id bigint, leaf_id bigint, pred double")


def mlp_expression(values: Column, w1: list[list[float]], b1: list[float], w2: list[float], b2: float, slope: float = 0.1) -> Column:
    """The forward pass of an MLP as one expression."""
    out = F.lit(b2)
    for j, (bias, weight) in enumerate(zip(b1, w2, strict=True)):
        column = F.array(*(F.lit(row[j]) for row in w1))
        z = F.lit(bias) + F.aggregate(F.zip_with(values, column, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
        out = out + weight * F.when(z > 0, z).otherwise(slope * z)
    return out


class Pruner:
    """A `prune` for search.exact: skips a leaf whose lowered prediction is above the best so far. Models are bounded by the memory budget."""

    def __init__(self, held: dict[int, tuple[str, models.Weights]], alphas: dict[int, float], t: models.Training):
        self.held, self.alphas, self.t = held, alphas, t

    def __call__(self, x: np.ndarray, leaf: int, lb: np.ndarray, bsf: np.ndarray) -> np.ndarray:
        if leaf not in self.held or leaf not in self.alphas:
            return np.zeros(len(x), bool)
        kind, p = self.held[leaf]
        y = np.maximum(0, models.make(kind, x.shape[1], self.t).forward(p, x) - self.alphas[leaf])
        return (y * y if self.t.remove_square else y) > bsf


def pruner(filters: DataFrame, alphas: dict[int, float], t: models.Training = models.Training()) -> Pruner:
    held = {}
    for r in filters.where("active").toLocalIterator():
        held[r.leaf_id] = r.model, models.unflat(list(r.names), [list(s) for s in r.shapes], list(r.weights))
    return Pruner(held, alphas, t)


def bounds_of(predicted: DataFrame, alphas: DataFrame, square: bool = False) -> DataFrame:
    """query_id, leaf_id, pred, low (the calibrated prediction), and the interval's ends: the variants of an inference.

    predicted: query_id, leaf_id, pred; alphas: leaf_id, alpha.
    """
    return predicted.join(alphas, "leaf_id").select("query_id", "leaf_id", "pred", fn.calibrated(F.col("pred"), F.col("alpha"), square).alias("low"), (F.col("pred") - F.col("alpha")).alias("lo"), (F.col("pred") + F.col("alpha")).alias("hi"))
