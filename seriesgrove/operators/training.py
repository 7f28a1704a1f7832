"""Training examples of leaf filters, synthetic queries, splits and targets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seriesgrove.functions import series as fn
from seriesgrove.operators import search, tree
from seriesgrove.operators.lineage import cut


#: Leaves whose nearest distances a task holds before it hands them on.
HELD = 512


def _leaf_scan(ids: np.ndarray, x: np.ndarray, k: int, exclude_self: bool):
    """For batches (series_id, leaf_id, values): the k least distances of each query to each leaf that a task has read."""

    def out(held: dict[int, np.ndarray]) -> pa.RecordBatch:
        leaves = np.repeat(np.array(list(held), np.int64), len(ids))
        best = np.concatenate(list(held.values()))
        lists = [[d for d in row if np.isfinite(d)] for row in best.tolist()]
        return pa.RecordBatch.from_arrays([pa.array(np.tile(ids, len(held))), pa.array(leaves), pa.array(lists, pa.list_(pa.float64()))], names=["query_id", "leaf_id", "best"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            series, leaves, rows = batch.column(0).to_numpy(), batch.column(1).to_numpy(), tree.matrix(batch.column(2))
            for leaf in np.unique(leaves).tolist():
                if leaf not in held and len(held) >= HELD:
                    yield out(held)
                    held = {}
                best = held.get(leaf, np.full((len(ids), k), np.inf))
                at = np.flatnonzero(leaves == leaf)
                for lo in range(0, len(at), 64):
                    part = at[lo : lo + 64]
                    d = ((x[:, None, :] - rows[part][None]) ** 2).sum(axis=2)
                    if exclude_self:
                        d[ids[:, None] == series[part][None, :]] = np.inf
                    best = np.sort(np.concatenate([best, d], axis=1), axis=1)[:, :k]
                held[leaf] = best
        if held:
            yield out(held)

    return run


def leaf_nearest(queries: DataFrame, members: DataFrame, exclude_self: bool = True, k: int = 1) -> DataFrame:
    """query_id, leaf_id, lnn (each query's nearest distance in every leaf) and best (the k least, rising).

    Tasks keep the k least of what they read of a leaf, for a block of queries; only those are shuffled. A leaf that
    holds nothing but the query itself gives no row.
    """
    rows = members.select(F.col("series_id").cast("long"), F.col("leaf_id").cast("long"), "values")
    made = [rows.mapInArrow(_leaf_scan(ids, x, k, exclude_self), "query_id bigint, leaf_id bigint, best array<double>") for ids, x in search.blocks(queries, max(1, search.BLOCK // 8))]
    parts = search._all(made, members.sparkSession, "query_id bigint, leaf_id bigint, best array<double>")
    merged = parts.groupBy("query_id", "leaf_id").agg(F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, k).alias("best"))
    return merged.where(F.size("best") > 0).select("query_id", "leaf_id", F.element_at("best", 1).alias("lnn"), "best")


def examples(nearest: DataFrame, bounds: DataFrame, k: int = 1) -> DataFrame:
    """query_id, leaf_id, lb2, lnn, visit, bsf: leaves in order of bound; bsf is the k-th nearest series of the leaves before, null until there are k.

    For k above 1, nearest must have been made with that k.
    """
    w = Window.partitionBy("query_id").orderBy("lb2", "leaf_id")
    both = nearest.join(bounds, ["query_id", "leaf_id"])
    if k == 1:
        return both.drop("best").withColumn("visit", F.row_number().over(w).cast("long")).withColumn("bsf", F.min("lnn").over(w.rowsBetween(Window.unboundedPreceding, -1)))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["lb2", "leaf_id"])
        best, bsf = np.zeros(0), []
        for found in rows["best"]:
            bsf.append(float(best[k - 1]) if len(best) >= k else None)
            best = np.sort(np.append(best, found))[:k]
        out = rows[["query_id", "leaf_id", "lb2", "lnn"]].assign(visit=np.arange(1, len(rows) + 1))
        return out.assign(bsf=pd.Series(bsf, out.index, dtype="object"))

    return both.groupBy("query_id").applyInPandas(run, "query_id bigint, leaf_id bigint, lb2 double, lnn double, visit bigint, bsf double")


def synthesize(series: DataFrame, scale_low: float = 0.1, scale_high: float = 0.4, eligible: DataFrame | None = None) -> DataFrame:
    """query_id, values: each series of the eligible leaves with portable noise of its own strength, z-normalised; constant ones drop out."""
    rows = series if eligible is None else series.join(eligible.select("leaf_id"), "leaf_id", "left_semi")
    scale = scale_low + (scale_high - scale_low) * F.pmod(F.col("series_id") * 31 + 7, F.lit(100)).cast("double") / 100
    noised = rows.select(F.col("series_id").alias("query_id"), fn.noisy("values", F.col("series_id"), scale).alias("values"))
    return noised.select("query_id", fn.znormalize("values").alias("values")).where("values IS NOT NULL")


def random_queries(series: DataFrame, n: int, seed: int, low: float = 0.1, high: float = 0.4) -> DataFrame:
    """n seeded random series with normal noise whose deviation is uniform in [low, high], z-normalised."""
    picked = series.orderBy(F.xxhash64("series_id", F.lit(seed))).limit(n)
    sigma = picked.withColumn("_s", low + (high - low) * F.rand(seed))
    rows = sigma.select(F.col("series_id").alias("query_id"), "_s", F.posexplode(fn.doubles("values")).alias("i", "x")).withColumn("x", F.col("x") + F.col("_s") * F.randn(seed + 1))
    back = rows.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("values"))
    return back.select("query_id", fn.znormalize("values").alias("values")).where("values IS NOT NULL")


def local_queries(candidates: DataFrame, stats: DataFrame, n: int) -> DataFrame:
    """The first n candidates (query_id, leaf_id, lnn) of each leaf whose nearest distance is at most the leaf's mean less its deviation."""
    near = candidates.join(stats, "leaf_id").where(F.col("lnn") <= F.col("lnn_mean") - F.col("lnn_std"))
    w = Window.partitionBy("leaf_id").orderBy("query_id")
    return near.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= n)


def local_attempts(members: DataFrame, sizes: dict[int, int], n: int, seed: int, attempts: int = 3, low: float = 0.1, high: float = 0.4) -> DataFrame:
    """query_id, leaf_id, values: attempts * n noisy queries for each leaf of `sizes`, made of its own members in an order drawn by a seed.

    A leaf with fewer members than attempts uses them in turn. Ids are negative, so that they are not those of any series.
    """
    spark = members.sparkSession
    held = spark.createDataFrame([(leaf, m) for leaf, m in sizes.items()], "leaf_id bigint, m bigint")  # at most max_leaves rows
    total = attempts * n
    # The first by hash: tasks keep as many of what they read, so only those are shuffled.
    drawn = members.join(F.broadcast(held), "leaf_id").withColumn("_h", F.xxhash64("series_id", F.lit(seed)))
    ranked = drawn.withColumn("_r", F.row_number().over(Window.partitionBy("leaf_id").orderBy("_h", "series_id"))).where(F.col("_r") <= total)
    each = ranked.withColumn("_a", F.explode(F.sequence((F.col("_r") - 1).cast("long"), F.lit(total - 1).cast("long"), F.least(F.col("m"), F.lit(total)).cast("long"))))
    key = -(1 + F.col("leaf_id") * total + F.col("_a"))
    made = each.select(key.alias("query_id"), "leaf_id", "values").withColumn("scale", low + (high - low) * F.pmod(F.xxhash64("query_id", F.lit(seed + 1)), F.lit(1000)) / 1000)
    noised = made.select("query_id", "leaf_id", fn.znormalize(fn.noisy("values", F.pmod("query_id", F.lit(1 << 40)), F.lit(3.464) * F.col("scale"))).alias("values"))
    return noised.where("values IS NOT NULL")


def local_synthesis(members: DataFrame, sizes: dict[int, int], stats: DataFrame, n: int, seed: int, attempts: int = 3, low: float = 0.1, high: float = 0.4) -> DataFrame:
    """query_id, leaf_id, values, lnn, rank: of a leaf's attempts the first n whose nearest distance there is at most the mean less the deviation (stats)."""
    tried = cut(local_attempts(members, sizes, n, seed, attempts, low, high))
    pairs = tried.select("query_id", "leaf_id", F.col("values").alias("_q")).join(members.select("leaf_id", "values"), "leaf_id")
    nearest = pairs.groupBy("query_id", "leaf_id").agg(F.min(fn.sq_euclidean("_q", "values")).alias("lnn"))
    return local_queries(nearest, stats, n).select("query_id", "leaf_id", "lnn", "rank").join(tried, ["query_id", "leaf_id"])


def one_per_leaf(members: DataFrame, sizes: dict[int, int], seed: int, low: float = 0.1, high: float = 0.4) -> DataFrame:
    """query_id, leaf_id, values: one noisy query for each leaf."""
    return local_attempts(members, sizes, 1, seed, 1, low, high)


def leaf_statistics(found: DataFrame) -> DataFrame:
    """Mean and deviation of the nearest distances of each leaf."""
    return found.groupBy("leaf_id").agg(F.avg("lnn").alias("lnn_mean"), F.stddev_pop("lnn").alias("lnn_std"), F.count("*").alias("n"))


def split(found: DataFrame, share: float, key: str = "query_id") -> DataFrame:
    """Adds is_train: the first share of the keys, in their order. Places come from a rank over the distinct keys."""
    keys = found.select(key).distinct()
    n = keys.agg(F.count("*").alias("n"))
    placed = keys.withColumn("_p", F.row_number().over(Window.orderBy(key)) - 1).crossJoin(n).select(key, (F.col("_p") < F.floor(F.col("n") * share)).alias("is_train"))
    return found.join(placed, key)


def knn_leaves(answers: DataFrame) -> DataFrame:
    """query_id, leaf_id, n: how many of a query's nearest series lie in each leaf; a series counts once."""
    return answers.groupBy("query_id", "leaf_id").agg(F.countDistinct("series_id").alias("n"))


def navigator_targets(counts: DataFrame, k: int) -> DataFrame:
    """The share of a query's nearest series in each leaf."""
    return counts.select("query_id", "leaf_id", (F.col("n") / F.lit(float(k))).alias("share"))


def navigator_order(scores: DataFrame, blend: float) -> DataFrame:
    """Leaves by blend * scaled probability + (1 - blend) * scaled closeness, best first; scaled to 0..1 within a query."""
    w = Window.partitionBy("query_id")
    scale = lambda c: F.when(F.max(c).over(w) > F.min(c).over(w), (F.col(c) - F.min(c).over(w)) / (F.max(c).over(w) - F.min(c).over(w))).otherwise(0.0)
    score = F.lit(blend) * scale("probability") + F.lit(1 - blend) * (1 - scale("lb2"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "leaf_id")
    return scores.withColumn("score", F.round(score, 6)).withColumn("place", F.row_number().over(order).cast("long"))


def within_budget(visits: DataFrame, max_leaves: int | None = None, max_series: int | None = None) -> DataFrame:
    """Leaves in order of visit, as long as their number and the series in them stay within the budgets; visits: visit, size."""
    w = Window.partitionBy("query_id").orderBy("visit")
    out = visits.withColumn("seen", F.sum("size").over(w))
    if max_leaves is not None:
        out = out.where(F.col("visit") <= max_leaves)
    return out if max_series is None else out.where(F.col("seen") <= max_series)


class Navigated:
    """An `order` for search.exact: leaves by a navigator's probabilities, or by a blend with scaled closeness."""

    def __init__(self, model, blend: float | None = None):
        self.model, self.blend = model, blend

    def __call__(self, x: np.ndarray, leaves: list[int], lb: np.ndarray) -> np.ndarray:
        at = {leaf: i for i, leaf in enumerate(self.model.leaves)}
        p = self.model.probabilities(x)
        p = np.stack([p[:, at[leaf]] if leaf in at else np.zeros(len(x)) for leaf in leaves], axis=1) if leaves else np.zeros((len(x), 0))
        if self.blend is None or not leaves:
            return p

        def scaled(a: np.ndarray) -> np.ndarray:
            low, high = a.min(axis=1, keepdims=True), a.max(axis=1, keepdims=True)
            return np.where(high > low, (a - low) / np.where(high > low, high - low, 1), 0.0)

        return np.round(self.blend * scaled(p) + (1 - self.blend) * (1 - scaled(lb)), 6)


#: Queries that the navigator, one model, is fitted to on the driver.
NAVIGATOR_QUERIES = 100_000


def fit_navigator(queries: DataFrame, targets: DataFrame, leaves: list[int], width: int = 500, epochs: int = 100, rate: float = 0.5, seed: int = 1, most: int = NAVIGATOR_QUERIES):
    """A navigator fitted on the driver to the shares (query_id, leaf_id, share) of at most `most` queries, in the order of a hash."""
    from seriesgrove.functions.models import Navigator

    rows = queries.select("query_id", "values").orderBy(F.xxhash64("query_id", F.lit(seed)), "query_id").limit(most).toArrow()
    order = np.argsort(rows["query_id"].to_numpy())
    ids, x = rows["query_id"].to_numpy()[order], tree.matrix(rows["values"])[order]
    told = targets.join(queries.sparkSession.createDataFrame(pa.table({"query_id": ids})), "query_id", "left_semi").toArrow()
    y = np.zeros((len(ids), len(leaves)))
    y[np.searchsorted(ids, told["query_id"].to_numpy()), np.searchsorted(leaves, told["leaf_id"].to_numpy())] = told["share"].to_numpy()
    model = Navigator(x.shape[1], list(leaves), width)
    model.fit(x, y, epochs, rate, seed)
    return model


def navigator_probabilities(model, queries: DataFrame) -> DataFrame:
    """query_id, leaf_id, probability of every query, in tasks; the model is bounded by the number of leaves."""
    leaves = np.array(model.leaves, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                p = model.probabilities(tree.matrix(part.column(1)))
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(part.column(0).to_numpy(), len(leaves))), pa.array(np.tile(leaves, len(p))), pa.array(p.ravel())], names=["query_id", "leaf_id", "probability"])

    return queries.select(F.col("query_id").cast("long"), "values").mapInArrow(run, "query_id bigint, leaf_id bigint, probability double")


def cumulative_sizes(sizes: DataFrame) -> DataFrame:
    """leaf_id, first, size: the number of series in the leaves before, from 0, in order of id."""
    w = Window.orderBy("leaf_id").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select("leaf_id", F.coalesce(F.sum("size").over(w), F.lit(0)).alias("first"), "size")


def leaf_of_place(places: DataFrame, sizes: DataFrame) -> DataFrame:
    """The leaf that holds each place of the concatenated leaves: a range join with the table of leaves."""
    held = cumulative_sizes(sizes)
    return places.join(held, (F.col("place") >= F.col("first")) & (F.col("place") < F.col("first") + F.col("size"))).select("place", "leaf_id")


def synthetic_query_count(sizes: DataFrame, threshold: float, per_leaf: int) -> DataFrame:
    """One row: the queries to be made for the leaves of more than threshold series."""
    return sizes.agg((F.count_if(F.col("size") > threshold) * per_leaf).alias("n_queries"))


def navigated(order: DataFrame, pairs: DataFrame, most: int) -> DataFrame:
    """The pairs (query_id, leaf_id, ...) in each query's first `most` leaves of an order (query_id, leaf_id, place)."""
    return pairs.join(order.where(F.col("place") <= most).select("query_id", "leaf_id"), ["query_id", "leaf_id"], "left_semi")
