"""Conformal calibration of predictions: batches, alphas, recall and coverage, fits."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesgrove.functions import series as fn

GAP = 1e-4


def shuffled(key, salt):
    """A portable number by which keys are put in an order that looks random."""
    return F.pmod(key * 7919 + salt * 104729 + 12345, F.lit(10007))


def uniform_batches(ids: DataFrame, batches: int, seed: int = 1, key: str = "query_id") -> DataFrame:
    """key, batch_id: a shuffled order cut into equal batches, at most a third as many as keys; the last takes the remainder."""
    w = Window.orderBy(shuffled(F.col(key), F.lit(seed)), key)
    placed = ids.select(key).distinct().withColumn("_p", F.row_number().over(w) - 1).crossJoin(ids.select(key).distinct().agg(F.count("*").alias("_n")))
    count = F.greatest(F.lit(1), F.least(F.lit(batches), F.floor(F.col("_n") / 3)))
    size = F.greatest(F.lit(1), F.floor(F.col("_n") / count))
    return placed.select(key, F.least(F.floor(F.col("_p") / size), count - 1).cast("long").alias("batch_id"))


def combinatorial_batches(ids: DataFrame, batches: int, parts: int, take: int, seed: int = 1, key: str = "query_id") -> DataFrame:
    """key, batch_id, part: for each batch its own order, cut into parts, of which `take` are used; the last part takes the remainder."""
    every = ids.select(key).distinct().select(key, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(batches - 1).cast("long"))).alias("batch_id"))
    w = Window.partitionBy("batch_id").orderBy(shuffled(F.col(key), F.col("batch_id") + seed), key)
    n = F.count("*").over(Window.partitionBy("batch_id"))
    size = F.greatest(F.lit(1), F.floor(n / parts))
    placed = every.withColumn("part", F.least(F.floor((F.row_number().over(w) - 1) / size), F.lit(parts - 1)).cast("long"))
    rank = F.pmod(F.col("part") * 31 + F.col("batch_id") * 17 + seed, F.lit(101)) * 1000 + F.col("part")
    order = F.dense_rank().over(Window.partitionBy("batch_id").orderBy(rank))
    return placed.withColumn("_r", order).where(F.col("_r") <= take).drop("_r")


def residuals(predicted: DataFrame) -> DataFrame:
    """Adds error = |pred - lnn|; predictions out of range or zero are left out."""
    return predicted.where((F.col("pred") > -1e6) & (F.col("pred") < 1e6) & (F.col("pred") != 0)).withColumn("error", F.abs(F.col("pred") - F.col("lnn")))


def with_sentinels(errors: DataFrame, by: list[str]) -> DataFrame:
    """by, error: the errors, 0, and an upper sentinel above all of them, max(mean + 3 std + gap, max + gap)."""
    top = errors.groupBy(*by).agg(F.greatest(F.avg("error") + 3 * F.stddev_pop("error") + GAP, F.max("error") + GAP).alias("error"))
    return errors.select(*by, "error").unionByName(top).unionByName(top.withColumn("error", F.lit(0.0)))


def sorted_alphas(errors: DataFrame, by: list[str]) -> DataFrame:
    """by, error_i (from 0), alpha in rising order; groups of fewer than three are left out."""
    w = Window.partitionBy(*by)
    out = errors.withColumn("error_i", (F.row_number().over(w.orderBy("error")) - 1).cast("long")).withColumn("_n", F.count("*").over(w))
    return out.where("_n >= 3").select(*by, "error_i", F.col("error").alias("alpha"))


def alpha_at(alphas: DataFrame, by: list[str], confidence: float = 0.95) -> DataFrame:
    """The alpha at place floor(n * confidence)."""
    n = F.count("*").over(Window.partitionBy(*by))
    return alphas.withColumn("_n", n).where(F.col("error_i") == F.least(F.floor(F.col("_n") * confidence), F.col("_n") - 1)).select(*by, "alpha")


def _told(batches: DataFrame, knn: DataFrame, examples: DataFrame, alphas: DataFrame) -> DataFrame:
    """batch_id, query_id, leaf_id, error_i, n, visited: of each place, whether the leaves with a query's nearest series are visited."""
    places = alphas.select("error_i").distinct()
    wanted = batches.join(knn, "query_id", "left").join(examples.select("query_id", "leaf_id", "pred", "bsf"), ["query_id", "leaf_id"], "left")
    told = wanted.join(places).join(alphas, ["leaf_id", "batch_id", "error_i"] if "batch_id" in alphas.columns else ["leaf_id", "error_i"], "left")
    return told.withColumn("visited", F.col("alpha").isNull() | F.col("bsf").isNull() | (F.col("pred") - F.col("alpha") <= F.col("bsf")))


def batch_recall(batches: DataFrame, knn: DataFrame, examples: DataFrame, alphas: DataFrame, k: int) -> DataFrame:
    """batch_id, error_i, recall: how many of a batch's k * queries nearest series lie in leaves that are visited at that place.

    A leaf is visited if pred - alpha <= bsf, if nothing bounds it yet, or if it has no alpha there.
    """
    hits = _told(batches, knn, examples, alphas).groupBy("batch_id", "error_i").agg(F.sum(F.when(F.col("visited"), F.coalesce("n", F.lit(0))).otherwise(0)).alias("hits"))
    sizes = batches.groupBy("batch_id").agg(F.countDistinct("query_id").alias("queries"))
    return hits.join(sizes, "batch_id").select("batch_id", "error_i", (F.col("hits") / (F.lit(float(k)) * F.col("queries"))).alias("recall"))


def query_recall(batches: DataFrame, knn: DataFrame, examples: DataFrame, alphas: DataFrame, k: int) -> DataFrame:
    """batch_id, query_id, error_i, recall: the same for each query of a batch."""
    told = _told(batches, knn, examples, alphas)
    return told.groupBy("batch_id", "query_id", "error_i").agg((F.sum(F.when(F.col("visited"), F.coalesce("n", F.lit(0))).otherwise(0)) / F.lit(float(k))).alias("recall"))


def recall_coverage(recalls: DataFrame) -> DataFrame:
    """Adds coverage: the share of batches with this recall or more at the same place."""
    return recalls.withColumn("coverage", F.cume_dist().over(Window.partitionBy("error_i").orderBy(F.desc("recall"))))


def largest_alphas(alphas: DataFrame) -> DataFrame:
    """The largest alpha of all batches at each place of a leaf."""
    return alphas.groupBy("leaf_id", "error_i").agg(F.max("alpha").alias("alpha"))


def fit_surface(points: DataFrame) -> DataFrame:
    """leaf_id, coefficients, largest: least squares of alpha on 1, r, c, rc, r^2, c^2 over the points of each leaf."""

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        r, c = rows["recall"].to_numpy(), rows["coverage"].to_numpy()
        x = np.stack([np.ones_like(r), r, c, r * c, r * r, c * c], axis=1)
        found, *_ = np.linalg.lstsq(x, rows["alpha"].to_numpy(), rcond=None)
        return pd.DataFrame({"leaf_id": [rows["leaf_id"].iloc[0]], "coefficients": [found.tolist()], "largest": [float(rows["alpha"].max())], "low_recall": [float(r.min())], "high_recall": [float(r.max())]})

    return points.groupBy("leaf_id").applyInPandas(fit, "leaf_id bigint, coefficients array<double>, largest double, low_recall double, high_recall double")


def calibrate(batches: DataFrame, knn: DataFrame, examples: DataFrame, alphas: DataFrame, k: int, recall: float, coverage: float) -> DataFrame:
    """leaf_id, alpha for a target recall and coverage: recalls by batch, coverage, fit, evaluation.

    Where no place brackets the target recall, the largest alpha seen is used, which prunes least.
    """
    pairs = recall_coverage(batch_recall(batches, knn, examples, alphas, k))
    fitted = fit_surface(pairs.join(largest_alphas(alphas), "error_i").select("leaf_id", "recall", "coverage", "alpha"))
    value = fn.polynomial(F.col("coefficients"), F.lit(recall), F.lit(coverage))
    inside = (F.col("low_recall") < recall) & (F.col("high_recall") >= recall)
    return fitted.select("leaf_id", F.when(inside, F.least(value, F.col("largest"))).otherwise(F.col("largest")).alias("alpha"))


def rising(recalls: DataFrame, by: list[str], gap: float = GAP) -> DataFrame:
    """Recalls made strictly rising from the end backwards, each at least `gap` below the next."""
    lifted = F.col("recall") - F.col("error_i") * gap
    w = Window.partitionBy(*by).orderBy(F.desc("error_i"))
    return recalls.withColumn("recall", F.min(lifted).over(w) + F.col("error_i") * gap)


def steffen(points: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Adds the slope at each point of Steffen's monotone spline; at the ends that of the line to the next point."""
    w = Window.partitionBy(*by).orderBy(x)
    h1, h0 = F.lead(x).over(w) - F.col(x), F.col(x) - F.lag(x).over(w)
    s1, s0 = (F.lead(y).over(w) - F.col(y)) / h1, (F.col(y) - F.lag(y).over(w)) / h0
    p = (s0 * h1 + s1 * h0) / (h0 + h1)
    inner = (F.signum(s0) + F.signum(s1)) * F.least(F.abs(s0), F.abs(s1), 0.5 * F.abs(p))
    return points.withColumn("slope", F.coalesce(inner, s1, s0))


def hermite(points: DataFrame, by: list[str], x: str, y: str, at: float) -> DataFrame:
    """by, value: the spline with the given slopes at `at`, for groups whose points enclose it."""
    w = Window.partitionBy(*by).orderBy(x)
    rows = points.select(*by, F.col(x).alias("x0"), F.col(y).alias("y0"), F.col("slope").alias("m0"), F.lead(x).over(w).alias("x1"), F.lead(y).over(w).alias("y1"), F.lead("slope").over(w).alias("m1"))
    rows = rows.where((F.col("x0") <= at) & (F.col("x1") > at))
    h, t = F.col("x1") - F.col("x0"), (at - F.col("x0")) / (F.col("x1") - F.col("x0"))
    value = F.col("y0") * (1 + 2 * t) * (1 - t) * (1 - t) + F.col("m0") * h * t * (1 - t) * (1 - t) + F.col("y1") * t * t * (3 - 2 * t) + F.col("m1") * h * t * t * (t - 1)
    return rows.select(*by, value.alias("value"))


def durbin_watson(rows: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """by, dw: the sum of squared steps over the sum of squares."""
    w = Window.partitionBy(*by).orderBy(order)
    return rows.withColumn("_d", F.col(value) - F.lag(value).over(w)).groupBy(*by).agg((F.sum(F.col("_d") * F.col("_d")) / F.sum(F.col(value) * F.col(value))).alias("dw"))


def fit_batches(points: DataFrame) -> DataFrame:
    """leaf_id, batch_id, coefficients, fitted error: the surface over each batch's own alphas."""

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        r, c, y = (rows[n].to_numpy() for n in ("recall", "coverage", "alpha"))
        x = np.stack([np.ones_like(r), r, c, r * c, r * r, c * c], axis=1)
        found, *_ = np.linalg.lstsq(x, y, rcond=None)
        return pd.DataFrame({"leaf_id": [rows["leaf_id"].iloc[0]], "batch_id": [rows["batch_id"].iloc[0]], "coefficients": [found.tolist()], "mean_error": [float(np.abs(x @ found - y).mean())]})

    return points.groupBy("leaf_id", "batch_id").applyInPandas(fit, "leaf_id bigint, batch_id bigint, coefficients array<double>, mean_error double")


def statistic(residual: np.ndarray) -> float:
    """Durbin-Watson of residuals in their order."""
    total = float((residual**2).sum())
    return float((np.diff(residual) ** 2).sum()) / total if total else 2.0


def relevance(x: np.ndarray, y: np.ndarray, width: float, rounds: int = 300) -> tuple[np.ndarray, np.ndarray]:
    """Relevance vector regression with Gaussian kernels: the constant and the weights, and the places of the kept centres in x."""
    d2 = ((x[:, None] - x[None]) ** 2).sum(-1)
    phi = np.hstack([np.ones((len(x), 1)), np.exp(-d2 / (2 * width * width))])
    kept, precision, noise = np.arange(phi.shape[1]), np.ones(phi.shape[1]), 100.0 / max(float(y.var()), 1e-12)
    mean = np.zeros(len(kept))
    for _ in range(rounds):
        p = phi[:, kept]
        spread = np.linalg.pinv(np.diag(precision) + noise * p.T @ p)
        mean = noise * spread @ p.T @ y
        sure = np.clip(1 - precision * np.diag(spread), 1e-12, 1)
        precision = sure / np.maximum(mean**2, 1e-24)
        noise = max(len(y) - sure.sum(), 1e-6) / max(float(((y - p @ mean) ** 2).sum()), 1e-12)
        alive = precision < 1e9
        if not alive[0] and kept[0] == 0:
            alive[0] = True  # the constant stays
        kept, precision, mean = kept[alive], precision[alive], mean[alive]
    weights = np.zeros(phi.shape[1])
    weights[kept] = mean
    centres = kept[kept > 0] - 1
    return np.append(weights[0], weights[centres + 1]), centres


BIVARIATE = "leaf_id bigint, kind string, coefficients array<double>, centres array<struct<r:double,c:double,width:double>>"


def fit_bivariate(points: DataFrame, kernel: bool = False, width: float = 0.25) -> DataFrame:
    """BIVARIATE: linear for fewer than ten points or residuals without a trend (1 <= DW <= 3); else quadratic without a cross term, or a sum of kernels."""

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["recall", "coverage", "alpha"])
        r, c, y = (rows[n].to_numpy() for n in ("recall", "coverage", "alpha"))
        x = np.stack([np.ones_like(r), r, c, r * r, c * c], axis=1)
        line, *_ = np.linalg.lstsq(x[:, :3], y, rcond=None)
        kind, found, centres = "linear", [*line.tolist(), 0.0, 0.0], []
        if len(rows) >= 10 and not 1 <= statistic(y - x[:, :3] @ line) <= 3:
            if kernel:
                weights, at = relevance(x[:, 1:3], y, width)
                kind, found, centres = "kernel", weights.tolist(), [{"r": float(r[i]), "c": float(c[i]), "width": width} for i in at]
            else:
                kind, found = "quadratic", np.linalg.lstsq(x, y, rcond=None)[0].tolist()
        return pd.DataFrame({"leaf_id": [rows["leaf_id"].iloc[0]], "kind": [kind], "coefficients": [found], "centres": [centres]})

    return points.groupBy("leaf_id").applyInPandas(fit, BIVARIATE)


def bivariate_alphas(fits: DataFrame, recall: float, coverage: float) -> DataFrame:
    """leaf_id, alpha of BIVARIATE fits at a recall and a coverage."""
    return fits.select("leaf_id", fn.bivariate(F.col("kind"), F.col("coefficients"), F.col("centres"), F.lit(recall), F.lit(coverage)).alias("alpha"))


def alpha_by_recall_spline(recalls: DataFrame, alphas: DataFrame, target: float, core: str = "steffen") -> DataFrame:
    """leaf_id, alpha of one calibration set by a spline from recall to alpha: 0 if the least recall exceeds the target, the largest alpha if none reaches it.

    recalls: error_i, recall; alphas: leaf_id, error_i, alpha. Recalls are made strictly rising first.
    """
    told = recalls.withColumn("_one", F.lit(0))
    points = alphas.join(rising(told, ["_one"]).select("error_i", "recall"), "error_i").select("leaf_id", "recall", "alpha")
    sloped = steffen(points, ["leaf_id"], "recall", "alpha") if core == "steffen" else cubic(points, "recall", "alpha")
    ends = points.groupBy("leaf_id").agg(F.min("recall").alias("low"), F.max("recall").alias("high"), F.max("alpha").alias("largest"))
    value = hermite(sloped, ["leaf_id"], "recall", "alpha", target)
    out = ends.join(value, "leaf_id", "left")
    return out.select("leaf_id", F.when(F.col("low") > target, 0.0).when(F.col("value").isNull(), F.col("largest")).otherwise(F.greatest(F.lit(0.0), F.col("value"))).alias("alpha"))


def cleared(alphas: DataFrame) -> DataFrame:
    """No alphas, of the same columns: what a calibration that starts anew begins with."""
    return alphas.limit(0)


def alpha_for_recall(recalls: DataFrame, alphas: DataFrame, target: float) -> DataFrame:
    """leaf_id, alpha of one calibration set: 0 if the least recall exceeds the target, else that of the first place that reaches it.

    recalls: error_i, recall in rising order of place; where no place reaches the target, the largest alpha.
    """
    reached = recalls.agg(F.min("recall").alias("least"), F.min(F.when(F.col("recall") >= target, F.col("error_i"))).alias("place"), F.max("error_i").alias("last"))
    told = alphas.join(reached).where(F.col("error_i") == F.coalesce("place", "last"))
    return told.select("leaf_id", F.when(F.col("least") > target, 0.0).otherwise(F.col("alpha")).alias("alpha"))


def cubic_slopes(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Slopes of the natural cubic spline through the points, for hermite(); two points give a line."""
    n = len(x)
    if n < 2:
        return np.zeros(n)
    h, s = np.diff(x), np.diff(y) / np.diff(x)
    a, b = np.zeros((n, n)), np.zeros(n)
    a[0, :2], b[0] = (2, 1), 3 * s[0]
    a[-1, -2:], b[-1] = (1, 2), 3 * s[-1]
    for i in range(1, n - 1):
        a[i, i - 1 : i + 2] = h[i], 2 * (h[i - 1] + h[i]), h[i - 1]
        b[i] = 3 * (h[i] * s[i - 1] + h[i - 1] * s[i])
    return np.linalg.solve(a, b)


def cubic(points: DataFrame, x: str, y: str) -> DataFrame:
    """Adds the slope of the natural cubic spline of each leaf."""
    schema = T.StructType([*points.schema.fields, T.StructField("slope", T.DoubleType())])

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(x)
        return rows.assign(slope=cubic_slopes(rows[x].to_numpy(float), rows[y].to_numpy(float)))

    return points.groupBy("leaf_id").applyInPandas(fit, schema)
