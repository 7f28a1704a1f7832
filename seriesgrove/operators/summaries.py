"""Summaries of series (mean and deviation by segment), envelopes of groups, and the lower bound on distances.

For a segment of length n, a query's distance to a group's range of means and of
deviations bounds the squared Euclidean distance to every member:
lb2 = sum of n * (d_mean ** 2 + d_std ** 2).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesgrove.functions import series as fn


def eapca(series: DataFrame, id_col: str = "series_id", values: str = "values", parts: list[tuple[int, int]] | None = None, length: int | None = None) -> DataFrame:
    """id, seg, start, len, mean, std: one row for each series and segment (the whole and its halves, if not told)."""
    if parts is None:
        parts = [(0, length), *halve(0, length)]
    rows = series.select(id_col, F.posexplode(fn.segment_stats(F.col(values), parts)).alias("seg", "s"))
    return rows.select(id_col, F.col("seg").cast("long").alias("seg"), F.col("s.start").cast("long").alias("start"), F.col("s.len").cast("long").alias("len"), F.col("s.mean").alias("mean"), F.col("s.std").alias("std"))


def halve(start: int, length: int) -> list[tuple[int, int]]:
    return [(start, length // 2), (start + length // 2, length - length // 2)]


def refine(parts: list[tuple[int, int]], which: int) -> list[tuple[int, int]]:
    """The segments after a vertical split of one of them."""
    return [*parts[:which], *halve(*parts[which]), *parts[which + 1 :]]


def envelopes(summaries: DataFrame, group: str = "leaf_id") -> DataFrame:
    """The ranges of means and of deviations of each group and segment; minimum and maximum are independent."""
    return summaries.groupBy(group, "seg", "start", "len").agg(F.min("mean").alias("min_mean"), F.max("mean").alias("max_mean"), F.min("std").alias("min_std"), F.max("std").alias("max_std"), F.count("*").alias("n"))


def outside(x: Column, low: Column, high: Column) -> Column:
    """The distance of a number to a range."""
    return F.greatest(F.lit(0.0), low - x, x - high)


def lower_bounds(queries: DataFrame, ranges: DataFrame, group: str = "leaf_id") -> DataFrame:
    """query_id, group, lb2 for each query and group; queries: summaries with query_id.

    Joined by segment: a row for each query, group and segment, as many as there are bounds to compute.
    """
    q = queries.select("query_id", "seg", F.col("mean").alias("_m"), F.col("std").alias("_s"))
    gap = F.pow(outside(F.col("_m"), F.col("min_mean"), F.col("max_mean")), 2) + F.pow(outside(F.col("_s"), F.col("min_std"), F.col("max_std")), 2)
    return q.join(ranges, "seg").groupBy("query_id", group).agg(F.sum(F.col("len") * gap).alias("lb2"))


def upper_bounds(queries: DataFrame, ranges: DataFrame, group: str = "leaf_id") -> DataFrame:
    """query_id, group, ub2: no member of the group is farther. Of a segment the means differ by d_mean at most, and
    what is left of both series after their means by std + max_std at most: ub2 = sum of n * (d_mean ** 2 + (std + max_std) ** 2)."""
    q = queries.select("query_id", "seg", F.col("mean").alias("_m"), F.col("std").alias("_s"))
    gap = F.greatest(F.abs(F.col("_m") - F.col("min_mean")), F.abs(F.col("_m") - F.col("max_mean")))
    far = F.pow(gap, 2) + F.pow(F.col("_s") + F.col("max_std"), 2)
    return q.join(ranges, "seg").groupBy("query_id", group).agg(F.sum(F.col("len") * far).alias("ub2"))
