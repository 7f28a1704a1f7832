"""Cutting lineage in the shared folder, and connected components."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cut(frame: DataFrame) -> DataFrame:
    """The rows, written once to the folder that spark.checkpoint.dir names.

    Where that is unset, as in tests, a folder of our own serves a session of one process, and any other is an error: its
    hosts would not see each other's files. With spark.cleaner.referenceTracking.cleanCheckpoints Spark removes the files
    of rows that are no longer used.
    """
    context = frame.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all hosts share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    return frame.checkpoint(eager=True)


#: Has Spark remove the shuffles of a query as soon as it has ended.
CLEAR = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut_clear(frame: DataFrame) -> DataFrame:
    """cut(); the shuffles that made the rows are removed then and there, not when the JVM's collector finds them."""
    conf = frame.sparkSession.conf
    was = conf.get(CLEAR, None)
    conf.set(CLEAR, "true")
    try:
        return cut(frame.select("*"))  # a query takes the setting when it is made
    finally:
        if was is None:
            conf.unset(CLEAR)
        else:
            conf.set(CLEAR, was)


def _min_neighbour(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))


def components(edges: DataFrame) -> DataFrame:
    """(id, label) of every node of the edges (u, v), label being the least id that can be reached.

    Alternating large-star and small-star steps (Kiveris et al., 2014): each is one aggregation and one join on edges
    alone, and each keeps at most as many edges as there were. Loops and repeated edges are allowed. Nothing is
    gathered in one task: a hub's minimum is aggregated before the shuffle, and its edges are joined to it, so that a
    large partition can be split.
    """
    pairs = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    pairs, before = cut(pairs), None
    while True:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_min_neighbour(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = _min_neighbour(large)
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        pairs = cut(small.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        now = tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    roots = pairs.select(F.col("v").alias("id")).distinct().select("id", F.col("id").alias("label"))
    return pairs.select(F.col("u").alias("id"), F.col("v").alias("label")).unionByName(roots)
