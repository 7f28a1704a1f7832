"""Writing and reading indexes and what belongs to them, as Parquet."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesgrove.operators import search, tree


def save_index(index: search.Index, path: str) -> None:
    """nodes, envelopes, and members partitioned by leaf, so that a search reads only the leaves it wants; a large leaf is written by several tasks."""
    spark = index.members.sparkSession
    tree.to_frame(spark, index.nodes).coalesce(1).write.mode("overwrite").parquet(f"{path}/nodes")
    rows = [(leaf, i, index.sizes[leaf], *map(float, seg)) for leaf, e in index.envelopes.items() for i, seg in enumerate(e)]
    spark.createDataFrame(rows, "leaf_id bigint, seg int, n bigint, start double, len double, min_mean double, max_mean double, min_std double, max_std double").coalesce(1).write.mode("overwrite").parquet(f"{path}/envelopes")
    n = max(1, min(len(index.sizes), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    index.members.repartitionByRange(n, "leaf_id", "series_id").sortWithinPartitions("leaf_id").write.mode("overwrite").partitionBy("leaf_id").parquet(f"{path}/members")


def load_index(spark: SparkSession, path: str) -> search.Index:
    import numpy as np

    held: dict[int, list] = {}
    sizes: dict[int, int] = {}
    for r in spark.read.parquet(f"{path}/envelopes").orderBy("leaf_id", "seg").collect():  # at most max_leaves leaves
        held.setdefault(r.leaf_id, []).append((r.start, r.len, r.min_mean, r.max_mean, r.min_std, r.max_std))
        sizes[r.leaf_id] = r.n
    members = spark.read.parquet(f"{path}/members").withColumn("leaf_id", F.col("leaf_id").cast("long"))
    return search.Index(tree.from_frame(spark.read.parquet(f"{path}/nodes")), members, {k: np.array(v) for k, v in held.items()}, sizes, "sketch" in members.columns)


def save_table(frame: DataFrame, path: str, name: str) -> None:
    """filters, examples, batches, alphas, knn_leaves or queries of an index; calibration batches are kept, so that a reloaded index can be calibrated."""
    frame.write.mode("overwrite").parquet(f"{path}/{name}")


def load_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}")


def save_by_leaf(frame: DataFrame, path: str) -> None:
    """Rows of leaves, such as local examples, in a folder for each leaf."""
    frame.repartition("leaf_id").write.mode("overwrite").partitionBy("leaf_id").parquet(path)


def load_by_leaf(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).withColumn("leaf_id", F.col("leaf_id").cast("long"))


def save_ids_text(batches: DataFrame, path: str) -> None:
    """The queries of each calibration batch as text lines: batch, query."""
    batches.select(F.concat_ws(" ", "batch_id", "query_id").alias("value")).write.mode("overwrite").text(path)


def load_ids_text(spark: SparkSession, path: str) -> DataFrame:
    part = F.split("value", " ")
    return spark.read.text(path).select(part[1].cast("long").alias("query_id"), part[0].cast("long").alias("batch_id"))


#: What a stored set of alphas may hold.
MOST_BATCHES, MOST_VALUES = 100, 10_000
CORES = ("discrete", "histogram", "spline", "cubic", "steffen")


def alphas_text(alphas: DataFrame) -> DataFrame:
    """leaf_id, text: the alphas of a leaf as lines TYPE_SIZE=, NUM_BATCHES=, and for each batch BATCH_i_SIZE= and its values in order of place."""
    w = alphas.groupBy("leaf_id", "batch_id").agg(F.array_sort(F.collect_list(F.struct("error_i", "alpha"))).alias("a"))
    each = w.select("leaf_id", "batch_id", F.transform("a", lambda p: p["alpha"]).alias("a"))
    held = each.groupBy("leaf_id").agg(F.array_sort(F.collect_list(F.struct("batch_id", "a"))).alias("b"))
    lines = F.transform("b", lambda p, i: F.concat_ws("\n", F.concat(F.lit("BATCH_"), i.cast("string"), F.lit("_SIZE="), F.size(p["a"]).cast("string")), F.concat_ws("\n", F.transform(p["a"], lambda x: x.cast("string")))))
    return held.select("leaf_id", F.concat(F.concat_ws("\n", F.lit("TYPE_SIZE=8"), F.concat(F.lit("NUM_BATCHES="), F.size("b").cast("string")), F.concat_ws("\n", lines))).alias("text"))


def parse_alphas(text: str) -> list[list[float]]:
    """The values of each batch of a text of alphas; a text that is not one, or holds too much, is an error."""
    lines = iter(text.split("\n"))

    def number(name: str, most: int) -> int:
        key, _, value = next(lines, "").partition("=")
        if key != name or not value.isascii() or not value.isdecimal() or len(value) > 9 or int(value) > most:
            raise ValueError(f"not a text of alphas: {name}")
        return int(value)

    number("TYPE_SIZE", 16)
    out = []
    for i in range(number("NUM_BATCHES", MOST_BATCHES)):
        out.append([float(next(lines, "")) for _ in range(number(f"BATCH_{i}_SIZE", MOST_VALUES))])
    return out


def save_alphas_text(alphas: DataFrame, path: str) -> None:
    """A text of the alphas of each leaf, in folders by leaf."""
    alphas_text(alphas).repartition("leaf_id").write.mode("overwrite").partitionBy("leaf_id").text(path)


def load_alphas_text(spark: SparkSession, path: str) -> DataFrame:
    """leaf_id, batch_id, error_i, alpha of the texts of save_alphas_text()."""

    def read(batches):
        for rows in batches:
            found = [(leaf, b, i, x) for leaf, text in zip(rows["leaf_id"], rows["value"], strict=True) for b, values in enumerate(parse_alphas(text)) for i, x in enumerate(values)]
            yield pd.DataFrame(found, columns=["leaf_id", "batch_id", "error_i", "alpha"])

    texts = spark.read.text(path, wholetext=True).select(F.col("leaf_id").cast("long").alias("leaf_id"), "value")
    return texts.mapInPandas(read, "leaf_id bigint, batch_id bigint, error_i bigint, alpha double")


def with_core(filters: DataFrame, core: str) -> DataFrame:
    """Filters with the kind of their conformal core, as it is stored."""
    if core not in CORES:
        raise ValueError(f"not a conformal core: {core!r}")
    return filters.withColumn("core", F.lit(core))
