"""Headerless files of 32-bit floats, rows of one length, and series from other tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_raw(spark: SparkSession, path: str, length: int, id_col: str = "series_id") -> DataFrame:
    """id and values of each row of the file or files, ids by place.

    Files are split by records in the JVM, so tasks read parts of one file, and whole batches are turned into rows by
    numpy. A row's id is its place in its part after the rows of the parts before, which one pass counts. A file whose
    size is no multiple of a row is refused by the reader.
    """
    records = spark.sparkContext._jsc.binaryRecords(path, 4 * length).rdd()
    rows = DataFrame(spark._jsparkSession.createDataset(records, spark._jvm.org.apache.spark.sql.Encoders.BINARY()).toDF(), spark)
    placed = rows.select(F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("at"), "value")
    first, offsets = 0, {}
    for r in placed.groupBy("part").agg(F.count("*").alias("n")).orderBy("part").collect():  # one row a part
        offsets[r.part], first = first, first + r.n

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(1).to_numpy() + np.array([offsets[p] for p in b.column(0).to_pylist()], np.int64)
            flat = np.frombuffer(b"".join(b.column(2).to_pylist()), "<f4").astype(np.float32)
            ends = np.arange(0, len(flat) + 1, length, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=[id_col, "values"])

    return placed.mapInArrow(read, f"{id_col} bigint, values array<float>")


def write_raw(series: DataFrame, path: str, id_col: str = "series_id") -> int:
    """The values in order of id, as one headerless file at any path that Spark knows; rows stream through the driver, a block at a time."""
    spark = series.sparkSession
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)
    n = 0
    try:
        for row in raw_parts(series, id_col).orderBy("first").toLocalIterator():
            out.write(bytearray(row.data))
            n += row.n
    finally:
        out.close()
    return n


def raw_parts(series: DataFrame, id_col: str = "series_id", rows: int = 1 << 16) -> DataFrame:
    """first, n, data: the values in order of id as raw bytes, at most `rows` in a row; made by tasks, to be written as Parquet where one file is too much for one host."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, rows):
                part = b.slice(lo, rows)
                data = part.column(1).flatten().to_numpy(zero_copy_only=False).astype("<f4").tobytes()
                yield pa.RecordBatch.from_arrays([part.column(0).slice(0, 1), pa.array([part.num_rows], pa.int64()), pa.array([data], pa.binary())], names=["first", "n", "data"])

    return series.select(F.col(id_col).cast("long"), "values").orderBy(id_col).mapInArrow(pack, "first bigint, n bigint, data binary")


def with_sketch(series: DataFrame, sketches: DataFrame, id_col: str = "series_id") -> DataFrame:
    """Adds each series' shorter summary from a second table."""
    return series.join(sketches.select(id_col, F.col("values").alias("sketch")), id_col, "left")


def from_rows(rows: DataFrame, key: str, position, value, length: int) -> DataFrame:
    """Series from rows: for each key the sum of `value` at every position below `length`, 0 where there is none."""
    sums = rows.select(F.col(key).alias("series_id"), position.cast("int").alias("p"), value.cast("double").alias("v")).where((F.col("p") >= 0) & (F.col("p") < length)).groupBy("series_id", "p").agg(F.sum("v").alias("v"))
    held = sums.groupBy("series_id").agg(F.map_from_entries(F.collect_list(F.struct("p", "v"))).alias("m"))
    return held.select("series_id", F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda i: F.coalesce(F.element_at("m", i), F.lit(0.0))).alias("values"))
