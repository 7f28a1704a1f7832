"""Queries that arrive as a stream, answered over a static index micro-batch by micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from seriesgrove.operators import search


def answer_stream(queries: DataFrame, index: search.Index, k: int, path: str, checkpoint: str, exclude_self: bool = False) -> StreamingQuery:
    """Starts a stream that writes the answers of each batch of (query_id, values) to path; a batch that runs again overwrites its own answers."""

    def each(batch: DataFrame, number: int) -> None:
        answers, _ = search.exact(batch.select("query_id", "values"), index, k, exclude_self)
        answers.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return queries.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
