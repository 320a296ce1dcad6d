"""Incremental upserts and duplicate suppression with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from rolefunnel.operators.store import BucketTable


def upsert_stream(
    stream: DataFrame,
    table: BucketTable,
    checkpoint: str,
    merge: Callable[[DataFrame, DataFrame], DataFrame],
    prepare: Callable[[DataFrame], DataFrame] = lambda batch: batch,
) -> StreamingQuery:
    """Merge every micro-batch into the buckets it touches.

    A batch that is replayed after a failure merges to the same rows again.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        rows = prepare(batch).persist()  # read for its buckets and for the merge
        table.merge(rows, merge)
        rows.unpersist()

    return (
        stream.writeStream.foreachBatch(apply)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def suppress_repeats(stream: DataFrame, keys: list[str], event_time: str, horizon: str) -> DataFrame:
    """First sight of every key within ``horizon``; state older than that is dropped."""
    return stream.withWatermark(event_time, horizon).dropDuplicatesWithinWatermark(keys)


def append_stream(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
