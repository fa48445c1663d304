"""Structured Streaming around the index and the event log."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillspark.operators import index as I
from quillspark.sources.events import EventLog, parsed
from quillspark.sources.store import IndexStore

BATCH_FILES = 128


def index_stream(store: IndexStore, root: str, log: EventLog, checkpoint: str, batch_files: int = BATCH_FILES) -> StreamingQuery:
    """Keep the index up to date with the paths that the event log names; stops when the log is read to its end.

    Each micro-batch applies its distinct paths. A batch that is run again after a failure finds its files unchanged, so
    nothing is applied twice.
    """

    def apply(batch: DataFrame, _: int) -> None:
        paths = parsed(batch).filter("path is not null").select(F.col("path").alias("normalized_path")).distinct()
        if paths.head(1):
            I.apply_changes(store, root, paths)

    return log.stream(store.spark, batch_files).writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_sink(events: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append a stream of events to Parquet files, each event once."""
    return events.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_stream(source: DataFrame, key: str, order: str, emit: Callable[[DataFrame], None], checkpoint: str) -> StreamingQuery:
    """The latest row per key of each micro-batch, handed to `emit`."""

    def apply(batch: DataFrame, _: int) -> None:
        cols = [c for c in batch.columns if c != key]
        last = batch.groupBy(key).agg(F.max_by(F.struct(*cols), F.col(order)).alias("v")).select(key, *[F.col(f"v.{c}").alias(c) for c in cols])
        emit(last)

    return source.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
