"""Streams of versions: late rows become new versions, only repeated ones are dropped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators.versioned import best_per_key
from tidemark.operators.writers import VersionStore


def source(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    """Parquet files as they arrive; the checkpoint keeps what has been read."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def append_versions(stream: DataFrame, store: VersionStore, checkpoint: str, *, order: str, version: Column | None = None, snapshot_every: int = 50) -> StreamingQuery:
    """Runs what has arrived through the store's change test; of a batch's rows for a key the last by ``order`` counts.

    A batch that runs again after a failure finds its rows stored and unchanged.  The store is snapshot after every
    ``snapshot_every`` batches, so that a long stream doesn't read its whole history for each.
    """

    def write(batch: DataFrame, n: int) -> None:
        store.append_changed(best_per_key(batch, store.keys, [F.col(order).desc(), F.xxhash64("*")]), version if version is not None else F.col(order))
        if (n + 1) % snapshot_every == 0:
            store.snapshot()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def deduplicated(stream: DataFrame, keys: list[str], time: str, late: str = "2 days") -> DataFrame:
    """Each key once within the watermark."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def windowed(stream: DataFrame, time: str, size: str, aggs: list[Column], *, slide: str | None = None, start: str | None = None, by: tuple[str, ...] = (), late: str = "2 days") -> DataFrame:
    """Aggregates over windows: tumbling, or sliding with ``slide``; ``start`` shifts them from midnight UTC."""
    return stream.withWatermark(time, late).groupBy(F.window(time, size, slide, start), *by).agg(*aggs)


def sessions(stream: DataFrame, time: str, gap: str | Column, aggs: list[Column], *, by: tuple[str, ...] = (), late: str = "2 days") -> DataFrame:
    """Aggregates over sessions: rows of a key that follow each other within ``gap``, which may be a column."""
    return stream.withWatermark(time, late).groupBy(F.session_window(time, gap), *by).agg(*aggs)


def report_days(stream: DataFrame, time: str, aggs: list[Column], **kw: object) -> DataFrame:
    """Days that begin at 17:00 UTC."""
    return windowed(stream, time, "1 day", aggs, start="17 hours", **kw)
