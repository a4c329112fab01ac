"""Streams into collections: each micro-batch is one upsert, taken in exactly once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.operators.collection import Collection


def stream_upsert(stream: DataFrame, collection: Collection, checkpoint: str, name: str = "ingest", available_now: bool = False, trigger: str = "10 seconds") -> StreamingQuery:
    """Start taking a stream (columns pk, fields, perhaps seq) into a collection. The batch's number is committed with its rows
    in one manifest, so a batch that Spark repeats after a failure changes nothing."""

    def take(batch: DataFrame, number: int) -> None:
        collection.upsert_df(batch, (name, number))

    writer = stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).queryName(name)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=trigger)).start()


def windowed_counts(events: DataFrame, time: str, keys: list[str], value: str, size: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts and sums by event-time window and keys; for streams with a watermark, for tables as they are."""
    own = events.withWatermark(time, late) if events.isStreaming else events
    w = F.window(time, size, slide) if slide else F.window(time, size)
    out = own.groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "n", "total")


def sessions(events: DataFrame, time: str, key: str, gap: str, late: str = "10 minutes") -> DataFrame:
    """Sessions of a key that end after a gap without events."""
    own = events.withWatermark(time, late) if events.isStreaming else events
    out = own.groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), key, "n")
