"""Structured Streaming: windowed counts, restartable ingestion without duplicates, and messages by thread."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def file_stream(spark: SparkSession, path: str, schema: StructType, files: int = 100, pattern: str = "*.parquet") -> DataFrame:
    """Parquet files below a path as a stream, so many a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("pathGlobFilter", pattern).parquet(path)


def window_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours", time: str = "ts") -> DataFrame:
    """start, event_type, n and total of each window; the same expression for streams and tables."""
    rows = events.withColumn(time, F.col(time).cast("timestamp"))
    if events.isStreaming:
        rows = rows.withWatermark(time, late)
    counted = rows.groupBy(F.window(time, width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return counted.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def once_each(rows: DataFrame, late: str = "1 day", key: str = "content_hash", time: str = "ts") -> DataFrame:
    """Each key once; a stream keeps state only within the watermark."""
    if rows.isStreaming:
        return rows.withWatermark(time, late).dropDuplicatesWithinWatermark([key])
    return rows.dropDuplicates([key])


def run_available(rows: DataFrame, target: str, checkpoint: str, mode: str = "append") -> None:
    """Takes what is there into Parquet and ends; a restart goes on where it ended."""
    rows.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()


def each_batch(rows: DataFrame, work, checkpoint: str) -> None:
    """Calls work(batch, number) for each batch of what is there; a failing batch is tried again on restart."""
    rows.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def thread_counts(messages: DataFrame, by: str = "conv_id") -> DataFrame:
    """Messages by thread, as running state of a stream or a plain count."""
    return messages.groupBy(by).agg(F.count("*").alias("n_messages"), F.max("turn").alias("last_turn"))


def thread_states(messages: DataFrame, n: int = 3, by: str = "conv_id", idle_days: int | None = None) -> DataFrame:
    """by, n_messages, last_turn and the last n texts of each thread that a batch touches, by a state of its own.

    The state keeps a count and n turns, whatever the thread's length. With idle_days, threads without a turn for so
    long are dropped; such a stream never ends by itself, so it is for continuous triggers.
    A turn that isn't later than the last one is a repetition and changes nothing. Turns of a batch are taken in order.
    """
    kind = messages.schema[by].dataType.simpleString()

    def step(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        count, last, kept = state.get if state.exists else (0, -1, "[]")
        recent = json.loads(kept)
        for turn, text in sorted((int(t), x) for p in parts for t, x in zip(p["turn"], p["text"], strict=True)):
            if turn > last:
                count, last, recent = count + 1, turn, [*recent, text][-n:]
        state.update((count, last, json.dumps(recent)))
        if idle_days:
            state.setTimeoutDuration(idle_days * 86_400_000)
        yield pd.DataFrame({by: [key[0]], "n_messages": [count], "last_turn": [last], "recent": [recent]})

    return messages.select(by, "turn", "text").groupBy(by).applyInPandasWithState(step, f"{by} {kind}, n_messages long, last_turn long, recent array<string>", "n long, last long, kept string", "update", "ProcessingTimeTimeout" if idle_days else "NoTimeout")
