"""Streams as Structured Streaming queries: appends, reads, consumer groups, counters, channels."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.functions.ranges import matches


def follow(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 16) -> DataFrame:
    """XREAD BLOCK: the entries that arrive under a folder; the checkpoint of the query is the last id read."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def channels(messages: DataFrame, patterns: list[str]) -> DataFrame:
    """PSUBSCRIBE: messages (channel, message) whose channel matches one of the globs."""
    hit = F.lit(False)
    for p in patterns:
        hit = hit | matches(F.col("channel"), p)
    return messages.filter(hit)


def windowed(entries: DataFrame, time: str, late: str, width: str) -> DataFrame:
    """Counts and sums per key and time window; entries later than ``late`` are refused, as an id before the last is."""
    return entries.withWatermark(time, late).groupBy(F.window(time, width), "key").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def counters(log: DataFrame) -> DataFrame:
    """INCRBY over a stream of (key, delta): running totals per key, in update mode."""
    return log.groupBy("key").agg(F.sum("delta").alias("value"))


def consumers(entries: DataFrame, names: list[str]) -> DataFrame:
    """XREADGROUP: every new entry of (key, ms, seq) goes to one consumer, in turn, and is pending there.

    State per key is one counter, whatever the length of the stream, so it neither grows nor needs a timeout; a restart
    goes on from the checkpoint and hands nothing out twice.
    """

    def run(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        at = state.get[0] if state.exists else 0
        rows = pd.concat(list(batches), ignore_index=True).sort_values(["ms", "seq"])
        turn = (at + pd.RangeIndex(len(rows))) % len(names)
        state.update((at + len(rows),))
        out = pd.DataFrame({"key": key[0], "ms": rows["ms"].to_numpy(), "seq": rows["seq"].to_numpy(), "consumer": [names[i] for i in turn]})
        yield out.astype({"key": object, "consumer": object})

    return entries.groupBy("key").applyInPandasWithState(run, "key string, ms long, seq long, consumer string", "n long", "append", "NoTimeout")
