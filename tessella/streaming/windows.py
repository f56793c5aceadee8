"""Windowed aggregates that run alike over tables and streams: tumbling, sliding and session windows, and first-seen rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _late(df: DataFrame, time: str, delay: str | None) -> DataFrame:
    """A watermark for streams; a table has no late rows."""
    return df.withWatermark(time, delay) if delay and df.isStreaming else df


def tumbling(df: DataFrame, time: str, width: str, by: list[str], *aggs: Column, delay: str | None = None) -> DataFrame:
    out = _late(df, time, delay).groupBy(F.window(time, width).alias("_w"), *by).agg(*aggs)
    return out.select(F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), *[c for c in out.columns if c != "_w"])


def sliding(df: DataFrame, time: str, width: str, step: str, by: list[str], *aggs: Column, delay: str | None = None) -> DataFrame:
    out = _late(df, time, delay).groupBy(F.window(time, width, step).alias("_w"), *by).agg(*aggs)
    return out.select(F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), *[c for c in out.columns if c != "_w"])


def sessions(df: DataFrame, time: str, gap: str, by: list[str], *aggs: Column, delay: str | None = None) -> DataFrame:
    out = _late(df, time, delay).groupBy(F.session_window(time, gap).alias("_w"), *by).agg(*aggs)
    return out.select(F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), *[c for c in out.columns if c != "_w"])


def first_seen(df: DataFrame, time: str, keys: list[str], delay: str) -> DataFrame:
    """One row for each key; a stream forgets keys after `delay`."""
    return df.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys) if df.isStreaming else df.dropDuplicates(keys)


def write_each(df: DataFrame, sink, checkpoint: str, once: bool = True):
    """Run a stream into `sink(batch, id)`; with `once`, all that is there now."""
    writer = df.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
