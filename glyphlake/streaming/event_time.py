"""Event-time windows with watermarks, for batches and streams alike. A batch has no late rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def windowed(events: DataFrame, size: str, late: str, keys: list[str], measures: list[Column], slide: str | None = None) -> DataFrame:
    """events(ts, ...) in tumbling windows, or sliding ones: start, the keys and the measures. Rows later than ``late`` are left out of a stream."""
    by = F.window("ts", size, slide) if slide else F.window("ts", size)
    rows = events.withWatermark("ts", late).groupBy(by.alias("w"), *keys).agg(*measures)
    return rows.select(F.col("w.start").alias("start"), *[c for c in rows.columns if c != "w"])


def sessions(events: DataFrame, gap: str, late: str, keys: list[str], measures: list[Column]) -> DataFrame:
    """events(ts, ...) in sessions that end after a gap: start, stop (the gap included), the keys and the measures."""
    rows = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), *keys).agg(*measures)
    return rows.select(F.col("w.start").alias("start"), F.col("w.end").alias("stop"), *[c for c in rows.columns if c != "w"])


def followed(first: DataFrame, then: DataFrame, key: str, within: str, late: str) -> DataFrame:
    """first(key, ts, ...) joined with then(key, then_ts, ...) of the same key that come no more than ``within`` later."""
    a, b = first.withWatermark("ts", late), then.withWatermark("then_ts", late).withColumnRenamed(key, "_key")
    near = (F.col(key) == F.col("_key")) & (F.col("then_ts") >= F.col("ts")) & (F.col("then_ts") <= F.col("ts") + F.expr(f"interval {within}"))
    return a.join(b, near).drop("_key")
