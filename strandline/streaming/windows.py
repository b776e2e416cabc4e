"""Event-time aggregates over streams and tables: tumbling, sliding and session windows with a watermark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _windowed(events: DataFrame, ts: str, window: Column, keys: list[str], aggs: list[Column], late: str | None) -> DataFrame:
    if late and events.isStreaming:
        events = events.withWatermark(ts, late)
    out = events.groupBy(window.alias("w"), *keys).agg(*aggs)
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *[c for c in out.columns if c != "w"])


def tumbling(events: DataFrame, ts: str, size: str, keys: list[str], *aggs: Column, late: str | None = "1 hour") -> DataFrame:
    return _windowed(events, ts, F.window(ts, size), keys, list(aggs), late)


def sliding(events: DataFrame, ts: str, size: str, step: str, keys: list[str], *aggs: Column, late: str | None = "1 hour") -> DataFrame:
    return _windowed(events, ts, F.window(ts, size, step), keys, list(aggs), late)


def sessions(events: DataFrame, ts: str, gap: str, keys: list[str], *aggs: Column, late: str | None = "1 hour") -> DataFrame:
    return _windowed(events, ts, F.session_window(ts, gap), keys, list(aggs), late)
