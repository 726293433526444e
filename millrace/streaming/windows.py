"""Extensions: keyed aggregation by event-time windows, in batch and in streams.

These use Spark's own windows. In streams a watermark of the window's grace period
lets state go and rows come out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.plans import spec as S


def _timed(df: DataFrame, grace_secs: int) -> DataFrame:
    timed = df.withColumn("_ts", F.timestamp_millis("event_time_ms"))
    return timed.withWatermark("_ts", f"{grace_secs} seconds") if df.isStreaming else timed


def _bounds(w: Column) -> list[Column]:
    return [F.unix_millis(w.getField("start")).alias("start_epoch_ms"), F.unix_millis(w.getField("end")).alias("end_epoch_ms")]


def window_aggregate(df: DataFrame, op: S.Window, keys: dict[str, Column], measures: dict[str, Column]) -> DataFrame:
    """Aggregates by key and window; a sliding window puts an event in size / slide of them."""
    slide = f"{op.slide_secs} seconds" if op.window == "sliding" else None
    w = F.window("_ts", f"{op.size_secs} seconds", slide) if slide else F.window("_ts", f"{op.size_secs} seconds")
    out = _timed(df, op.grace_secs).groupBy(w.alias("_w"), *[c.alias(k) for k, c in keys.items()]).agg(*[c.alias(k) for k, c in measures.items()])
    return out.select(*_bounds(F.col("_w")), *keys, *measures)


def session_aggregate(df: DataFrame, gap_secs: int, keys: dict[str, Column], measures: dict[str, Column], *, grace_secs: int = 0) -> DataFrame:
    """Aggregates by key and session: events with less than `gap_secs` between them.

    Spark's own sessions also join events that lie a whole gap apart. Times are whole
    milliseconds, so a gap of one less is the same without that; ends get it back.
    """
    w = F.session_window("_ts", f"{gap_secs * 1000 - 1} milliseconds")
    out = _timed(df, grace_secs).groupBy(w.alias("_w"), *[c.alias(k) for k, c in keys.items()]).agg(*[c.alias(k) for k, c in measures.items()])
    start, end = _bounds(F.col("_w"))
    return out.select(start, (end + 1).alias("end_epoch_ms"), *keys, *measures)
