"""Gap-based sessionisation (ST3, and the fixture's game_sessions).

One function for batch and stream: ``session_window`` groups events of a key
whose consecutive timestamps are at most ``gap`` apart (an event exactly at
the gap joins the session). In batch, with
``spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition`` on
(set by ``lodestar.session``), events are merged into sessions map-side
before the shuffle, so a key holding a third of all events ships only its
per-partition sessions, not its events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sessionize(
    events: DataFrame,
    key: str | list[str],
    ts: str = "ts",
    gap: str = "12 hours",
    aggs: list[Column] | None = None,
) -> DataFrame:
    """One row per (key, session) with ``session_start``/``session_end``
    (first/last event time, same type as ``ts``) plus ``aggs``."""
    keys = [key] if isinstance(key, str) else list(key)
    is_ntz = dict(events.dtypes)[ts] == "timestamp_ntz"
    # session_window and watermarks need a TIMESTAMP (LTZ) column
    t = F.col(ts).cast("timestamp") if is_ntz else F.col(ts)
    grouped = events.groupBy(*keys, F.session_window(t, gap).alias("_sw"))
    extra = list(aggs or [])
    out = grouped.agg(F.min(ts).alias("session_start"), F.max(ts).alias("session_end"), *extra)
    return out.drop("_sw")


def sessionize_stream(
    events: DataFrame,
    key: str | list[str],
    ts: str = "ts",
    gap: str = "12 hours",
    watermark: str = "1 hour",
    aggs: list[Column] | None = None,
) -> DataFrame:
    """Streaming form: event time must be LTZ for the watermark; session
    bounds are the first and last event (the window end is last + gap)."""
    keys = [key] if isinstance(key, str) else list(key)
    ev = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, watermark)
    grouped = ev.groupBy(*keys, F.session_window(F.col(ts), gap).alias("_sw"))
    out = grouped.agg(F.min(ts).alias("session_start"), F.max(ts).alias("session_end"), *(aggs or []))
    return out.drop("_sw")
