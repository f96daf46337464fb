"""Filters, predicates and lookups.

Time filters are written on the bare column so the predicate reaches the
Parquet scan (and prunes date partitions when the table is partitioned).
Every time-relative operator takes ``as_of`` instead of reading the clock.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _ts(x: str) -> Column:
    return F.lit(x).cast("timestamp_ntz")


def recent_sessions(sessions: DataFrame, as_of: str, days: int = 30, player_id=None,
                    ts: str = "start_time") -> DataFrame:
    """rows with ``ts > as_of - days`` (strict); one player if given.

    On a table partitioned by ``start_date`` (IO5) the implied date predicate
    is added as well, so the scan prunes partitions; the exact test on the
    bare timestamp column stays (it is also pushed into the Parquet scan)."""
    start = _ts(as_of) - F.make_interval(days=F.lit(days))
    cond = F.col(ts) > start
    if "start_date" in sessions.columns and ts == "start_time":
        cond = cond & (F.col("start_date") >= F.to_date(start))
    if player_id is not None:
        cond = cond & (F.col("player_id") == F.lit(player_id))
    return sessions.where(cond)


def recent_recs(recs: DataFrame, as_of_date: str, days: int = 7, ts: str = "created_at") -> DataFrame:
    """``created_at >= as_of_date - days`` (inclusive, from midnight)."""
    start = F.date_sub(F.lit(as_of_date).cast("date"), days).cast("timestamp_ntz")
    return recs.where(F.col(ts) >= start)


def recently_played(sessions: DataFrame, as_of: str, days: int = 14) -> DataFrame:
    """distinct (player, game) with a session starting in the last
    ``days`` before ``as_of`` (strict), with the last start."""
    r = recent_sessions(sessions, as_of, days)
    return r.groupBy("player_id", "game_id").agg(
        F.count(F.lit(1)).alias("n_sessions"), F.max("start_time").alias("last_start")
    )


def lookup(table: DataFrame, requests: DataFrame, key: str, defaults: dict) -> DataFrame:
    """left join the requests to ``table`` and fill missing values."""
    from lodestar.operators.joins import left_join

    j = left_join(requests, table, key)
    return j.select(
        *requests.columns,
        *[F.coalesce(F.col(c), F.lit(defaults[c])).alias(c) if c in defaults else F.col(c)
          for c in table.columns if c != key],
    )
