"""Joins (J1-J4) and the size-checked broadcast helper."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A dimension is broadcast only when Catalyst's size estimate of its
# optimized plan is below this bound; beyond it the join stays a shuffle
# join (and AQE may still convert it at run time from real sizes).
BROADCAST_MAX_BYTES = 64 * 1024 * 1024


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of the optimized plan (no job is run)."""
    try:
        return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    except Exception:
        return 2**63 - 1


def maybe_broadcast(df: DataFrame, max_bytes: int = BROADCAST_MAX_BYTES) -> DataFrame:
    """Broadcast hint behind a size check; larger sides are left to the
    planner (sort-merge / AQE)."""
    return F.broadcast(df) if estimated_bytes(df) <= max_bytes else df


def left_join(left: DataFrame, right: DataFrame, key: str, how: str = "left") -> DataFrame:
    """Left outer / left anti join on ``key`` where NULL keys bypass the
    shuffle: they can never match, and in a hash exchange every NULL would
    land in the same partition (one task for possibly a third of the rows).
    Output equals ``left.join(right, key, how)``."""
    if how not in ("left", "left_anti"):
        raise ValueError(how)
    keyed = left.where(F.col(key).isNotNull()).join(right, key, how)
    nulls = left.where(F.col(key).isNull())
    if how == "left":
        extra = [F.lit(None).cast(t).alias(c) for c, t in right.dtypes if c != key]
        nulls = nulls.select(*left.columns, *extra)
    return keyed.unionByName(nulls.select(*keyed.columns))


def sessions_with_games(sessions: DataFrame, games: DataFrame) -> DataFrame:
    """Inner equi-join on game_id; sessions without a game drop out."""
    return sessions.join(maybe_broadcast(games), "game_id", "inner")


def merge_tables(interactions: DataFrame, games: DataFrame, details: DataFrame, users: DataFrame) -> DataFrame:
    """Interactions ⋈ games (inner), details and users left joined."""
    g = left_join(games, details, "game_id")
    return left_join(interactions.join(maybe_broadcast(g), "game_id", "inner"), users, "player_id")


def build_dataset(interactions: DataFrame, games: DataFrame, details: DataFrame, users: DataFrame,
                  path: str | None = None, partition_by: list[str] | None = None) -> DataFrame:
    """IO6: the merged (J2) dataset, written as Parquet when ``path`` is
    given; returns the dataset (read back from ``path`` when written)."""
    merged = merge_tables(interactions, games, details, users)
    if path is None:
        return merged
    from lodestar.sources.tables import write_dataset

    write_dataset(merged, path, partition_by)
    return merged.sparkSession.read.parquet(path)


def exclude_owned(recs: DataFrame, owned: DataFrame, keys: tuple[str, str] = ("player_id", "game_id")) -> DataFrame:
    """Drop recommendations of items the player already has."""
    return recs.join(owned.select(*keys).distinct(), list(keys), "left_anti")
