"""Window functions, sort and top-k.

Every top-k is written as ``row_number() <= k`` directly on the window, which
Spark plans with a WindowGroupLimit before the shuffle: each task keeps at
most k rows per key, so a key with a third of all rows ships k rows per task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def top_genres(genre_counts: DataFrame, n: int = 3) -> DataFrame:
    """Top ``n`` genres per player by count; ties keep first-appearance
    order. Returns (player_id, favorite_genres ARRAY<STRUCT<genre, n>>)."""
    w = Window.partitionBy("player_id").orderBy(F.col("n").desc(), F.col("first_seen").asc())
    ranked = genre_counts.withColumn("_rk", F.row_number().over(w)).where(F.col("_rk") <= n)
    packed = F.array_sort(F.collect_list(F.struct("_rk", "genre", "n")))
    return ranked.groupBy("player_id").agg(
        F.transform(packed, lambda x: F.struct(x["genre"].alias("genre"), x["n"].alias("n"))).alias("favorite_genres")
    )


def top_n(scores: DataFrame, n: int = 10, key: str = "player_id", item: str = "game_id",
          score: str = "score", rank_col: str = "rank") -> DataFrame:
    """Top ``n`` items per key by score desc; the item id breaks ties."""
    w = Window.partitionBy(key).orderBy(F.col(score).desc(), F.col(item).asc())
    return scores.withColumn(rank_col, F.row_number().over(w)).where(F.col(rank_col) <= n)


def leave_last_out(inter: DataFrame, k: int = 1, ts: str = "last_played",
                   key: str = "player_id", item: str = "game_id") -> tuple[DataFrame, DataFrame]:
    """Hold out the last ``k`` interactions per player by (time, item);
    returns (train, test). The test side is a group-limited top-k; the
    training side is an anti-join on (player, item), which spreads a hot
    player over many join keys."""
    w = Window.partitionBy(key).orderBy(F.col(ts).desc(), F.col(item).desc())
    test = inter.withColumn("_rk", F.row_number().over(w)).where(F.col("_rk") <= k).drop("_rk")
    train = inter.join(test.select(key, item), [key, item], "left_anti")
    return train, test
