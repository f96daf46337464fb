"""Profiles and rule-based recommendations (P1-P4), the core of the domain.

A profile is (player_id, total_play_time, favorite_genres, skill_level,
preferred_game_types). The play history is read and shuffled once (partial
sums per player and genre); titles are pure Catalyst expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.scalar import (
    FALLBACK_TITLES,
    KNOWN_GAME_TYPES,
    compact,
    genre_title,
    preferred_type,
    skill_level,
    skill_title,
    type_title,
)
from lodestar.operators.joins import left_join
from lodestar.operators.validate import admit, id_is_hashable, require_truthy_id, upsert_players
from lodestar.sources.tables import read_store, store_bucket, store_buckets, write_store

PROFILE_COLUMNS = ["player_id", "total_play_time", "favorite_genres", "skill_level", "preferred_game_types"]


def build_profiles(players: DataFrame, history: DataFrame, raw_col: str | None = None,
                   duration_unit: float = 1.0) -> DataFrame:
    """One profile per player with a truthy id (V4).

    ``history`` must already carry V5 defaults (genre, duration, game_type,
    ord, optionally poison). Empty history -> (0, [], beginner,
    singleplayer); a player whose history has an explicit NULL duration gets
    no profile. ``duration_unit`` scales durations before the skill rule."""
    ps = require_truthy_id(players, "player_id", raw_col=raw_col).select("player_id").distinct()
    # History is read and shuffled once: partial sums per (player, genre)
    # carry everything the profile needs. One player-partitioned window then
    # ranks the genres (count desc, first appearance asc) and spreads the
    # per-player sums; its buffer holds one row per genre of a player, never
    # the player's plays. The final groupBy reuses that partitioning.
    has_poison = "poison" in history.columns
    pre = history.groupBy("player_id", "genre").agg(
        F.count(F.lit(1)).alias("n"), F.min("ord").alias("first_seen"), F.sum(F.round(F.col("duration") * 1_000_000.0).cast("long")).alias("dur"),
        *[F.count_if(F.col("game_type") == F.lit(t)).alias(f"c_{t}") for t in KNOWN_GAME_TYPES],
        (F.bool_or("poison") if has_poison else F.lit(False)).alias("poison"))
    by_player = Window.partitionBy("player_id")
    ranked = pre.withColumn("rk", F.row_number().over(by_player.orderBy(F.col("n").desc(), F.col("first_seen"))))
    per = ranked.groupBy("player_id").agg(
        # whole millionths: the order of the rows can't move a total across a threshold
        (F.sum("dur") / F.lit(1_000_000.0)).alias("total_play_time"),
        *[F.sum(f"c_{t}").alias(f"n_{t}") for t in KNOWN_GAME_TYPES],
        F.bool_or("poison").alias("poison"),
        F.array_sort(F.collect_list(F.when(F.col("rk") <= 3, F.struct("rk", "genre", "n")))).alias("_top"),
    ).withColumn("favorite_genres", F.transform(
        "_top", lambda x: F.struct(x["genre"].alias("genre"), x["n"].alias("n"))))
    j = ps.join(per, "player_id", "left")
    if has_poison:
        j = j.where(~F.coalesce(F.col("poison"), F.lit(False)))
    total = F.coalesce(F.col("total_play_time"), F.lit(0.0)) * F.lit(duration_unit)
    zero = F.lit(0).cast("long")
    empty = F.array().cast("array<struct<genre:string,n:bigint>>")
    return j.select(
        "player_id",
        total.alias("total_play_time"),
        F.coalesce(F.col("favorite_genres"), empty).alias("favorite_genres"),
        skill_level(total).alias("skill_level"),
        preferred_type(
            F.coalesce("n_singleplayer", zero), F.coalesce("n_multiplayer", zero), F.coalesce("n_coop", zero)
        ).alias("preferred_game_types"),
    )


def titles_of(profile_cols=None) -> F.Column:
    """Titles from a profile row, first five."""
    genre_part = F.transform(F.col("favorite_genres"), lambda g: genre_title(g["genre"]))
    return compact(
        genre_part,
        F.array(skill_title(F.col("skill_level"))),
        F.array(type_title(F.col("preferred_game_types"))),
        n=5,
    )


def recommend_titles(requests: DataFrame, profiles: DataFrame) -> DataFrame:
    """(player_id, recommendations) for each request; a player without a
    profile gets the fallback list."""
    prof = profiles.select(*PROFILE_COLUMNS).withColumn("_has", F.lit(True))
    j = left_join(requests.select("player_id"), prof, "player_id")
    fallback = F.array(*[F.lit(t) for t in FALLBACK_TITLES])
    return j.select("player_id", F.when(F.col("_has"), titles_of()).otherwise(fallback).alias("recommendations"))


def titles_long(recs: DataFrame) -> DataFrame:
    """(player_id, pos, title) — one row per title, 1-based position."""
    return recs.select("player_id", F.posexplode("recommendations").alias("pos", "title")).withColumn(
        "pos", F.col("pos") + 1
    )


def add_players(store_players: DataFrame, store_recs: DataFrame, docs: DataFrame, history: DataFrame,
                raw_col: str = "raw", seq: str = "doc_seq") -> tuple[DataFrame, DataFrame]:
    """V3 admission -> V8 upsert -> P1 -> P2 for the admitted players.

    ``store_players`` is (player_id STRING, doc STRING); ``docs`` holds raw
    documents with an ordering column ``seq``; ``history`` carries V5 defaults
    and a player_id comparable with the document's id text. Returns the new
    (players, recommendations) store tables."""
    admitted = admit(docs, raw_col).where(id_is_hashable(raw_col)).select(
        "player_id", F.col(raw_col).alias("doc"), F.col(seq).alias("seq"))
    players = upsert_players(store_players.select("player_id", "doc"), admitted, "player_id", "seq")
    touched = admitted.select("player_id").distinct()
    hist = history.withColumn("player_id", F.col("player_id").cast("string"))
    prof_in = players.join(touched, "player_id", "left_semi")
    profiles = build_profiles(prof_in, hist, raw_col="doc")
    new_recs = recommend_titles(touched, profiles)
    # NULL is a valid id here: its old list is replaced like any other
    again = touched.select(F.col("player_id").alias("_touched"))
    kept = store_recs.join(again, F.col("player_id").eqNullSafe(F.col("_touched")), "left_anti")
    return players, kept.unionByName(new_recs)


def add_players_to_store(path: str, docs: DataFrame, history: DataFrame, raw_col: str = "raw", seq: str = "doc_seq") -> list[int]:
    """P3 over a stored store (IO3, IO4): only the buckets that hold an admitted id are
    read and written; the others keep their files. Returns these buckets; with nothing
    admitted the store stays as it is."""
    spark = docs.sparkSession
    n = store_buckets(spark, path)
    ids = admit(docs, raw_col).where(id_is_hashable(raw_col)).select(store_bucket(F.col("player_id"), n).alias("b"))
    touched = sorted(r["b"] for r in ids.distinct().collect())  # at most the number of buckets
    if touched:
        new = add_players(*read_store(spark, path, only=touched), docs, history, raw_col, seq)
        write_store(*new, path, only=touched)
    return touched


def get_recommendations(recs: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(found, not_found) for the requested player ids."""
    found = requests.join(recs, "player_id", "inner")
    missing = left_join(requests, recs.select("player_id"), "player_id", "left_anti")
    return found, missing
