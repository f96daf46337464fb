"""Feature engine (FE1-FE4): behavioural and temporal features, normalisation
and the feature store. All features are per-player aggregations (partial
aggregation first); nothing orders a player's full history in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.scalar import KILL_ACTION, avg_seconds, micros_between
from lodestar.operators.aggregates import aggression, genre_preference
from lodestar.operators.joins import sessions_with_games
from lodestar.sources.tables import write_dataset

MICROS_PER_DAY = 86_400_000_000.0


def behavioral_features(sessions: DataFrame, games: DataFrame, actions: DataFrame,
                        kill: str = KILL_ACTION) -> DataFrame:
    """FE1: per player n_sessions, total and mean session seconds, distinct
    games and genres, aggression (A2) and the share of play time of the
    top genre (A3). Players seen only in actions get NULL session features."""
    j = sessions_with_games(sessions, games.select("game_id", "genre_id"))
    us = micros_between("start_time", "end_time")
    per = j.groupBy("player_id").agg(
        F.count(F.lit(1)).alias("n_sessions"),
        (F.sum(us) / F.lit(1_000_000.0)).alias("total_seconds"),
        avg_seconds(us).alias("mean_seconds"),
        F.count_distinct("game_id").alias("distinct_games"),
        F.count_distinct("genre_id").alias("distinct_genres"),
    )
    tot = F.sum("total_play_time")
    gp = genre_preference(sessions, games).groupBy("player_id").agg(
        F.when(tot > 0, F.max("total_play_time") / tot).alias("top_genre_share")
    )
    ag = aggression(actions, kill)
    return per.join(gp, "player_id", "full_outer").join(ag, "player_id", "full_outer")


def fit_normalizer(df: DataFrame, cols: list[str], how: str = "minmax") -> dict[str, tuple[float, float]]:
    """FE2 fit: one global aggregate (a single row, like MLlib scalers) ->
    {col: (shift, scale)}; a constant column gets scale 0."""
    if how == "minmax":
        aggs = [F.min(c).alias(f"a_{c}") for c in cols] + [F.max(c).alias(f"b_{c}") for c in cols]
    elif how == "zscore":
        aggs = [F.avg(c).alias(f"a_{c}") for c in cols] + [F.stddev_pop(c).alias(f"b_{c}") for c in cols]
    else:
        raise ValueError(how)
    row = df.agg(*aggs).first()
    out = {}
    for c in cols:
        a, b = row[f"a_{c}"], row[f"b_{c}"]
        if a is None:
            out[c] = (0.0, 0.0)
        elif how == "minmax":
            out[c] = (float(a), float(b) - float(a))
        else:
            out[c] = (float(a), float(b or 0.0))
    return out


def normalize(df: DataFrame, cols: list[str], how: str = "minmax",
              params: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """FE2: 'minmax' -> (x - min) / (max - min); 'zscore' -> (x - mean) /
    population stddev; a constant column -> 0; NULL stays NULL."""
    params = params or fit_normalizer(df, cols, how)
    out = df
    for c in cols:
        shift, scale = params[c]
        x = F.col(c).cast("double")
        out = out.withColumn(c, F.when(x.isNull(), None).when(F.lit(scale) == 0, 0.0)
                             .otherwise((x - F.lit(shift)) / F.lit(scale)))
    return out


def temporal_features(sessions: DataFrame, as_of: str) -> DataFrame:
    """FE3 over sessions started before ``as_of``: share of sessions per day
    part (night 0-5, morning 6-11, day 12-17, evening 18-23) and on weekends,
    days since the last session, mean gap between consecutive session starts
    ((last - first) / (n - 1): the consecutive gaps telescope, so no ordering
    window is needed) and play seconds in the trailing 7 days."""
    a = F.lit(as_of).cast("timestamp_ntz")
    s = sessions.where(F.col("start_time") < a)
    h = F.hour("start_time")
    n = F.count(F.lit(1))

    def share(pred):
        return F.count_if(pred) / n

    recent = F.col("start_time") > a - F.expr("INTERVAL 7 DAYS")
    return s.groupBy("player_id").agg(
        n.alias("n_sessions"),
        share(h < 6).alias("share_night"),
        share((h >= 6) & (h < 12)).alias("share_morning"),
        share((h >= 12) & (h < 18)).alias("share_day"),
        share(h >= 18).alias("share_evening"),
        share(F.dayofweek("start_time").isin(1, 7)).alias("share_weekend"),
        (micros_between(F.max("start_time"), a) / F.lit(MICROS_PER_DAY)).alias("days_since_last"),
        F.when(n > 1, micros_between(F.min("start_time"), F.max("start_time")) / (n - 1) / F.lit(1_000_000.0))
        .alias("mean_gap_seconds"),
        F.coalesce(F.sum(F.when(recent, micros_between("start_time", "end_time"))), F.lit(0))
        .alias("_us7"),
    ).withColumn("play_seconds_7d", F.col("_us7") / F.lit(1_000_000.0)).drop("_us7")


def latest_features(snapshots: DataFrame, key: str = "player_id", as_of: str = "as_of") -> DataFrame:
    """FE4 read side: the newest snapshot row per player (older rows never
    win). ``max_by`` aggregates map-side, so a player with many snapshots is
    combined before the shuffle."""
    cols = [c for c in snapshots.columns if c != key]
    best = snapshots.groupBy(key).agg(F.max_by(F.struct(*cols), F.col(as_of)).alias("_r"))
    return best.select(key, *[F.col(f"_r.{c}").alias(c) for c in cols])


def update_feature_store(new: DataFrame, path: str, as_of: str) -> None:
    """FE4 write side: the snapshot of ``as_of`` goes to its own date
    partition with dynamic partition overwrite (re-runs replace only that
    partition); readers take ``latest_features`` over all partitions."""
    snap = new.withColumn("as_of", F.lit(as_of).cast("timestamp_ntz")).withColumn("as_of_date", F.to_date("as_of"))
    write_dataset(snap, path, partition_by=["as_of_date"])


def read_feature_store(spark, path: str) -> DataFrame:
    return latest_features(spark.read.parquet(path).drop("as_of_date"))


def as_of_features(events: DataFrame, versions: DataFrame, key: str = "player_id", ts: str = "ts", as_of: str = "as_of",
                   bucket_days: int = 7) -> DataFrame:
    """FE4 point-in-time lookup: every event with the columns of the newest version
    of its key that is not after it (NULL without one; of versions at the same time
    the largest). ``versions`` columns other than the key must not occur in
    ``events``.

    Events and versions are merged by time within (key, time bucket). What is known
    when a bucket begins is carried into it: the last version of each earlier bucket,
    one row a bucket, run forward by a window over the key's buckets. So a key with a
    third of all events is dealt over its buckets, and no range join is needed. Events
    without key or time look nothing up and pass by the shuffle."""
    cols = [c for c in versions.columns if c != key]
    clash = set(cols) & set(events.columns)
    if clash:
        raise ValueError(f"columns of both sides: {sorted(clash)}")
    width = bucket_days * 86_400_000_000
    at = F.unix_micros(F.col("_t").cast("timestamp"))
    put = lambda df: df.withColumn("_us", at).withColumn("_b", F.floor(F.col("_us") / F.lit(width)))
    v = put(versions.where(F.col(key).isNotNull() & F.col(as_of).isNotNull()).select(
        F.col(key).alias("_k"), F.col(as_of).alias("_t"), F.struct(*cols).alias("_v"))).drop("_t")
    kind = v.schema["_v"].dataType
    no_event = F.lit(None).cast(events.schema).alias("_e")
    last = v.groupBy("_k", "_b").agg(F.max(F.struct("_us", "_v")).alias("_m"))
    # the buckets of a key in which something may need what is known
    e = put(events.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).select(
        F.col(key).alias("_k"), F.col(ts).alias("_t"), F.struct(*[F.col(f"`{c}`") for c in events.columns]).alias("_e"))).drop("_t")
    met = last.unionByName(e.select("_k", "_b").distinct(), allowMissingColumns=True)
    met = met.groupBy("_k", "_b").agg(F.max("_m").alias("_m"))
    before = Window.partitionBy("_k").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    known = met.withColumn("_c", F.last("_m", ignorenulls=True).over(before)).where(F.col("_c").isNotNull())
    carried = known.select("_k", F.col("_c._us").alias("_us"), "_b", F.col("_c._v").alias("_v"))
    rows = v.select("_k", "_us", "_b", "_v").unionByName(carried).select("*", F.lit(0).alias("_o"), no_event)
    rows = rows.unionByName(e.select("_k", "_us", "_b", F.lit(None).cast(kind).alias("_v"), F.lit(1).alias("_o"), "_e"))
    w = Window.partitionBy("_k", "_b").orderBy("_us", "_o", "_v").rowsBetween(Window.unboundedPreceding, 0)
    found = rows.withColumn("_f", F.last("_v", ignorenulls=True).over(w)).where(F.col("_o") == 1)
    done = found.select("_e.*", *[F.col(f"_f.{c}").alias(c) for c in cols])
    rest = events.where(F.col(key).isNull() | F.col(ts).isNull())
    return done.unionByName(rest, allowMissingColumns=True)
