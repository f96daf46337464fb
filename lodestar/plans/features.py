"""Registered queries: feature engine (FE1-FE4) and monitoring (MO1-MO2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar.operators import features as FE
from lodestar.operators.aggregates import daily_quality
from lodestar.operators.monitor import alerts
from lodestar.plans.registry import date_text, query
from lodestar.sources import fixtures as fx
from lodestar.sources.fixtures import AS_OF_DATE, AS_OF_RECENT, with_ctes

US = "(epoch_us(end_time) - epoch_us(start_time))"

FE1_CTES = [
    ("j", "SELECT s.*, g.genre_id FROM sessions s JOIN games g ON s.game_id = g.game_id"),
    ("per", f"""SELECT player_id, COUNT(*) AS n_sessions, SUM({US}) / 1e6 AS total_seconds,
        CAST(SUM({US}) AS DOUBLE) / COUNT({US}) / 1e6 AS mean_seconds,
        COUNT(DISTINCT game_id) AS distinct_games, COUNT(DISTINCT genre_id) AS distinct_genres
        FROM j GROUP BY player_id"""),
    ("gp0", f"SELECT player_id, genre_id, SUM({US}) / 1e6 AS t FROM j GROUP BY player_id, genre_id"),
    ("gp", """SELECT player_id, CASE WHEN SUM(t) > 0 THEN MAX(t) / SUM(t) END AS top_genre_share
        FROM gp0 GROUP BY player_id"""),
    ("ag", """SELECT player_id, COUNT(CASE WHEN action_type = 'purchase' THEN 1 END) * 100.0::DOUBLE
        / GREATEST(COUNT(*), 1) AS aggression_coef FROM actions GROUP BY player_id"""),
    ("fe1", """SELECT * FROM per FULL OUTER JOIN gp USING (player_id) FULL OUTER JOIN ag USING (player_id)"""),
]
FE1_COLS = ["player_id", "n_sessions", "total_seconds", "mean_seconds", "distinct_games", "distinct_genres",
            "top_genre_share", "aggression_coef"]


def _fe1(spark, d):
    out = FE.behavioral_features(fx.game_sessions(spark, d), fx.games(spark, d), fx.player_actions(spark, d),
                                 kill=fx.KILL_EVENT)
    return out.withColumn("top_genre_share", F.round("top_genre_share", 9)).select(*FE1_COLS)


@query("behavioral_features", oracle=with_ctes("sessions", "games", "actions", extra=FE1_CTES) + """
SELECT player_id, n_sessions, total_seconds, mean_seconds, distinct_games, distinct_genres,
  ROUND(top_genre_share, 9) AS top_genre_share, aggression_coef FROM fe1""")
def q_behavioral(spark, d):
    return _fe1(spark, d)


_NORM_COLS = ["n_sessions", "total_seconds", "aggression_coef"]


def _norm_sql(how: str) -> str:
    if how == "minmax":
        stats = ", ".join(f"MIN({c}) AS a_{c}, MAX({c}) - MIN({c}) AS b_{c}" for c in _NORM_COLS)
    else:
        stats = ", ".join(f"AVG({c}) AS a_{c}, STDDEV_POP({c}) AS b_{c}" for c in _NORM_COLS)
    cols = ", ".join(
        f"ROUND(CASE WHEN {c} IS NULL THEN NULL WHEN COALESCE(b_{c}, 0) = 0 THEN 0.0 "
        f"ELSE ({c} - a_{c}) / b_{c} END, 9) AS {c}" for c in _NORM_COLS)
    return (with_ctes("sessions", "games", "actions", extra=FE1_CTES + [("st", f"SELECT {stats} FROM fe1")])
            + f"SELECT player_id, {cols} FROM fe1, st")


def _norm(spark, d, how):
    df = _fe1(spark, d).select("player_id", *_NORM_COLS)
    out = FE.normalize(df, _NORM_COLS, how)
    return out.select("player_id", *[F.round(c, 9).alias(c) for c in _NORM_COLS])


@query("normalized_minmax", oracle=_norm_sql("minmax"))
def q_norm_minmax(spark, d):
    return _norm(spark, d, "minmax")


@query("normalized_zscore", oracle=_norm_sql("zscore"))
def q_norm_zscore(spark, d):
    return _norm(spark, d, "zscore")


def _temporal_sql(as_of: str, src: str = "sessions") -> str:
    a = f"TIMESTAMP '{as_of}'"
    n = "CAST(COUNT(*) AS DOUBLE)"
    return f"""SELECT player_id, COUNT(*) AS n_sessions,
  COUNT(*) FILTER (WHERE hour(start_time) < 6) / {n} AS share_night,
  COUNT(*) FILTER (WHERE hour(start_time) >= 6 AND hour(start_time) < 12) / {n} AS share_morning,
  COUNT(*) FILTER (WHERE hour(start_time) >= 12 AND hour(start_time) < 18) / {n} AS share_day,
  COUNT(*) FILTER (WHERE hour(start_time) >= 18) / {n} AS share_evening,
  COUNT(*) FILTER (WHERE isodow(start_time) IN (6, 7)) / {n} AS share_weekend,
  (epoch_us({a}) - epoch_us(MAX(start_time))) / 8.64e10 AS days_since_last,
  CASE WHEN COUNT(*) > 1 THEN CAST(epoch_us(MAX(start_time)) - epoch_us(MIN(start_time)) AS DOUBLE)
       / (COUNT(*) - 1) / 1e6 END AS mean_gap_seconds,
  COALESCE(SUM(CASE WHEN start_time > {a} - INTERVAL 7 DAY THEN {US} END), 0) / 1e6 AS play_seconds_7d
FROM {src} WHERE start_time < {a} GROUP BY player_id"""


@query("temporal_features", oracle=with_ctes("sessions") + _temporal_sql(AS_OF_RECENT))
def q_temporal(spark, d):
    return FE.temporal_features(fx.game_sessions(spark, d), AS_OF_RECENT)


_SNAP_A = "2024-01-15 00:00:00"


@query("feature_store_latest", ts=('as_of',), oracle=with_ctes("sessions", extra=[
    ("snap_a", _temporal_sql(_SNAP_A)),
    ("recent", f"SELECT * FROM sessions WHERE start_time > TIMESTAMP '{AS_OF_RECENT}' - INTERVAL 14 DAY"),
    ("snap_b", _temporal_sql(AS_OF_RECENT, "recent")),
    ("snaps", f"""SELECT *, TIMESTAMP '{_SNAP_A}' AS as_of FROM snap_a
        UNION ALL SELECT *, TIMESTAMP '{AS_OF_RECENT}' AS as_of FROM snap_b"""),
]) + """SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY player_id ORDER BY as_of DESC) AS rn
  FROM snaps) x WHERE rn = 1""")
def q_feature_store(spark, d):
    """Two snapshots written to a date-partitioned store; the newest row per
    player wins on read."""
    import uuid

    from lodestar.session import scratch_path

    path = scratch_path(spark, f"features/store-{uuid.uuid4().hex}")
    s = fx.game_sessions(spark, d)
    FE.update_feature_store(FE.temporal_features(s, _SNAP_A), path, _SNAP_A)
    recent = s.where(F.col("start_time") > F.lit(AS_OF_RECENT).cast("timestamp_ntz") - F.expr("INTERVAL 14 DAYS"))
    FE.update_feature_store(FE.temporal_features(recent, AS_OF_RECENT), path, AS_OF_RECENT)
    return FE.read_feature_store(spark, path)


@query("features_as_of", ts=("start_time", "as_of"), oracle=with_ctes("sessions", extra=[
    ("snap_a", _temporal_sql(_SNAP_A)),
    ("recent", f"SELECT * FROM sessions WHERE start_time > TIMESTAMP '{AS_OF_RECENT}' - INTERVAL 14 DAY"),
    ("snap_b", _temporal_sql(AS_OF_RECENT, "recent")),
    ("snaps", f"""SELECT *, TIMESTAMP '{_SNAP_A}' AS as_of FROM snap_a
        UNION ALL SELECT *, TIMESTAMP '{AS_OF_RECENT}' - INTERVAL 10 DAY AS as_of FROM snap_b"""),
]) + """SELECT s.session_id, s.player_id, s.start_time, v.as_of, v.FEATURES FROM sessions s
  ASOF LEFT JOIN snaps v ON s.player_id = v.player_id AND s.start_time >= v.as_of""".replace("v.FEATURES", "v.* EXCLUDE (player_id, as_of)"))
def q_features_as_of(spark, d):
    """Every session with the feature snapshot that was known when it began."""
    s = fx.game_sessions(spark, d)
    recent = s.where(F.col("start_time") > F.lit(AS_OF_RECENT).cast("timestamp_ntz") - F.expr("INTERVAL 14 DAYS"))
    a = FE.temporal_features(s, _SNAP_A).withColumn("as_of", F.lit(_SNAP_A).cast("timestamp_ntz"))
    at = F.lit(AS_OF_RECENT).cast("timestamp_ntz") - F.expr("INTERVAL 10 DAYS")
    b = FE.temporal_features(recent, AS_OF_RECENT).withColumn("as_of", at)
    return FE.as_of_features(s.select("session_id", "player_id", "start_time"), a.unionByName(b), ts="start_time")


# --------------------------------------------------------------- monitoring
_DAILY30 = ("daily", f"""SELECT CAST(created_at AS DATE) AS date, COUNT(*) AS total_recommendations,
  AVG(click_rate) AS avg_click_rate, AVG(conversion_rate) AS avg_conversion FROM reclog
  WHERE created_at >= DATE '{AS_OF_DATE}' - INTERVAL 30 DAY GROUP BY CAST(created_at AS DATE)""")


@query("quality_log", oracle=with_ctes("reclog", extra=[_DAILY30]) + """
SELECT strftime(date, '%Y-%m-%d') AS date, total_recommendations, avg_click_rate, avg_conversion FROM daily""")
def q_quality_log(spark, d):
    """MO1: the daily report is written to the day-partitioned quality log and
    read back."""
    import uuid

    from lodestar.operators.monitor import log_quality
    from lodestar.session import scratch_path

    path = scratch_path(spark, f"monitor/quality-{uuid.uuid4().hex}")
    log_quality(fx.recommendation_log(spark, d), AS_OF_DATE, path=path, days=30)
    out = spark.read.parquet(path)
    return out.select(date_text("date").alias("date"), "total_recommendations", "avg_click_rate", "avg_conversion")


@query("quality_alerts", oracle=with_ctes("reclog", extra=[_DAILY30]) + """
SELECT strftime(date, '%Y-%m-%d') AS date, value, ROUND(baseline, 9) AS baseline, alert FROM (
  SELECT date, value, baseline, CASE WHEN value < 0.19 THEN 'below_floor'
    WHEN baseline IS NOT NULL AND value < (1 - 0.05) * baseline THEN 'drop' END AS alert
  FROM (SELECT date, avg_click_rate AS value,
          AVG(avg_click_rate) OVER (ORDER BY date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS baseline
        FROM daily) x) y WHERE alert IS NOT NULL""")
def q_quality_alerts(spark, d):
    daily = daily_quality(fx.recommendation_log(spark, d), AS_OF_DATE, 30)
    out = alerts(daily, "avg_click_rate", min_value=0.19, drop=0.05, lookback=7)
    return out.select(date_text("date").alias("date"), "value", F.round("baseline", 9).alias("baseline"), "alert")
