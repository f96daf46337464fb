"""Registered queries: sessions, the reference's SQL statements, filters, joins
and aggregations (§2.1-2.7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar.operators import aggregates as A
from lodestar.operators import filters as FL
from lodestar.operators import joins as J
from lodestar.operators import validate as V
from lodestar.operators.ranking import leave_last_out, top_genres, top_n
from lodestar.plans.registry import date_text, query, r6
from lodestar.sources import fixtures as fx
from lodestar.sources.fixtures import AS_OF, AS_OF_DATE, AS_OF_RECENT, with_ctes
from lodestar.sources.tables import read_table

# AVG(session_duration) of the column, summed as whole microseconds (NULLs skipped)
AVG_US = "CAST(SUM(CAST(ROUND(session_duration * 1e6) AS BIGINT)) AS DOUBLE) / COUNT(session_duration) / 1e6"
AVG_US_S = "CAST(SUM(CAST(ROUND(s.session_duration * 1e6) AS BIGINT)) AS DOUBLE) / COUNT(s.session_duration) / 1e6"

# ---------------------------------------------------------------- sessions
@query("game_sessions", ts=('start_time', 'end_time'), oracle=with_ctes("sessions") + """
SELECT session_id, player_id, game_id, start_time, end_time, session_duration, n_events FROM sessions""")
def q_sessions(spark, d):
    return fx.game_sessions(spark, d)


# ------------------------------------------------------- reference SQL (C)
@query("genre_play_time", oracle=with_ctes("sessions", "games") + """
SELECT s.player_id, g.genre_id,
       SUM(epoch_us(s.end_time) - epoch_us(s.start_time)) / 1e6 AS total_play_time
FROM sessions s JOIN games g ON s.game_id = g.game_id
GROUP BY s.player_id, g.genre_id""")
def q_genre_play_time(spark, d):
    return A.genre_preference(fx.game_sessions(spark, d), fx.games(spark, d))


@query("player_stats", oracle=with_ctes("sessions", "players") + f"""
SELECT p.player_id, COALESCE(r.n_sessions, 0) AS n_sessions, r.avg_duration
FROM players p LEFT JOIN (
  SELECT player_id, COUNT(*) AS n_sessions, {AVG_US} AS avg_duration
  FROM sessions WHERE start_time > TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY GROUP BY player_id
) r ON p.player_id = r.player_id""")
def q_player_stats(spark, d):
    return A.player_stats(fx.game_sessions(spark, d), fx.players(spark, d), AS_OF, 30)


@query("player_stats_one", oracle=with_ctes("sessions") + f"""
SELECT COUNT(*) AS n_sessions, {AVG_US} AS avg_duration
FROM sessions WHERE player_id = 7 AND start_time > TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY""")
def q_player_stats_one(spark, d):
    return A.player_stats_one(fx.game_sessions(spark, d), 7, AS_OF, 30)


@query("aggression", oracle=with_ctes("actions") + """
SELECT player_id,
  COUNT(CASE WHEN action_type = 'purchase' THEN 1 END) * 100.0::DOUBLE / GREATEST(COUNT(*), 1)
    AS aggression_coef
FROM actions GROUP BY player_id""")
def q_aggression(spark, d):
    return A.aggression(fx.player_actions(spark, d), kill=fx.KILL_EVENT)


@query("daily_quality", oracle=with_ctes("reclog") + f"""
SELECT strftime(CAST(created_at AS DATE), '%Y-%m-%d') AS date, COUNT(*) AS total_recommendations,
       AVG(click_rate) AS avg_click_rate, AVG(conversion_rate) AS avg_conversion
FROM reclog WHERE created_at >= DATE '{AS_OF_DATE}' - INTERVAL 7 DAY
GROUP BY CAST(created_at AS DATE)""")
def q_daily_quality(spark, d):
    out = A.daily_quality(fx.recommendation_log(spark, d), AS_OF_DATE, 7)
    return out.select(date_text("date").alias("date"), "total_recommendations", "avg_click_rate", "avg_conversion")


@query("genre_stats", oracle=with_ctes("sessions", "games") + f"""
SELECT g.genre_id, COUNT(DISTINCT s.player_id) AS unique_players,
       {AVG_US_S} AS avg_session_time
FROM sessions s JOIN games g ON s.game_id = g.game_id GROUP BY g.genre_id""")
def q_genre_stats(spark, d):
    return A.genre_stats(fx.game_sessions(spark, d), fx.games(spark, d))


# ------------------------------------------------------------------ filters
@query("recent_sessions", ts=('start_time',), oracle=with_ctes("sessions") + f"""
SELECT session_id, player_id, start_time FROM sessions
WHERE start_time > TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY""")
def q_recent_sessions(spark, d):
    return FL.recent_sessions(fx.game_sessions(spark, d), AS_OF, 30).select("session_id", "player_id", "start_time")


@query("recently_played", ts=('last_start',), oracle=with_ctes("sessions") + f"""
SELECT player_id, game_id, COUNT(*) AS n_sessions, MAX(start_time) AS last_start FROM sessions
WHERE start_time > TIMESTAMP '{AS_OF_RECENT}' - INTERVAL 14 DAY GROUP BY player_id, game_id""")
def q_recently_played(spark, d):
    return FL.recently_played(fx.game_sessions(spark, d), AS_OF_RECENT, 14)


@query("recent_recommendations", ts=('created_at',), oracle=with_ctes("reclog") + f"""
SELECT created_at, click_rate, conversion_rate FROM reclog
WHERE created_at >= DATE '{AS_OF_DATE}' - INTERVAL 7 DAY""")
def q_recent_recs(spark, d):
    return FL.recent_recs(fx.recommendation_log(spark, d), AS_OF_DATE, 7)


@query("lookup_stats", oracle=with_ctes("players", "actions") + """
SELECT p.player_id, p.name, COALESCE(a.n_actions, 0) AS n_actions
FROM players p LEFT JOIN (SELECT player_id, COUNT(*) AS n_actions FROM actions GROUP BY player_id) a
ON p.player_id = a.player_id""")
def q_lookup(spark, d):
    counts = fx.player_actions(spark, d).groupBy("player_id").agg(F.count(F.lit(1)).alias("n_actions"))
    return FL.lookup(counts, fx.players(spark, d).select("player_id", "name"), "player_id", {"n_actions": 0})


# -------------------------------------------------------------------- joins
@query("sessions_with_games", oracle=with_ctes("sessions", "games") + """
SELECT s.session_id, s.player_id, s.game_id, g.genre_id, g.game_type
FROM sessions s JOIN games g ON s.game_id = g.game_id""")
def q_sessions_with_games(spark, d):
    j = J.sessions_with_games(fx.game_sessions(spark, d), fx.games(spark, d))
    return j.select("session_id", "player_id", "game_id", "genre_id", "game_type")


@query("merged_dataset", oracle=with_ctes("inter", "details", "players") + """
SELECT i.player_id, i.game_id, i.weight, i.n_plays, g.genre_id, g.game_type, dt.publisher,
       dt.price, p.name, p.country
FROM inter i JOIN games g ON i.game_id = g.game_id
LEFT JOIN details dt ON g.game_id = dt.game_id
LEFT JOIN players p ON i.player_id = p.player_id""")
def q_merged(spark, d):
    import uuid

    from lodestar.session import scratch_path

    path = scratch_path(spark, f"io/dataset-{uuid.uuid4().hex}")
    m = J.build_dataset(fx.interactions(spark, d), fx.games(spark, d), fx.game_details(spark, d),
                        fx.players(spark, d), path=path, partition_by=["genre_id"])
    return m.select("player_id", "game_id", "weight", "n_plays", "genre_id", "game_type", "publisher", "price",
                    "name", "country")


# ------------------------------------------------------------- aggregations
@query("total_play_time", oracle=with_ctes("players", "history") + """
SELECT p.player_id, CAST(COALESCE(t.total, 0) AS DOUBLE) AS total_play_time
FROM players p LEFT JOIN (SELECT player_id, SUM(duration) AS total FROM history GROUP BY player_id) t
ON p.player_id = t.player_id""")
def q_total_play_time(spark, d):
    return A.total_play_time(fx.players(spark, d), fx.game_history(spark, d))


@query("genre_counts", ts=('first_date',), oracle=with_ctes("history") + """
SELECT player_id, genre, COUNT(*) AS n, MIN(ord_d) AS first_date,
       arg_min(ord_o, row(ord_d, ord_o, ord_l, game_id)) AS first_order
FROM history GROUP BY player_id, genre""")
def q_genre_counts(spark, d):
    g = A.genre_counts(fx.game_history(spark, d))
    return g.select("player_id", "genre", "n", F.col("first_seen.d").alias("first_date"),
                    F.col("first_seen.o").alias("first_order"))


@query("type_counts", oracle=with_ctes("history") + """
SELECT player_id, COUNT(*) FILTER (WHERE game_type = 'singleplayer') AS n_singleplayer,
       COUNT(*) FILTER (WHERE game_type = 'multiplayer') AS n_multiplayer,
       COUNT(*) FILTER (WHERE game_type = 'coop') AS n_coop
FROM history GROUP BY player_id""")
def q_type_counts(spark, d):
    return A.type_counts(fx.game_history(spark, d))


_DESCRIBE_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("describe_lineitem", oracle=" UNION ALL ".join(f"""
SELECT '{c}' AS "column", COUNT({c}) AS n, COUNT(*) FILTER (WHERE {c} IS NULL) AS nulls,
  ROUND(AVG({c}), 6) AS mean, ROUND(STDDEV_SAMP({c}), 6) AS stddev, MIN({c}) AS min, MAX({c}) AS max,
  ROUND(QUANTILE_CONT({c}, 0.25), 6) AS q25, ROUND(QUANTILE_CONT({c}, 0.5), 6) AS q50,
  ROUND(QUANTILE_CONT({c}, 0.75), 6) AS q75 FROM lineitem""" for c in _DESCRIBE_COLS))
def q_describe(spark, d):
    out = A.describe(read_table(spark, d, "lineitem", _DESCRIBE_COLS), _DESCRIBE_COLS)
    return out.select("column", "n", "nulls", r6("mean").alias("mean"), r6("stddev").alias("stddev"), "min", "max",
                      r6("q25").alias("q25"), r6("q50").alias("q50"), r6("q75").alias("q75"))


@query("list_players", oracle=with_ctes("players") + "SELECT player_id FROM players")
def q_list_players(spark, d):
    return A.list_players(fx.players(spark, d))[0]


@query("player_total", oracle=with_ctes("players") + "SELECT COUNT(*) AS total FROM players")
def q_player_total(spark, d):
    return A.list_players(fx.players(spark, d))[1]


@query("interactions", ts=('last_played',), oracle=with_ctes("inter") + """
SELECT player_id, game_id, weight, n_plays, last_played FROM inter""")
def q_interactions(spark, d):
    return fx.interactions(spark, d)


# ---------------------------------------------------------- windows, top-k
@query("top_genres", oracle=with_ctes("history") + """
SELECT player_id, rk AS genre_rank, genre, n FROM (
  SELECT player_id, genre, n, row_number() OVER (PARTITION BY player_id ORDER BY n DESC, fs ASC) AS rk
  FROM (SELECT player_id, genre, COUNT(*) AS n, MIN(row(ord_d, ord_o, ord_l, game_id)) AS fs
        FROM history GROUP BY player_id, genre) c) r
WHERE rk <= 3""")
def q_top_genres(spark, d):
    t = top_genres(A.genre_counts(fx.game_history(spark, d)), 3)
    return t.select("player_id", F.posexplode("favorite_genres").alias("genre_rank", "g")).select(
        "player_id", (F.col("genre_rank") + 1).cast("long").alias("genre_rank"), F.col("g.genre").alias("genre"),
        F.col("g.n").alias("n"))


@query("top_played_games", oracle=with_ctes("inter") + """
SELECT player_id, game_id, weight AS score, rk AS rank FROM (
  SELECT player_id, game_id, weight,
         row_number() OVER (PARTITION BY player_id ORDER BY weight DESC, game_id ASC) AS rk FROM inter) r
WHERE rk <= 10""")
def q_top_played(spark, d):
    s = fx.interactions(spark, d).select("player_id", "game_id", F.col("weight").alias("score"))
    return top_n(s, 10).withColumn("rank", F.col("rank").cast("long"))


@query("holdout_test", oracle=with_ctes("inter") + """
SELECT player_id, game_id, weight FROM (
  SELECT *, row_number() OVER (PARTITION BY player_id ORDER BY last_played DESC, game_id DESC) AS rk
  FROM inter) r WHERE rk <= 2""")
def q_holdout_test(spark, d):
    _, test = leave_last_out(fx.interactions(spark, d), k=2)
    return test.select("player_id", "game_id", "weight")


@query("holdout_train", oracle=with_ctes("inter") + """
SELECT player_id, game_id, weight FROM (
  SELECT *, row_number() OVER (PARTITION BY player_id ORDER BY last_played DESC, game_id DESC) AS rk
  FROM inter) r WHERE rk > 2""")
def q_holdout_train(spark, d):
    train, _ = leave_last_out(fx.interactions(spark, d), k=2)
    return train.select("player_id", "game_id", "weight")


@query("clean_typed", oracle="""
SELECT o_orderkey, o_custkey, o_totalprice, o_orderstatus FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC, o_totalprice DESC, o_orderstatus DESC) AS rn
  FROM (SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, CAST(o_custkey AS BIGINT) AS o_custkey,
    CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(o_totalprice AS DOUBLE) END AS o_totalprice,
    o_orderstatus FROM orders) x WHERE o_custkey IS NOT NULL) y WHERE rn = 1""")
def q_clean_typed(spark, d):
    """V6 with target types: text columns become numbers, what does not parse
    becomes NULL, and the newest row per key stays."""
    o = read_table(spark, d, "orders", ["o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus"])
    text = o.select(
        F.concat(F.lit(" "), F.col("o_orderkey").cast("string")).alias("o_orderkey"),
        F.col("o_custkey").cast("string").alias("o_custkey"),
        F.when(F.col("o_orderkey") % 7 == 0, F.lit("n/a")).otherwise(F.col("o_totalprice").cast("string")).alias("o_totalprice"),
        F.concat("o_orderstatus", F.lit("  ")).alias("o_orderstatus"),
    )
    types = {"o_orderkey": "long", "o_custkey": "long", "o_totalprice": "double"}
    return V.clean(text, ["o_custkey"], ["o_orderkey"], types)
