"""Registered streaming queries: each runs a Structured Streaming query over
the events table with ``availableNow`` into a Parquet sink under the
session's checkpoint folder, and returns the sink read back as a DataFrame.
Append mode emits only closed windows/sessions: the oracles keep the same
ones (end <= max(ts) - watermark delay)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lodestar.plans.registry import date_text, query
from lodestar.session import scratch_path
from lodestar.sources import fixtures as fx
from lodestar.sources.fixtures import with_ctes
from lodestar.sources.session_store import read_sessions
from lodestar.sources.tables import read_store, table_path
from lodestar.streaming import streams as ST
from lodestar.streaming.keyed import upsert_players_stream

DELAY = "1 hour"


def _run(spark, stream_df, name):
    base = scratch_path(spark, f"streams/{name}-{uuid.uuid4().hex}")
    ST.run_available(stream_df, f"{base}/out", f"{base}/ckpt")
    return spark.read.parquet(f"{base}/out")


@query("stream_ingest_events", ts=('ts',), oracle="""
SELECT event_id, user_id AS player_id, ts, event_type AS action_type FROM events""")
def q_stream_ingest(spark, d):
    ev = ST.read_events_stream(spark, table_path(d, "events"))
    out = _run(spark, ST.ingest_events(ev, DELAY), "ingest")
    return out.select("event_id", "player_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "action_type")


@query("stream_daily_quality", oracle=with_ctes("reclog") + f"""
SELECT strftime(CAST(created_at AS DATE), '%Y-%m-%d') AS date, COUNT(*) AS total_recommendations,
  AVG(click_rate) AS avg_click_rate, AVG(conversion_rate) AS avg_conversion FROM reclog
GROUP BY CAST(created_at AS DATE)
HAVING CAST(created_at AS DATE) + INTERVAL 1 DAY <= (SELECT MAX(ts) FROM events) - INTERVAL {DELAY}""")
def q_stream_daily(spark, d):
    ev = ST.read_events_stream(spark, table_path(d, "events"))
    out = _run(spark, ST.daily_quality_stream(ev, DELAY, conversion=fx.KILL_EVENT), "daily")
    return out.select(date_text("date").alias("date"), "total_recommendations", "avg_click_rate", "avg_conversion")


def _actions(events):
    """The domain's actions (player_id, ts, event_id, game_id) from the events table."""
    return events.select("event_id", F.col("user_id").alias("player_id"), "ts",
                         F.get_json_object("props", "$.k").cast("long").alias("game_id"))


@query("stream_sessions", ts=('start_time', 'end_time'), oracle=with_ctes("sessions_all") + f"""
SELECT session_id, player_id, game_id, start_time, last_ts AS end_time, n_events FROM sessions_all
WHERE last_ts + INTERVAL 12 HOUR <= (SELECT MAX(ts) FROM events) - INTERVAL {DELAY}""")
def q_stream_sessions(spark, d):
    ev = ST.read_events_stream(spark, table_path(d, "events"))
    out = _run(spark, ST.sessionize(_actions(ev), fx.SESSION_GAP, DELAY), "sessions")
    return out.select("session_id", "player_id", "game_id",
                      F.col("session_start").cast("timestamp_ntz").alias("start_time"),
                      F.col("session_end").cast("timestamp_ntz").alias("end_time"), "n_events")


@query("stream_upserted_documents", oracle="""
WITH docs AS (SELECT CAST(o_custkey AS VARCHAR) AS player_id, o_orderkey,
  '{"player_id": ' || o_custkey || ', "order": ' || o_orderkey || '}' AS doc FROM orders)
SELECT player_id, doc FROM (SELECT *, row_number() OVER (PARTITION BY player_id ORDER BY o_orderkey DESC) AS rn
  FROM docs) x WHERE rn = 1""")
def q_stream_upsert(spark, d):
    """Documents (one per order, derived by Spark and landed as text files in
    order-key ranges) stream through V3 and keyed state into the player store;
    the current document per player is the newest one."""
    base = scratch_path(spark, f"streams/docs-{uuid.uuid4().hex}")
    o = fx.read_table(spark, d, "orders", ["o_orderkey", "o_custkey"])
    docs = o.select(F.concat(F.lit('{"player_id": '), F.col("o_custkey"), F.lit(', "order": '),
                             F.col("o_orderkey"), F.lit("}")).alias("value"), "o_orderkey")
    # land the documents as files in key order, one directory per key range (the arrival order)
    _land(docs, "o_orderkey", f"{base}/landing")
    stream = spark.readStream.option("maxFilesPerTrigger", 4).text(f"{base}/landing/*")
    upsert_players_stream(stream, f"{base}/store", f"{base}/ckpt", order="$.order")
    return read_store(spark, f"{base}/store")[0]


def _land(docs, order, path, parts=4):
    """Documents as text files, one directory per range of ``order``."""
    n = docs.agg(F.max(order).alias("m")).first()["m"] or 0
    step = max(int(n) // parts + 1, 1)
    for i in range(parts):
        part = docs.where((F.col(order) >= i * step) & (F.col(order) < (i + 1) * step))
        part.select("value").write.mode("overwrite").text(f"{path}/{i:03d}")


@query("stream_upserted_default_order", oracle="""
WITH b AS (SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS player_id FROM orders),
late AS (SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS player_id FROM orders WHERE o_custkey % 2 = 0)
SELECT b.player_id, '{"player_id": ' || b.player_id || ', "batch": ' || CASE WHEN late.player_id IS NULL THEN 0 ELSE 1 END || '}' AS doc
FROM b LEFT JOIN late ON b.player_id = late.player_id""")
def q_stream_upsert_default(spark, d):
    """Without an order field the later batch wins: the first arrives in many
    files and partitions, the second in a few."""
    base = scratch_path(spark, f"streams/late-{uuid.uuid4().hex}")
    o = fx.read_table(spark, d, "orders", ["o_custkey"]).distinct()
    doc = lambda b: F.concat(F.lit('{"player_id": '), F.col("o_custkey"), F.lit(f', "batch": {b}}}')).alias("value")
    o.select(doc(0)).repartition(6).write.text(f"{base}/landing/0")

    def run():
        upsert_players_stream(spark.readStream.text(f"{base}/landing/*"), f"{base}/store", f"{base}/ckpt")

    run()
    o.where(F.col("o_custkey") % 2 == 0).select(doc(1)).coalesce(2).write.text(f"{base}/landing/1")
    run()
    return read_store(spark, f"{base}/store")[0]


@query("stream_session_table", ts=('start_time',), oracle=with_ctes("sessions") + """
SELECT session_id, player_id, game_id, start_time, strftime(CAST(start_time AS DATE), '%Y-%m-%d') AS start_date FROM sessions""")
def q_stream_session_table(spark, d):
    """ST1 on the domain's sessions: JSON records through V1 into the IO5
    table; some are delivered twice."""
    base = scratch_path(spark, f"streams/sessions-{uuid.uuid4().hex}")
    s = fx.game_sessions(spark, d).select(F.to_json(F.struct(
        "session_id", "player_id", "game_id", F.date_format("start_time", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("start_time"))).alias("value"), "session_id")
    _land(s, "session_id", f"{base}/landing", 2)
    s.where(F.col("session_id") % 5 == 0).select("value").write.text(f"{base}/landing/again")
    stream = spark.readStream.option("maxFilesPerTrigger", 8).text(f"{base}/landing/*")
    ST.sessions_to_table_stream(stream, f"{base}/table", f"{base}/ckpt")
    back = spark.read.parquet(f"{base}/table")
    return back.select("session_id", "player_id", "game_id", "start_time", F.date_format("start_date", "yyyy-MM-dd").alias("start_date"))


@query("stream_revised_sessions", ts=('start_time', 'end_time'), oracle=with_ctes("sessions_all") + """
SELECT session_id, player_id, game_id, start_time, last_ts AS end_time,
  CAST(date_diff('microsecond', start_time, last_ts) AS DOUBLE) / 1000000 AS session_duration,
  strftime(CAST(start_time AS DATE), '%Y-%m-%d') AS start_date FROM sessions_all""")
def q_stream_revised(spark, d):
    """ST3 with late actions: the events arrive in three parts, each spread over all
    days, so later parts extend and join sessions that earlier ones wrote."""
    base = scratch_path(spark, f"streams/revised-{uuid.uuid4().hex}")
    ev = fx.read_table(spark, d, "events")
    part = F.pmod(F.xxhash64("event_id"), F.lit(3)).cast("int")
    ev.withColumn("part", part).write.partitionBy("part").parquet(f"{base}/landing")
    for i in range(3):
        stream = ST.read_events_stream(spark, f"{base}/landing/part={i}")
        ST.revise_sessions_stream(_actions(stream), f"{base}/sessions", f"{base}/ckpt-{i}", fx.SESSION_GAP)
    return read_sessions(spark, f"{base}/sessions").select(
        "session_id", "player_id", "game_id", "start_time", "end_time", "session_duration",
        F.date_format("start_date", "yyyy-MM-dd").alias("start_date"))
