"""Registered queries for the sources and sinks (IO2-IO6): data derived by
Spark from the given tables is written with the library's writers to the
session's checkpoint folder and read back with its readers."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lodestar.operators.profile import titles_long
from lodestar.plans import profiles as PP
from lodestar.plans.registry import query
from lodestar.session import scratch_path
from lodestar.sources import fixtures as fx
from lodestar.sources import tables as T
from lodestar.sources.fixtures import with_ctes


@query("store_roundtrip", oracle=PP.ADD_PLAYERS_SQL)
def q_store_roundtrip(spark, d):
    """IO4 then IO3: the store written by P3 reads back unchanged (JSON Lines,
    non-ASCII titles kept)."""
    players, recs = PP._p3(spark, d)
    path = scratch_path(spark, f"io/store-{uuid.uuid4().hex}")
    T.write_store(players, recs, path)
    _, back = T.read_store(spark, path)
    return titles_long(back).select("player_id", F.col("pos").cast("long").alias("pos"), "title")


@query("appended_sessions", ts=('start_time', 'end_time'), oracle=with_ctes("sessions") + """
SELECT session_id, player_id, game_id, start_time, NULL::TIMESTAMP AS end_time, NULL::DOUBLE AS session_duration,
       strftime(CAST(start_time AS DATE), '%Y-%m-%d') AS start_date
FROM sessions WHERE start_time >= TIMESTAMP '2024-01-15 00:00:00'""")
def q_appended_sessions(spark, d):
    """IO5: new sessions appended in two writes to a start_date-partitioned
    table; a later range read prunes partitions."""
    s = fx.game_sessions(spark, d)
    path = scratch_path(spark, f"io/sessions-{uuid.uuid4().hex}")
    cut = F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")
    T.append_sessions(s.where(F.col("start_time") < cut), path)
    T.append_sessions(s.where(F.col("start_time") >= cut), path)
    back = spark.read.parquet(path).where(F.col("start_date") >= F.lit("2024-01-15").cast("date"))
    return back.select("session_id", "player_id", "game_id", "start_time", "end_time", "session_duration",
                       F.date_format("start_date", "yyyy-MM-dd").alias("start_date"))


@query("raw_collections", oracle=with_ctes("history", "sessions", extra=[("docs", PP.DOCS_SQL), ("hdocs", PP.HISTDOCS_SQL)]) + """
SELECT 'players' AS collection, COUNT(*) AS n_lines,
  COUNT(*) FILTER (NOT json_valid(raw) OR json_type(CASE WHEN json_valid(raw) THEN raw ELSE '0' END) <> 'OBJECT') AS n_corrupt,
  COUNT(*) FILTER (json_valid(raw) AND json_extract_string(CASE WHEN json_valid(raw) THEN raw ELSE '{}' END, '$.name') IS NOT NULL) AS n_named
FROM docs
UNION ALL SELECT 'history', COUNT(*), 0, COUNT(*) FILTER (json_extract_string(raw, '$.genre') IS NOT NULL) FROM hdocs
UNION ALL SELECT 'sessions', COUNT(*), 0, COUNT(end_time) FROM sessions""")
def q_raw_collections(spark, d):
    """IO2: three raw collections, landed as JSON Lines and read with their
    schemas; lines that are no JSON object keep their text."""
    import pyspark.sql.types as ST

    base = scratch_path(spark, f"io/raw-{uuid.uuid4().hex}")
    text = lambda n: ST.StructField(n, ST.StringType(), True)
    lines = {
        "players": (fx.player_documents(spark, d).select(F.col("raw").alias("value")), [text("player_id"), text("name"), text("segment")], "name"),
        "history": (fx.history_documents(spark, d).select(F.col("raw").alias("value")), [text("genre"), text("duration"), text("game_type")], "genre"),
        "sessions": (fx.game_sessions(spark, d).select(F.to_json(F.struct(
            "session_id", "player_id", "game_id", F.col("end_time").cast("string").alias("end_time"))).alias("value")),
            [text("session_id"), text("player_id"), text("game_id"), text("end_time")], "end_time"),
    }
    out = None
    for name, (df, fields, field) in lines.items():
        df.write.text(f"{base}/{name}")
        raw = T.read_raw(spark, f"{base}/{name}", ST.StructType(fields)).select(field, "_corrupt_record")
        row = raw.agg(F.lit(name).alias("collection"), F.count(F.lit(1)).alias("n_lines"),
                      F.count("_corrupt_record").alias("n_corrupt"), F.count(field).alias("n_named"))
        out = row if out is None else out.unionByName(row)
    return out
