"""Structured Streaming forms of ingest, daily quality and sessionisation
(ST1-ST3). The transformations are the batch operators applied to a
streaming DataFrame; state is bounded by watermarks.

Sinks are file sinks (Parquet) with a checkpoint location, so a restarted
query resumes exactly where it stopped; ``foreachBatch`` writes are keyed by
batch id and overwrite only their own partition, so a replayed batch is
idempotent.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.operators.sessions import sessionize_stream
from lodestar.operators.validate import admit
from lodestar.sources.session_store import revise_sessions
from lodestar.sources.tables import _Folder, append_sessions, path_exists

EVENT_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("props", T.StringType()),
])


def read_events_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Event files (Parquet) as a stream; event time cast to TIMESTAMP (LTZ)
    because watermarks reject TIMESTAMP_NTZ. A single file is addressed
    through a one-file glob (the file source lists a directory or a glob)."""
    import os

    if os.path.splitext(path)[1] == ".parquet" and not any(ch in path for ch in "*?["):
        head, tail = os.path.split(path)
        path = f"{head}/[{tail[0]}]{tail[1:]}"
    r = spark.readStream.schema(EVENT_SCHEMA)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def ingest_events(events: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """ST1 (sessions side): drop re-delivered events (same event_id) within
    the watermark; the first delivery passes through immediately."""
    return (events.withWatermark("ts", watermark)
            .dropDuplicatesWithinWatermark(["event_id"])
            .select("event_id", F.col("user_id").alias("player_id"), "ts",
                    F.col("event_type").alias("action_type")))


def daily_quality_stream(events: DataFrame, watermark: str = "1 hour", click: str = "click",
                         conversion: str = "purchase") -> DataFrame:
    """ST2: per day count, avg click rate and avg conversion rate, emitted in
    append mode once the watermark passes the day's end; rows later than the
    watermark are dropped."""
    rates = events.select(
        F.col("ts").alias("created_at"),
        F.when(F.col("event_type") == click, 1.0).otherwise(0.0).alias("click_rate"),
        F.when(F.col("event_type") == conversion, 1.0).otherwise(0.0).alias("conversion_rate"),
    )
    return quality_log_stream(rates, watermark)


def sessions_stream(actions: DataFrame, gap: str = "12 hours", watermark: str = "1 hour", player: str = "player_id",
                    ts: str = "ts", event: str = "event_id", game: str = "game_id") -> DataFrame:
    """ST3: gap sessions per player; a session is emitted once the watermark
    passes its last event + gap. Actions later than the watermark are dropped;
    ``revise_sessions_stream`` takes them in."""
    a = actions.select(F.col(event).alias("event_id"), F.col(player).alias("player_id"), F.col(ts).alias("ts"),
                       F.col(game).alias("game_id"))
    return sessionize_stream(a, "player_id", "ts", gap, watermark, aggs=[
        F.min("event_id").alias("session_id"),
        F.min_by("game_id", F.struct("ts", "event_id")).alias("game_id"),
        F.count(F.lit(1)).alias("n_events"),
    ])


def revise_sessions_stream(actions: DataFrame, store: str, checkpoint: str, gap: str = "12 hours",
                           player: str = "player_id", ts: str = "ts", event: str = "event_id",
                           game: str = "game_id") -> None:
    """ST3 without a watermark: every batch of actions is merged into the session store
    (IO5), where a late action extends or joins sessions written before. The store names
    the batches it holds, so one that runs again is left out."""

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        revise_sessions(batch, store, gap, player, ts, event, game, _query_id(batch.sparkSession, checkpoint), batch_id)

    q = (actions.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()


def run_available(df: DataFrame, sink: str, checkpoint: str, mode: str = "append", fmt: str = "parquet") -> None:
    """Process everything available now, then stop (no server, no port)."""
    q = (df.writeStream.format(fmt).outputMode(mode).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start(sink))
    q.awaitTermination()


def _query_id(spark: SparkSession, checkpoint: str) -> str:
    """The id a streaming query keeps across restarts of one checkpoint."""
    return spark.read.text(f"{checkpoint}/metadata").select(F.get_json_object("value", "$.id")).first()[0]


def _run_number(spark: SparkSession, store: str, run_id: str) -> int:
    """Runs (checkpoints) that write to a store log are numbered as they come; the
    numbers are read from the log's folders, not from its rows."""
    folder = _Folder(spark, store)
    numbers = [n for n in folder.names("") if n.startswith("run=")]
    held = [n for n in numbers if f"run_id={run_id}" in folder.names(n)]
    return int(held[0][4:]) if held else max((int(n[4:]) for n in numbers), default=0) + 1


def upsert_documents_stream(docs: DataFrame, store: str, checkpoint: str, raw_col: str = "value",
                            order: str | None = None) -> None:
    """ST1 (documents side): admitted documents (V3) are appended to the
    store log; ``latest_documents`` gives the current document per player (V8).

    The log is partitioned by run (one per checkpoint) and batch: a replayed
    batch overwrites its own partition, and a new checkpoint, whose batches
    count from 0 again, writes beside the old ones. ``order`` is a JSON path
    of a document field that orders updates; ties, and everything by default,
    go by arrival (run, batch, position in the batch)."""

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        run_id = _query_id(spark, checkpoint)
        adm = admit(batch.withColumnRenamed(raw_col, "raw"), "raw")
        seq = F.get_json_object("raw", order).cast("long") if order else F.lit(None).cast("long")
        out = adm.select("player_id", F.col("raw").alias("doc"), seq.alias("seq"),
                         F.monotonically_increasing_id().alias("pos"),
                         F.lit(_run_number(spark, store, run_id)).cast("long").alias("run"),
                         F.lit(run_id).alias("run_id"), F.lit(batch_id).cast("long").alias("batch_id"))
        (out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("run", "run_id", "batch_id").parquet(store))

    q = (docs.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()


_ARRIVAL = ("seq", "run", "batch_id", "pos")


def latest_documents(spark: SparkSession, store: str) -> DataFrame:
    """Current document per player from the store log: the greatest seq (none
    is smallest), then the latest arrival; aggregated map-side."""
    log = spark.read.parquet(store)
    rank = F.struct(*[F.coalesce(F.col(c).cast("long"), F.lit(-(2**63))).alias(c) for c in _ARRIVAL])
    best = log.groupBy("player_id").agg(F.max_by(F.struct("doc", "seq"), rank).alias("_r"))
    return best.select("player_id", F.col("_r.doc").alias("doc"), F.col("_r.seq").alias("seq"))


def compact_documents(spark: SparkSession, store: str, target: str) -> None:
    """Write the log's winning entries (with their arrival) as a new log, so
    reads no longer grow with the number of updates."""
    log = spark.read.parquet(store)
    rank = F.struct(*[F.coalesce(F.col(c).cast("long"), F.lit(-(2**63))).alias(c) for c in _ARRIVAL])
    cols = [c for c in log.columns if c != "player_id"]
    best = log.groupBy("player_id").agg(F.max_by(F.struct(*cols), rank).alias("_r"))
    best.select("player_id", "_r.*").write.partitionBy("run", "run_id", "batch_id").parquet(target)


def sessions_to_table_stream(records: DataFrame, table: str, checkpoint: str, raw_col: str = "value") -> None:
    """ST1 on the domain's own sessions: JSON records (session_id, player_id,
    game_id, start_time) are validated (V1), parsed and appended to the
    partitioned session table (IO5). A record that does not parse to a
    session with a start time is left out of the table. Of the records of one
    session id the first stays: by batch, then by position in the batch. A
    replayed batch is recognised by the session ids it brings again."""

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        ok = admit(batch.withColumnRenamed(raw_col, "raw"), "raw")
        s = ok.select(F.from_json("raw", "session_id long, player_id long, game_id long, start_time timestamp_ntz").alias("s"),
                      F.monotonically_increasing_id().alias("pos"))
        s = s.where(F.col("s.session_id").isNotNull() & F.col("s.start_time").isNotNull())
        s = s.groupBy(F.col("s.session_id").alias("_id")).agg(F.min_by("s", "pos").alias("s")).select("s.*")
        if path_exists(spark, table):
            # a record may come again with another day: ids are compared over all days, in
            # the files whose range of ids meets the batch's
            low, high = s.agg(F.min("session_id"), F.max("session_id")).first()
            old = spark.read.parquet(table).where(F.col("session_id").between(low, high)).select("session_id")
            s = s.join(old, "session_id", "left_anti")
        append_sessions(s, table)

    q = (records.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()


def quality_log_stream(log: DataFrame, watermark: str = "1 hour", created_at: str = "created_at",
                       click_rate: str = "click_rate", conversion_rate: str = "conversion_rate") -> DataFrame:
    """ST2 on the recommendation log itself: per day count and mean rates,
    emitted once the watermark passes the day's end."""
    r = log.select(F.col(created_at).cast("timestamp").alias("created_at"), F.col(click_rate).alias("click_rate"),
                   F.col(conversion_rate).alias("conversion_rate")).withWatermark("created_at", watermark)
    return r.groupBy(F.window("created_at", "1 day").alias("w")).agg(
        F.count(F.lit(1)).alias("total_recommendations"),
        F.avg("click_rate").alias("avg_click_rate"),
        F.avg("conversion_rate").alias("avg_conversion"),
    ).select(F.to_date("w.start").alias("date"), "total_recommendations", "avg_click_rate", "avg_conversion")


def stream_ingest(spark: SparkSession, src: str, sink: str, ckpt: str, watermark: str = "1 hour") -> None:
    """ST1: events landing under ``src`` -> de-duplicated append to ``sink``."""
    run_available(ingest_events(read_events_stream(spark, src), watermark), sink, ckpt)


def stream_daily_quality(log: DataFrame, delay: str = "1 hour") -> DataFrame:
    """ST2 under its inventory name (see ``quality_log_stream``)."""
    return quality_log_stream(log, delay)


def sessionize(actions: DataFrame, gap: str = "12 hours", watermark: str = "1 hour", player: str = "player_id",
               ts: str = "ts", event: str = "event_id", game: str = "game_id") -> DataFrame:
    """ST3 under its inventory name (see ``sessions_stream``)."""
    return sessions_stream(actions, gap, watermark, player, ts, event, game)
