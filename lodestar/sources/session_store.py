"""Sessions that later events may still extend or join (IO5, ST3).

A session is mergeable: two pieces of one player whose distance is at most the gap are
one session, whichever events came first. ``revise_sessions`` merges the sessions of new
events with the stored ones they touch and replaces only the days this changes.

Layout: ``data/write=W/start_date=D`` holds the sessions that start on a day; the newest
manifest ``_manifests/N`` names the folder of each day, the last end among its sessions
and the batches already merged, so a revision counts once its manifest is there.
"""

from __future__ import annotations

import json
import uuid
from datetime import date, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.sources.tables import _Folder, _forget, _manifests

COLUMNS = ["session_id", "player_id", "game_id", "start_time", "end_time", "session_duration"]
FILES_PER_DAY = 8


def _newest(folder: _Folder) -> tuple[int, dict]:
    numbers = _manifests(folder)
    if not numbers:
        return 0, {"folders": {}, "until": {}, "applied": {}, "gap": None}
    return numbers[-1], json.loads(folder.read(f"_manifests/{numbers[-1]}"))


def read_sessions(spark: SparkSession, path: str, days: list[str] | None = None) -> DataFrame:
    """Sessions as of the newest manifest (IO5's columns, ``first_event``, ``start_date``);
    of the given start days or of all. F1's date filter prunes folders as on IO5's table.
    A store without sessions raises ``ValueError``, as it has no column types yet."""
    return _read(spark, path, _newest(_Folder(spark, path))[1], days)


def _read(spark: SparkSession, path: str, manifest: dict, days: list[str] | None) -> DataFrame:
    held = manifest["folders"]
    base = path.rstrip("/")
    chosen = [f"{base}/{f}" for d, f in held.items() if days is None or d in days]
    if not held:
        raise ValueError(f"no sessions in {path}")
    if not chosen:  # no such day: types of any, rows of none
        return _read(spark, path, manifest, [next(iter(held))]).where(F.lit(False))
    return spark.read.option("basePath", f"{base}/data").parquet(*chosen).select(
        *COLUMNS, "first_event", F.col("start_date").cast("date").alias("start_date"))


def _micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def _gap_micros(gap: str) -> Column:
    return F.expr(f"unix_micros(timestamp_micros(0) + INTERVAL '{gap}')")


def merge_pieces(pieces: DataFrame, gap: str, extra: list[Column] | None = None) -> DataFrame:
    """Pieces of sessions (player_id, session_id, game_id, first_event, start_time,
    end_time) to whole ones: a window of dynamic length ``end - start + gap`` from each
    start, merged by Spark. The smallest session id stays; the game is that of the first
    event. Pieces are combined map-side, so a very active player ships few rows."""
    length = ((_micros("end_time") - _micros("start_time") + _gap_micros(gap)) / F.lit(1_000_000)).cast("decimal(18,6)")
    window = F.session_window(F.col("start_time").cast("timestamp"), F.make_interval(secs=length))
    first = F.struct(F.col("start_time"), F.col("first_event"))
    out = pieces.groupBy("player_id", window.alias("_w")).agg(
        F.min("session_id").alias("session_id"),
        F.min(F.struct(first.alias("at"), "game_id")).alias("_first"),
        F.min("start_time").alias("start_time"), F.max("end_time").alias("end_time"), *(extra or []))
    return out.withColumns({
        "game_id": F.col("_first.game_id"), "first_event": F.col("_first.at.first_event"),
        "session_duration": (_micros("end_time") - _micros("start_time")) / F.lit(1_000_000.0),
        "start_date": F.to_date("start_time")}).drop("_w", "_first")


def pieces_of(actions: DataFrame, player: str = "player_id", ts: str = "ts", event: str = "event_id",
              game: str = "game_id") -> DataFrame:
    """Every action as a session of its own. Actions without a time are left out, as they
    belong to no session; NULL is a player like any other."""
    t = F.col(ts).cast("timestamp_ntz")
    return actions.where(t.isNotNull()).select(
        F.col(player).alias("player_id"), F.col(event).alias("session_id"), F.col(game).alias("game_id"),
        F.col(event).alias("first_event"), t.alias("start_time"), t.alias("end_time"))


def revise_sessions(actions: DataFrame, path: str, gap: str = "12 hours", player: str = "player_id", ts: str = "ts",
                    event: str = "event_id", game: str = "game_id", run: str | None = None, batch: int = 0,
                    keep: int = 2) -> list[str]:
    """Merge the sessions of ``actions`` into the store and return the start days it
    rewrote. Actions may come in any order, late ones extend or join written sessions;
    an action that comes again changes nothing. With ``run``, a batch of that run that
    was merged before is left out. One writer at a time; the second of two fails.

    Stored sessions are read of those days only whose sessions can touch a new one:
    between the day and its last end plus the gap lies a day of the new sessions. Both
    lists of days are bounded by the calendar."""
    spark = actions.sparkSession
    folder = _Folder(spark, path)
    number, old = _newest(folder)
    if run is not None and old["applied"].get(run, -1) >= batch:
        return []
    if old["gap"] not in (None, gap):
        raise ValueError(f"the sessions of {path} have a gap of {old['gap']}")
    new = merge_pieces(pieces_of(actions, player, ts, event, game), gap).withColumn("is_new", F.lit(1)).persist()
    both = merged = new
    try:
        pad = F.make_interval(secs=(_gap_micros(gap) / F.lit(1_000_000)).cast("decimal(18,6)"))
        near = new.select(F.explode(F.sequence(F.to_date(F.col("start_time") - pad), F.to_date(F.col("end_time") + pad))).alias("d"))
        days = [r["d"] for r in near.distinct().collect()]
        if not days:
            return []
        close = [d for d in old["folders"] if any(
            date.fromisoformat(d) <= x <= datetime.fromisoformat(old["until"][d]).date() for x in days)]
        if close:
            held = _read(spark, path, old, close).withColumn("is_new", F.lit(0))
            both = held.unionByName(new)
        merged = merge_pieces(both, gap, [F.max("is_new").alias("is_new"), F.collect_set("start_date").alias("_days")]).persist()
        changed = merged.where("is_new = 1").select(F.explode(F.array_append("_days", F.col("start_date"))).alias("d"))
        touched = sorted(str(r["d"]) for r in changed.distinct().collect())
        write = f"data/write={uuid.uuid4().hex}"
        rows = merged.where(F.col("start_date").cast("string").isin(touched)).select(*COLUMNS, "first_event", "start_date")
        spread = F.pmod(F.xxhash64("player_id", "start_time"), F.lit(FILES_PER_DAY))
        rows.repartition("start_date", spread).write.partitionBy("start_date").parquet(f"{folder.path}/{write}")
        last = {str(r["start_date"]): r["e"].isoformat() for r in
                rows.groupBy("start_date").agg(F.max("end_time").alias("e")).collect()}
    finally:
        new.unpersist()
        merged.unpersist()
    kept = {d: f for d, f in old["folders"].items() if d not in touched}
    state = {
        "folders": {**kept, **{d: f"{write}/start_date={d}" for d in last}},
        "until": {**{d: old["until"][d] for d in kept}, **last},
        "applied": {**old["applied"], **({run: batch} if run is not None else {})}, "gap": gap}
    folder.commit(f"_manifests/{number + 1}", json.dumps(state))
    _forget(folder, [v for v in _manifests(folder) if v <= number + 1 - keep])
    return touched
