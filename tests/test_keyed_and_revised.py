"""Keyed state of documents, and sessions revised by late actions."""

import random
import uuid
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lodestar.operators.filters import recent_sessions
from lodestar.session import scratch_path
from lodestar.sources.session_store import _newest, read_sessions, revise_sessions
from lodestar.sources.tables import _Folder, _manifest, read_store
from lodestar.streaming import streams as ST
from lodestar.streaming.keyed import upsert_players_stream

START = datetime(2024, 1, 1)


def _base(spark, name):
    return scratch_path(spark, f"tests/{name}-{uuid.uuid4().hex}")


def _land(spark, path, docs):
    spark.createDataFrame([(d,) for d in docs], "value string").coalesce(1).write.text(path)


def _upsert(spark, base, ckpt="ckpt", order="$.v"):
    stream = spark.readStream.option("maxFilesPerTrigger", 1).text(f"{base}/in/*")
    upsert_players_stream(stream, f"{base}/store", f"{base}/{ckpt}", order=order)


def _players(spark, base):
    return {r["player_id"]: r["doc"] for r in read_store(spark, f"{base}/store")[0].collect()}


def _forget_last_commit(spark, base, batch):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{base}/ckpt/commits/{batch}")
    assert path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, False)


def test_state_survives_restart_replay_and_new_checkpoint(spark):
    base = _base(spark, "keyed")
    new = '{"player_id": "a", "v": 9007199254740993}'
    _land(spark, f"{base}/in/0", ['{"player_id": "a", "v": 9007199254740992}', new, '{"player_id": null, "v": 1}',
                                  '{"x": 1}', "cut {", '{"player_id": [1], "v": 1}', '{"player_id": "b"}'])
    _upsert(spark, base)
    first = {"a": new, None: '{"player_id": null, "v": 1}', "b": '{"player_id": "b"}'}
    assert _players(spark, base) == first
    # the write happened, its commit did not: the batch runs again
    _forget_last_commit(spark, base, 0)
    _upsert(spark, base)
    assert _players(spark, base) == first
    # after the restart an older document loses against the state, a tie goes to the later one
    _land(spark, f"{base}/in/1", ['{"player_id": "a", "v": 3}', '{"player_id": "b", "n": 2}', '{"player_id": null, "v": 1}'])
    _upsert(spark, base)
    assert _players(spark, base) == {**first, "b": '{"player_id": "b", "n": 2}'}
    # a new checkpoint starts from the store and meets all files again
    _upsert(spark, base, ckpt="other")
    assert _players(spark, base)["a"] == new


def test_only_changed_players_are_written(spark):
    base = _base(spark, "changes")
    _land(spark, f"{base}/in/0", [f'{{"player_id": "p{i}", "v": 1}}' for i in range(200)])
    _upsert(spark, base)
    folder = _Folder(spark, f"{base}/store")
    before = _manifest(folder)["folders"]
    # equal and older documents change nothing, so no bucket is written
    _land(spark, f"{base}/in/1", ['{"player_id": "p1", "v": 1}', '{"player_id": "p2", "v": 0}'])
    _upsert(spark, base)
    assert _manifest(folder)["folders"] == before
    _land(spark, f"{base}/in/2", ['{"player_id": "p1", "v": 2}'])
    _upsert(spark, base)
    after = _manifest(folder)["folders"]
    assert sum(after[b] != before[b] for b in before) == 1 and len(_players(spark, base)) == 200


def test_hot_player_keeps_its_last_document(spark):
    base = _base(spark, "hot")
    docs = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("p"), F.col("id") % 50)).alias("p"), "id")
    docs.select(F.to_json(F.struct(F.col("p").alias("player_id"), F.col("id").alias("v"))).alias("value")).repartition(6).write.text(f"{base}/in/0")
    _upsert(spark, base)
    want = {r["p"]: r["v"] for r in docs.groupBy("p").agg(F.max("id").alias("v")).collect()}
    got = _players(spark, base)
    assert {p: int(d.split('"v":')[1].rstrip("}")) for p, d in got.items()} == want


def _sessions(rows, gap):
    """Brute force: (player, id, game, start, end) a session."""
    out = []
    for player in {r[1] for r in rows}:
        own = sorted({(r[2], r[0], r[3]) for r in rows if r[1] == player and r[2] is not None})
        part = []
        for at, event, game in own:
            if part and at - part[-1][0] > gap:
                out.append((player, min(p[1] for p in part), part[0][2], part[0][0], part[-1][0]))
                part = []
            part.append((at, event, game))
        if part:
            out.append((player, min(p[1] for p in part), part[0][2], part[0][0], part[-1][0]))
    return sorted(out, key=str)


SCHEMA = "event_id long, player_id long, ts timestamp_ntz, game_id long"


def _stored(spark, path):
    rows = read_sessions(spark, path).collect()
    assert all(r["start_date"] == r["start_time"].date() for r in rows)
    assert all(r["session_duration"] == (r["end_time"] - r["start_time"]).total_seconds() for r in rows)
    return sorted(((r["player_id"], r["session_id"], r["game_id"], r["start_time"], r["end_time"]) for r in rows), key=str)


def test_revised_sessions_equal_brute_force_in_any_order(spark):
    rng = random.Random(5)
    rows = []
    for i in range(900):
        player = None if i % 20 == 0 else 1 if i % 3 == 0 else rng.randrange(2, 9)
        rows.append((i, player, START + timedelta(seconds=rng.randrange(20 * 86_400), microseconds=rng.randrange(10**6)), i % 7))
    # events at exactly the gap, one microsecond beyond, at one time, and without a time
    edge = START + timedelta(days=40)
    for i, d in enumerate([timedelta(0), timedelta(hours=12), timedelta(hours=24, microseconds=1), timedelta(0)]):
        rows.append((2000 + i, 50, edge + d, 10 + i))
    rows.append((3000, 50, None, 1))
    rng.shuffle(rows)
    path = _base(spark, "revised")
    for k in range(5):
        revise_sessions(spark.createDataFrame(rows[k::5], SCHEMA), path, "12 hours")
    want = _sessions(rows, timedelta(hours=12))
    assert _stored(spark, path) == want
    # actions that come again change nothing
    revise_sessions(spark.createDataFrame(rows[:300], SCHEMA), path, "12 hours")
    assert _stored(spark, path) == want
    with pytest.raises(ValueError, match="gap"):
        revise_sessions(spark.createDataFrame(rows[:3], SCHEMA), path, "1 hour")


def test_late_action_joins_sessions_and_moves_their_day(spark):
    path = _base(spark, "joins")
    at = lambda d, h: START + timedelta(days=d, hours=h)
    rows = [(1, 7, at(3, 1), 1), (2, 7, at(3, 20), 2), (3, 7, at(9, 0), 3), (4, 8, at(3, 5), 4), (5, 8, at(30, 0), 5)]
    revise_sessions(spark.createDataFrame(rows, SCHEMA), path, "12 hours", run="r", batch=0)
    assert len(_stored(spark, path)) == 5
    before = _newest(_Folder(spark, path))[1]["folders"]
    # one joins both sessions of day 3, one moves the joined session to day 2
    late = [(6, 7, at(3, 11), 6), (7, 7, at(2, 20), 7)]
    days = revise_sessions(spark.createDataFrame(late, SCHEMA), path, "12 hours", run="r", batch=1)
    assert days == ["2024-01-03", "2024-01-04"]
    assert _stored(spark, path) == _sessions(rows + late, timedelta(hours=12)) and len(_stored(spark, path)) == 4
    after = _newest(_Folder(spark, path))[1]["folders"]
    assert all(after[d] == before[d] for d in ("2024-01-10", "2024-01-31"))
    # a batch of the run that was merged before is left out; no actions are no revision
    assert revise_sessions(spark.createDataFrame([(9, 9, at(1, 0), 9)], SCHEMA), path, "12 hours", run="r", batch=1) == []
    assert revise_sessions(spark.createDataFrame([], SCHEMA), path, "12 hours") == []
    # F1 reads the days it asks for only
    recent = recent_sessions(read_sessions(spark, path), "2024-02-05", days=10)
    assert [r["session_id"] for r in recent.collect()] == [5]
    assert "PartitionFilters: [isnotnull(start_date" in recent._jdf.queryExecution().executedPlan().toString()


def test_day_without_sessions_leaves_the_store(spark):
    path = _base(spark, "emptied")
    revise_sessions(spark.createDataFrame([(1, 7, START + timedelta(hours=25), 1)], SCHEMA), path, "12 hours")
    revise_sessions(spark.createDataFrame([(2, 7, START + timedelta(hours=20), 2)], SCHEMA), path, "12 hours")
    assert list(_newest(_Folder(spark, path))[1]["folders"]) == ["2024-01-01"]
    assert [(r["session_id"], r["game_id"]) for r in read_sessions(spark, path).collect()] == [(1, 2)]


def test_stream_of_late_actions_equals_batch_after_replay(spark):
    base = _base(spark, "late")
    rng = random.Random(9)
    rows = [(i, rng.randrange(4), START + timedelta(seconds=rng.randrange(15 * 86_400)), i % 5) for i in range(400)]
    for k in range(3):
        spark.createDataFrame(rows[k::3], SCHEMA).coalesce(1).write.parquet(f"{base}/in/{k}")

    def run():
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{base}/in/*")
        ST.revise_sessions_stream(stream, f"{base}/sessions", f"{base}/ckpt", "6 hours")

    run()
    want = _sessions(rows, timedelta(hours=6))
    assert _stored(spark, f"{base}/sessions") == want
    _forget_last_commit(spark, base, 2)
    number = _newest(_Folder(spark, f"{base}/sessions"))[0]
    run()
    assert _newest(_Folder(spark, f"{base}/sessions"))[0] == number
    assert _stored(spark, f"{base}/sessions") == want


def test_first_record_of_a_session_id_stays(spark):
    base = _base(spark, "records")
    rec = '{{"session_id": {}, "player_id": 1, "game_id": {}, "start_time": "2024-01-0{}T00:00:00"}}'
    _land(spark, f"{base}/in/0", [rec.format(1, 5, 1), rec.format(1, 6, 2), rec.format(2, 7, 1)])
    run = lambda: ST.sessions_to_table_stream(spark.readStream.text(f"{base}/in/*"), f"{base}/table", f"{base}/ckpt")
    run()
    # sent again with another day
    _land(spark, f"{base}/in/1", [rec.format(2, 8, 3), rec.format(3, 9, 3)])
    run()
    rows = spark.read.parquet(f"{base}/table").select("session_id", "game_id").collect()
    assert sorted(tuple(r) for r in rows) == [(1, 5), (2, 7), (3, 9)]


def test_players_of_one_group_keep_apart_in_one_state(spark, monkeypatch):
    """a call and a state hold a group of players; here all of them are in one."""
    from lodestar.streaming import keyed

    monkeypatch.setattr(keyed, "GROUPS", 1)
    base = _base(spark, "grouped")
    _land(spark, f"{base}/in/0", [f'{{"player_id": "p{i}", "v": {i % 7}}}' for i in range(300)] + ['{"player_id": null, "v": 1}'])
    _upsert(spark, base)
    _land(spark, f"{base}/in/1", [f'{{"player_id": "p{i}", "v": 3, "n": 1}}' for i in range(0, 300, 2)])
    _upsert(spark, base)
    want = {f"p{i}": f'{{"player_id": "p{i}", "v": 3, "n": 1}}' if i % 2 == 0 and i % 7 <= 3 else f'{{"player_id": "p{i}", "v": {i % 7}}}' for i in range(300)}
    assert _players(spark, base) == {**want, None: '{"player_id": null, "v": 1}'}
    _upsert(spark, base, ckpt="other")  # all players of the store are one initial state
    assert _players(spark, base) == {**want, None: '{"player_id": null, "v": 1}'}
