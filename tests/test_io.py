"""Sources and sinks: raw JSON with corrupt lines, store round trip, missing store."""

import uuid

import pytest
from pyspark.sql import types as T

from lodestar.operators.profile import add_players_to_store
from lodestar.session import scratch_path
from lodestar.sources import tables as T_store
from lodestar.sources.tables import read_raw, read_store, write_dataset, write_store


def test_read_raw_keeps_corrupt_lines(spark):
    path = scratch_path(spark, f"tests/raw-{uuid.uuid4().hex}")
    lines = ['{"player_id": "p1", "name": "Ann"}', '{"player_id": 7}', '{"player_id": "p2"', '{"name": "X"}']
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(path)
    schema = T.StructType([T.StructField("player_id", T.StringType()), T.StructField("name", T.StringType())])
    rows = read_raw(spark, path, schema).collect()
    got = sorted((r["player_id"] or "", r["name"] or "", r["_corrupt_record"] or "") for r in rows)
    assert got == sorted([("p1", "Ann", ""), ("7", "", ""), ("", "", '{"player_id": "p2"'), ("", "X", "")])


def test_missing_store_is_empty(spark):
    players, recs = read_store(spark, scratch_path(spark, f"tests/none-{uuid.uuid4().hex}"))
    assert players.count() == 0 and recs.count() == 0


def test_store_roundtrip_keeps_non_ascii(spark):
    path = scratch_path(spark, f"tests/store-{uuid.uuid4().hex}")
    players = spark.createDataFrame([("1", '{"player_id": 1}'), ("2", '{"player_id": 2}')], "player_id string, doc string")
    recs = spark.createDataFrame([("1", ["Новые экшн-игры", "Бестселлеры"])], "player_id string, recommendations array<string>")
    write_store(players, recs, path)
    p2, r2 = read_store(spark, path)
    assert sorted(tuple(r) for r in p2.collect()) == [("1", '{"player_id": 1}'), ("2", '{"player_id": 2}')]
    assert [(r["player_id"], list(r["recommendations"])) for r in r2.collect()] == [
        ("1", ["Новые экшн-игры", "Бестселлеры"])]
    raw = spark.read.text(path).collect()
    assert any("Новые экшн-игры" in r["value"] for r in raw)  # UTF-8, not \\u escapes


def test_write_dataset_dynamic_overwrite(spark):
    path = scratch_path(spark, f"tests/ds-{uuid.uuid4().hex}")
    a = spark.createDataFrame([(1, "d1"), (2, "d2")], "v long, day string")
    write_dataset(a, path, partition_by=["day"])
    write_dataset(spark.createDataFrame([(9, "d2")], "v long, day string"), path, partition_by=["day"])
    got = sorted(tuple(r) for r in spark.read.parquet(path).select("v", "day").collect())
    assert got == [(1, "d1"), (9, "d2")]


def _files(spark, path):
    """Names and modification times of the store's data files, by folder."""
    fs = T_store._Folder(spark, path)
    held = T_store._manifest(fs)["folders"]
    return {b: (f, sorted((s.getPath().getName(), s.getModificationTime()) for s in fs.fs.listStatus(fs.at(f)))) for b, f in held.items()}


def _batch(spark, rows):
    docs = spark.createDataFrame([(i, f'{{"player_id": {p}, "name": "{n}"}}') for i, (p, n) in enumerate(rows)], "doc_seq long, raw string")
    history = spark.createDataFrame([], "player_id long, genre string, duration double, game_type string, ord long")
    return docs, history


def test_a_write_replaces_touched_buckets_only(spark):
    path = scratch_path(spark, f"tests/store-{uuid.uuid4().hex}")
    assert len(add_players_to_store(path, *_batch(spark, [(p, "a") for p in range(1, 300)]))) > 40
    before = _files(spark, path)
    touched = add_players_to_store(path, *_batch(spark, [(7, "b"), (8, "c"), (7, "d")]))
    after = _files(spark, path)
    assert 1 <= len(touched) <= 2
    assert {b for b in before if before[b] != after[b]} == {str(b) for b in touched} and before.keys() == after.keys()
    players, recs = read_store(spark, path)
    docs = {r["player_id"]: r["doc"] for r in players.collect()}
    assert len(docs) == 299 == recs.count() and '"d"' in docs["7"] and '"c"' in docs["8"] and '"a"' in docs["9"]
    assert add_players_to_store(path, *_batch(spark, [])) == [] and _files(spark, path) == after
    some, _ = read_store(spark, path, only=touched)
    assert {"7", "8"} <= {r["player_id"] for r in some.collect()} and some.count() < 30


def test_failed_and_late_writes_leave_the_manifest(spark):
    path = scratch_path(spark, f"tests/store-{uuid.uuid4().hex}")
    add_players_to_store(path, *_batch(spark, [(p, "a") for p in range(1, 50)]))
    before = _files(spark, path)
    players, recs = read_store(spark, path)
    with pytest.raises(Exception, match="outside the buckets"):
        T_store.write_store(players, recs, path, only=[0])
    with pytest.raises(RuntimeError, match="committed first"):
        T_store._Folder(spark, path).commit("_manifests/1", "{}")
    assert _files(spark, path) == before and read_store(spark, path)[0].count() == 49


def test_old_folders_go_once_no_manifest_names_them(spark):
    path = scratch_path(spark, f"tests/store-{uuid.uuid4().hex}")
    null = spark.createDataFrame([(None, "n"), ("1", "x")], "player_id string, doc string")
    none = spark.createDataFrame([], "player_id string, recommendations array<string>")
    for _ in range(4):
        T_store.write_store(null, none, path, buckets=3)
    fs = T_store._Folder(spark, path)
    live = {f for v in T_store._manifests(fs) for f in T_store._manifest(fs, v)["folders"].values()}
    there = {f"data/{w}/{b}" for w in fs.names("data") for b in fs.names(f"data/{w}") if b.startswith("bucket=")}
    assert len(T_store._manifests(fs)) == 2 and live == there
    assert T_store.store_buckets(spark, path) == 3 and read_store(spark, path)[0].count() == 2
