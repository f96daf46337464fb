"""Stores, stream order and cleaning on the inputs the registered queries don't hold."""

import uuid

import pytest
from pyspark.sql import functions as F

from lodestar.operators import aggregates as A
from lodestar.operators import validate as V
from lodestar.operators.profile import add_players
from lodestar.session import scratch_path
from lodestar.sources import tables as T
from lodestar.streaming import streams as ST


@pytest.fixture
def base(spark):
    return scratch_path(spark, f"tests/{uuid.uuid4().hex}")


def _docs(spark, ids, batch):
    return spark.createDataFrame([(f'{{"player_id": {i}, "batch": {batch}}}',) for i in ids], "value string")


def _latest(spark, store):
    return {r["player_id"]: r["doc"][-2] for r in ST.latest_documents(spark, store).collect()}


def test_later_batch_wins_whatever_its_partition(spark, base):
    _docs(spark, range(40), 0).repartition(6).write.text(f"{base}/in/0")
    run = lambda ckpt: ST.upsert_documents_stream(spark.readStream.text(f"{base}/in/*"), f"{base}/store", f"{base}/{ckpt}")
    run("a")
    _docs(spark, range(0, 40, 2), 1).coalesce(1).write.text(f"{base}/in/1")
    run("a")
    got = _latest(spark, f"{base}/store")
    assert len(got) == 40 and all(got[str(i)] == ("1" if i % 2 == 0 else "0") for i in range(40))
    ST.compact_documents(spark, f"{base}/store", f"{base}/small")
    assert _latest(spark, f"{base}/small") == got
    assert spark.read.parquet(f"{base}/small").count() == 40


def test_new_checkpoint_keeps_the_log(spark, base):
    _docs(spark, [1, 2], 0).write.text(f"{base}/one/0")
    _docs(spark, [2, 3], 1).write.text(f"{base}/two/0")
    for name in ("one", "two"):
        ST.upsert_documents_stream(spark.readStream.text(f"{base}/{name}/*"), f"{base}/store", f"{base}/ckpt-{name}")
    assert _latest(spark, f"{base}/store") == {"1": "0", "2": "1", "3": "1"}


def test_store_is_rewritten_from_itself(spark, base):
    players = spark.createDataFrame([("a", "{}"), (None, "{}")], "player_id string, doc string")
    recs = spark.createDataFrame([("a", ["x"]), (None, ["y"])], "player_id string, recommendations array<string>")
    T.write_store(players, recs, base)
    for _ in range(3):
        T.write_store(*T.read_store(spark, base), base)
    p, r = T.read_store(spark, base)
    assert sorted(map(tuple, p.collect()), key=repr) == [("a", "{}"), (None, "{}")]
    assert sorted(((x[0], list(x[1])) for x in r.collect()), key=repr) == [("a", ["x"]), (None, ["y"])]
    assert len(spark.read.text(base).select("value").distinct().collect()) == 2  # one row an id, NULL included


def test_failed_write_keeps_the_store(spark, base):
    players = spark.createDataFrame([("a", "{}")], "player_id string, doc string")
    recs = spark.createDataFrame([("a", ["x"])], "player_id string, recommendations array<string>")
    T.write_store(players, recs, base)
    bad = players.withColumn("doc", F.raise_error(F.lit("stop")).cast("string"))
    with pytest.raises(Exception):
        T.write_store(bad, recs, base)
    assert T.read_store(spark, base)[0].count() == 1


def test_null_id_is_replaced_not_doubled(spark):
    history = spark.createDataFrame([], "player_id string, genre string, duration double, game_type string, ord long, poison boolean")
    docs = spark.createDataFrame([('{"player_id": null}', 1), ('{"player_id": "x"}', 2)], "raw string, doc_seq long")
    empty = spark.createDataFrame([], T.STORE_SCHEMA)
    players, recs = empty.select("player_id", "doc"), empty.select("player_id", "recommendations")
    for _ in range(2):
        players, recs = add_players(players, recs, docs, history)
    assert sorted((r["player_id"] for r in recs.collect()), key=repr) == ["x", None] or sorted(
        (r["player_id"] for r in recs.collect()), key=repr) == [None, "x"]


def test_stats_average_the_duration_column(spark):
    rows = [(1, 7, 3, "2024-02-01 10:00:00", None, 600.0), (2, 7, 3, "2024-02-01 11:00:00", "2024-02-01 11:00:10", 0.5), (3, 7, 3, "2024-02-01 12:00:00", None, None)]
    s = spark.createDataFrame(rows, "session_id long, player_id long, game_id long, start_time string, end_time string, session_duration double")
    s = s.withColumn("start_time", F.col("start_time").cast("timestamp_ntz")).withColumn("end_time", F.col("end_time").cast("timestamp_ntz"))
    one = A.player_stats_one(s, 7, "2024-02-15 00:00:00").first()
    assert (one["n_sessions"], one["avg_duration"]) == (3, 300.25)
    games = spark.createDataFrame([(3, "rpg")], "game_id long, genre_id string")
    assert A.genre_stats(s, games).first()["avg_session_time"] == 300.25


def test_clean_casts_and_takes_maps(spark):
    df = spark.createDataFrame([(" 1 ", "x", {"a": 1}), ("1", "y", {"b": 2}), ("oops", "z", None)], "k string, v string, m map<string,int>")
    out = V.clean(df, ["k"], types={"k": "long"}).collect()
    assert [(r["k"], r["v"], r["m"]) for r in out] == [(1, "y", {"b": 2})]


def test_totals_do_not_depend_on_order(spark):
    rows = [("p", 0.1)] * 10_000 + [("p", 1e-6)]
    h = spark.createDataFrame(rows, "player_id string, duration double")
    players = spark.createDataFrame([("p",)], "player_id string")
    assert A.total_play_time(players, h).first()["total_play_time"] == 1000.000001


def test_quantiles_narrow_down(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(0, 1, 4000), np.full(3000, 0.25), rng.normal(5, 1e-6, 3000)])
    df = spark.createDataFrame([("c", float(v)) for v in x], "column string, value double")
    qs = [0.1, 0.25, 0.5, 0.75, 0.9]
    got = {r["q"]: r["value"] for r in A.exact_quantiles(df, qs, buckets=8, small=100).collect()}
    for q in qs:
        assert got[q] == pytest.approx(float(np.quantile(x, q)), abs=1e-12)
