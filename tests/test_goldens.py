"""Golden values derived by reading the reference (its smoke blocks and rules)."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.functions.scalar import FALLBACK_TITLES, GENRE_TITLES, NOVICE_TITLE, SKILLED_TITLE, TYPE_TITLES
from lodestar.functions.scalar import skill_level
from lodestar.operators.profile import build_profiles, recommend_titles
from lodestar.operators.validate import (
    apply_history_defaults,
    collect_rejected,
    collect_valid,
    rejection_reason,
    require_truthy_id,
)

HIST_SCHEMA = "player_id string, ord struct<o:int>, raw string"


def _hist(spark, pid, rows):
    import json

    data = [(pid, (i,), json.dumps(r)) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, HIST_SCHEMA)


def _profile(spark, pid, rows, players=None):
    h = apply_history_defaults(_hist(spark, pid, rows), raw_col="raw")
    p = spark.createDataFrame([(x,) for x in (players or [pid])], "player_id string")
    return build_profiles(p, h)


def _titles(spark, pid, rows):
    prof = _profile(spark, pid, rows)
    req = spark.createDataFrame([(pid,)], "player_id string")
    return recommend_titles(req, prof).first()["recommendations"]


SMOKE_HISTORY = [
    {"genre": "action", "duration": 50, "game_type": "multiplayer"},
    {"genre": "rpg", "duration": 120, "game_type": "singleplayer"},
    {"genre": "action", "duration": 30, "game_type": "multiplayer"},
    {"genre": "strategy", "duration": 80, "game_type": "singleplayer"},
]
FIXED_HISTORY = [
    {"genre": "action", "duration": 60, "game_type": "multiplayer"},
    {"genre": "rpg", "duration": 90, "game_type": "singleplayer"},
]


def test_smoke_profile_user123(spark):
    p = _profile(spark, "user123", SMOKE_HISTORY).first()
    assert p["total_play_time"] == 280
    assert [(g["genre"], g["n"]) for g in p["favorite_genres"]] == [("action", 2), ("rpg", 1), ("strategy", 1)]
    assert p["skill_level"] == "intermediate"
    assert p["preferred_game_types"] == "singleplayer"  # 2-2 tie -> first in order


def test_smoke_titles_user123(spark):
    assert _titles(spark, "user123", SMOKE_HISTORY) == [
        GENRE_TITLES["action"], GENRE_TITLES["rpg"], GENRE_TITLES["strategy"], NOVICE_TITLE]


def test_fixed_history_titles(spark):
    p = _profile(spark, "p1", FIXED_HISTORY).first()
    assert p["total_play_time"] == 150
    assert [(g["genre"], g["n"]) for g in p["favorite_genres"]] == [("action", 1), ("rpg", 1)]
    assert p["preferred_game_types"] == "singleplayer"
    assert _titles(spark, "p1", FIXED_HISTORY) == [GENRE_TITLES["action"], GENRE_TITLES["rpg"], NOVICE_TITLE]


def test_unknown_player_fallback(spark):
    prof = _profile(spark, "known", FIXED_HISTORY)
    req = spark.createDataFrame([("nobody",)], "player_id string")
    assert recommend_titles(req, prof).first()["recommendations"] == FALLBACK_TITLES


def test_empty_history(spark):
    h = apply_history_defaults(spark.createDataFrame([], HIST_SCHEMA), raw_col="raw")
    p = build_profiles(spark.createDataFrame([("solo",)], "player_id string"), h).first()
    assert (p["total_play_time"], list(p["favorite_genres"]), p["skill_level"], p["preferred_game_types"]) == (
        0, [], "beginner", "singleplayer")
    req = spark.createDataFrame([("solo",)], "player_id string")
    prof = build_profiles(spark.createDataFrame([("solo",)], "player_id string"), h)
    assert recommend_titles(req, prof).first()["recommendations"] == [NOVICE_TITLE]


def test_falsy_ids_get_no_profile(spark):
    df = spark.createDataFrame([("",), (None,), ("x",)], "player_id string")
    assert [r["player_id"] for r in require_truthy_id(df).collect()] == ["x"]
    df2 = spark.createDataFrame([(0,), (None,), (5,)], "player_id long")
    assert [r["player_id"] for r in require_truthy_id(df2).collect()] == [5]


def test_explicit_null_duration_poisons(spark):
    rows = [{"genre": "rpg", "duration": None, "game_type": "coop"}, {"genre": "rpg", "duration": 5}]
    assert _profile(spark, "z", rows).count() == 0
    req = spark.createDataFrame([("z",)], "player_id string")
    assert recommend_titles(req, _profile(spark, "z", rows)).first()["recommendations"] == FALLBACK_TITLES


def test_missing_vs_null_defaults(spark):
    rows = [{"duration": 10}, {"genre": None, "duration": 1, "game_type": None}, {"genre": "rpg", "duration": 2}]
    h = apply_history_defaults(_hist(spark, "q", rows), raw_col="raw").orderBy("ord").collect()
    assert [(r["genre"], r["game_type"]) for r in h] == [("unknown", "singleplayer"), (None, None),
                                                         ("rpg", "singleplayer")]
    p = _profile(spark, "q", rows).first()
    # explicit null genre is its own group and takes a top-3 place but yields no title
    assert [(g["genre"], g["n"]) for g in p["favorite_genres"]] == [("unknown", 1), (None, 1), ("rpg", 1)]


def test_skill_thresholds(spark):
    df = spark.createDataFrame([(float(x),) for x in (100, 101, 500, 501, 1000, 1001)], "t double")
    got = [r[0] for r in df.select(skill_level("t")).collect()]
    assert got == ["beginner", "intermediate", "intermediate", "advanced", "advanced", "expert"]


def test_type_titles_and_skilled(spark):
    rows = [{"genre": "x", "duration": 600, "game_type": "coop"}]
    assert _titles(spark, "c", rows) == [SKILLED_TITLE, TYPE_TITLES["coop"]]


def test_collector_goldens(spark):
    docs = spark.createDataFrame([(1, '{"player_id": "test123"}'), (2, None)], "doc_seq long, raw string")
    ok = collect_valid(docs).collect()
    assert [(r["player_id"], r["data_quality"], r["timestamp"]) for r in ok] == [
        ("test123", "high", "2025-01-01 12:00:00")]
    rej = collect_rejected(docs).collect()
    assert [(r["doc_seq"], r["reason"]) for r in rej] == [(2, "missing")]


def test_rejection_reasons(spark):
    cases = {
        '{"player_id": null}': None, '{}': "missing", '{"x": 1}': "missing", '[]': "missing",
        '["player_id"]': "error", '"player_id"': "error", '"abc"': "missing", '""': "missing",
        '0': "missing", '7': "error", 'true': "error", 'false': "missing", 'null': "missing",
        '{"player_id": 1': "malformed",
    }
    df = spark.createDataFrame([(k,) for k in cases], T.StructType([T.StructField("raw", T.StringType())]))
    got = {r["raw"]: r["reason"] for r in df.select("raw", rejection_reason("raw").alias("reason")).collect()}
    assert got == cases


def test_upsert_last_write_wins(spark):
    from lodestar.operators.validate import upsert_players

    cur = spark.createDataFrame([("a", "old-a"), ("b", "old-b")], "player_id string, doc string")
    upd = spark.createDataFrame([("a", "new-a1", 1), ("a", "new-a2", 2), ("c", "new-c", 1)],
                                "player_id string, doc string, seq long")
    got = {r["player_id"]: r["doc"] for r in upsert_players(cur, upd).collect()}
    assert got == {"a": "new-a2", "b": "old-b", "c": "new-c"}


def test_titles_never_exceed_five(spark):
    rows = [{"genre": g, "duration": 400, "game_type": "multiplayer"} for g in ("action", "rpg", "strategy")]
    t = _titles(spark, "m", rows)
    assert t == [GENRE_TITLES["action"], GENRE_TITLES["rpg"], GENRE_TITLES["strategy"], SKILLED_TITLE,
                 TYPE_TITLES["multiplayer"]]
    assert len(t) <= 5 and F is not None


def test_player_stats_without_sessions_is_one_row(spark):
    from lodestar.operators.aggregates import player_stats_one

    s = spark.createDataFrame([(1, 5, "2024-01-01 00:00:00", "2024-01-01 01:00:00", 3600.0)],
                              "session_id long, player_id long, start_time string, end_time string, session_duration double")
    s = s.selectExpr("session_id", "player_id", "cast(start_time as timestamp_ntz) as start_time",
                     "cast(end_time as timestamp_ntz) as end_time", "session_duration")
    rows = player_stats_one(s, 99, "2024-01-10 00:00:00").collect()
    assert [(r["n_sessions"], r["avg_duration"]) for r in rows] == [(0, None)]
    rows = player_stats_one(s, 5, "2024-01-10 00:00:00").collect()
    assert [(r["n_sessions"], r["avg_duration"]) for r in rows] == [(1, 3600.0)]


def test_recent_recs_inclusive_from_midnight(spark):
    from lodestar.operators.filters import recent_recs

    r = spark.createDataFrame([(f"2024-01-{d:02d} 00:00:00",) for d in range(20, 31)] + [("2024-01-22 23:59:59",)],
                              "t string").selectExpr("cast(t as timestamp_ntz) as created_at")
    days = {row[0].day for row in recent_recs(r, "2024-01-30", 7).collect()}
    assert days == set(range(23, 31))  # 8 calendar dates, the 23rd from midnight


def test_add_players_skips_unhashable_ids(spark):
    from lodestar.operators.profile import add_players
    from lodestar.sources.tables import STORE_SCHEMA

    empty = spark.createDataFrame([], STORE_SCHEMA)
    docs = spark.createDataFrame([(1, '{"player_id": [1, 2]}'), (2, '{"player_id": {"a": 1}}'), (3, '{"player_id": 0}'),
                                  (4, '{"player_id": "p"}')], "doc_seq long, raw string")
    hist = spark.createDataFrame([], "player_id string, ord struct<o:int>, raw string")
    players, recs = add_players(empty.select("player_id", "doc"), empty.select("player_id", "recommendations"),
                                docs, apply_history_defaults(hist, raw_col="raw"))
    assert sorted(r["player_id"] for r in players.collect()) == ["0", "p"]
    got = {r["player_id"]: list(r["recommendations"]) for r in recs.collect()}
    assert got == {"0": FALLBACK_TITLES, "p": [NOVICE_TITLE]}
