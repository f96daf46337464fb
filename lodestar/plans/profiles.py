"""Registered queries: validation (V*), profiles and titles (P*, W1-W3, S*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar.functions.scalar import (
    COLLECT_QUALITY,
    COLLECT_TIMESTAMP,
    FALLBACK_TITLES,
    GENRE_TITLES,
    NOVICE_TITLE,
    SKILLED_TITLE,
    TYPE_TITLES,
)
from lodestar.operators import validate as V
from lodestar.operators.profile import add_players, add_players_to_store, build_profiles, get_recommendations, recommend_titles, titles_long
from lodestar.plans.registry import query
from lodestar.sources import fixtures as fx
from lodestar.sources.fixtures import ORACLE_CTES, with_ctes
from lodestar.sources.tables import STORE_SCHEMA

# ------------------------------------------------------------ SQL fragments
DOCS_SQL = """SELECT c_custkey AS doc_seq, CASE c_custkey % 10
  WHEN 0 THEN '{"name": "' || c_name || '", "segment": "' || c_mktsegment || '"}'
  WHEN 1 THEN '{"player_id": null, "name": "' || c_name || '", "segment": "' || c_mktsegment || '"}'
  WHEN 2 THEN '{"player_id": ' || c_custkey || ', "name": "' || c_name || '"'
  WHEN 3 THEN '["player_id", "' || c_name || '"]'
  WHEN 4 THEN '{}'
  WHEN 5 THEN CAST(c_custkey AS VARCHAR)
  WHEN 6 THEN '{"player_id": "' || c_custkey || '", "name": "' || c_name || '", "segment": "' || c_mktsegment || '"}'
  ELSE '{"player_id": ' || c_custkey || ', "name": "' || c_name || '", "segment": "' || c_mktsegment || '"}'
  END AS raw FROM customer"""

HAS_KEY = "(json_valid(raw) AND json_type(raw) = 'OBJECT' AND list_contains(json_keys(raw), 'player_id'))"
ID_TRUTHY = """CASE json_type(raw, '$.player_id')
  WHEN 'NULL' THEN false WHEN 'VARCHAR' THEN json_extract_string(raw, '$.player_id') <> ''
  WHEN 'BOOLEAN' THEN json_extract_string(raw, '$.player_id') = 'true'
  WHEN 'ARRAY' THEN json_array_length(raw, '$.player_id') > 0
  WHEN 'OBJECT' THEN len(json_keys(raw, '$.player_id')) > 0
  ELSE CAST(json_extract_string(raw, '$.player_id') AS DOUBLE) <> 0 END"""

HISTDOCS_SQL = """SELECT player_id, ord_d, ord_o, ord_l, game_id, CASE ord_o % 97
  WHEN 0 THEN '{"duration": ' || CAST(CAST(duration AS BIGINT) AS VARCHAR) || ', "game_type": "' || game_type || '"}'
  WHEN 1 THEN '{"genre": null, "duration": ' || CAST(CAST(duration AS BIGINT) AS VARCHAR) || ', "game_type": "' || game_type || '"}'
  WHEN 2 THEN '{"genre": "' || genre || '", "game_type": "' || game_type || '"}'
  WHEN 3 THEN '{"genre": "' || genre || '", "duration": null, "game_type": "' || game_type || '"}'
  WHEN 4 THEN '{"genre": "' || genre || '", "duration": ' || CAST(CAST(duration AS BIGINT) AS VARCHAR) || '}'
  WHEN 5 THEN '{"genre": "' || genre || '", "duration": ' || CAST(CAST(duration AS BIGINT) AS VARCHAR) || ', "game_type": null}'
  ELSE '{"genre": "' || genre || '", "duration": ' || CAST(CAST(duration AS BIGINT) AS VARCHAR) || ', "game_type": "' || game_type || '"}'
  END AS raw FROM history"""

HISTDEF_SQL = """SELECT player_id, ord_d, ord_o, ord_l, game_id,
  CASE WHEN list_contains(json_keys(raw), 'genre') THEN json_extract_string(raw, '$.genre') ELSE 'unknown' END AS genre,
  CAST(CASE WHEN list_contains(json_keys(raw), 'duration') THEN json_extract_string(raw, '$.duration') ELSE '0' END
       AS DOUBLE) AS duration,
  CASE WHEN list_contains(json_keys(raw), 'game_type') THEN json_extract_string(raw, '$.game_type')
       ELSE 'singleplayer' END AS game_type,
  (list_contains(json_keys(raw), 'duration') AND json_extract_string(raw, '$.duration') IS NULL) AS poison
FROM histdocs"""

HIST_TAB_SQL = """SELECT player_id, ord_d, ord_o, ord_l, game_id, COALESCE(genre, 'unknown') AS genre,
  CAST(COALESCE(duration, 0) AS DOUBLE) AS duration, COALESCE(game_type, 'singleplayer') AS game_type,
  false AS poison FROM history"""


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


SKILL_CASE = "CASE WHEN {t} > 1000 THEN 'expert' WHEN {t} > 500 THEN 'advanced' WHEN {t} > 100 THEN 'intermediate' ELSE 'beginner' END"
GENRE_TITLE_CASE = "CASE {g} " + " ".join(f"WHEN {_q(k)} THEN {_q(v)}" for k, v in GENRE_TITLES.items()) + " END"
TYPE_TITLE_CASE = "CASE {p} " + " ".join(f"WHEN {_q(k)} THEN {_q(v)}" for k, v in TYPE_TITLES.items()) + " END"
SKILL_TITLE_CASE = f"CASE WHEN {{s}} IN ('advanced', 'expert') THEN {_q(SKILLED_TITLE)} ELSE {_q(NOVICE_TITLE)} END"
FALLBACK_VALUES = ", ".join(f"({i + 1}, {_q(t)})" for i, t in enumerate(FALLBACK_TITLES))


def profile_ctes(hist: str, people: str) -> list[tuple[str, str]]:
    """Oracle CTEs: tot, gcount, grank, prof, gtext over a defaulted history
    CTE and a CTE of truthy player ids."""
    t = "COALESCE(t.total, 0)"
    return [
        ("tot", f"""SELECT player_id, SUM(duration) AS total,
            COUNT(*) FILTER (WHERE game_type = 'singleplayer') AS ns,
            COUNT(*) FILTER (WHERE game_type = 'multiplayer') AS nm,
            COUNT(*) FILTER (WHERE game_type = 'coop') AS nc, bool_or(poison) AS poison
            FROM {hist} GROUP BY player_id"""),
        ("gcount", f"""SELECT player_id, genre, COUNT(*) AS n, MIN(row(ord_d, ord_o, ord_l, game_id)) AS fs
            FROM {hist} GROUP BY player_id, genre"""),
        ("grank", "SELECT *, row_number() OVER (PARTITION BY player_id ORDER BY n DESC, fs ASC) AS rk FROM gcount"),
        ("prof", f"""SELECT DISTINCT p.player_id, CAST({t} AS DOUBLE) AS total_play_time,
            {SKILL_CASE.format(t=t)} AS skill_level,
            CASE WHEN COALESCE(ns, 0) >= COALESCE(nm, 0) AND COALESCE(ns, 0) >= COALESCE(nc, 0) THEN 'singleplayer'
                 WHEN COALESCE(nm, 0) >= COALESCE(nc, 0) THEN 'multiplayer' ELSE 'coop' END AS preferred_game_types
            FROM {people} p LEFT JOIN tot t ON p.player_id = t.player_id
            WHERE NOT COALESCE(t.poison, false)"""),
        ("gtext", """SELECT player_id, string_agg(COALESCE(genre, 'null') || ':' || n, ',' ORDER BY rk) AS genres_text
            FROM grank WHERE rk <= 3 GROUP BY player_id"""),
        ("gt2", f"""SELECT player_id, title, row_number() OVER (PARTITION BY player_id ORDER BY rk) AS pos FROM (
            SELECT player_id, rk, {GENRE_TITLE_CASE.format(g="genre")} AS title FROM grank WHERE rk <= 3) x
            WHERE title IS NOT NULL"""),
        ("ntit", "SELECT player_id, COUNT(*) AS c FROM gt2 GROUP BY player_id"),
        ("ptitles", f"""SELECT p.player_id, g.pos, g.title FROM prof p JOIN gt2 g ON p.player_id = g.player_id
            UNION ALL SELECT p.player_id, COALESCE(n.c, 0) + 1, {SKILL_TITLE_CASE.format(s="p.skill_level")}
            FROM prof p LEFT JOIN ntit n ON p.player_id = n.player_id
            UNION ALL SELECT p.player_id, COALESCE(n.c, 0) + 2, {TYPE_TITLE_CASE.format(p="p.preferred_game_types")}
            FROM prof p LEFT JOIN ntit n ON p.player_id = n.player_id
            WHERE p.preferred_game_types IN ('multiplayer', 'coop')"""),
    ]


PROFILE_SELECT = """SELECT p.player_id, p.total_play_time, COALESCE(g.genres_text, '') AS genres_text,
  p.skill_level, p.preferred_game_types FROM prof p LEFT JOIN gtext g ON p.player_id = g.player_id"""


def titles_select(req: str) -> str:
    return f"""SELECT r.player_id, t.pos, t.title FROM {req} r JOIN ptitles t ON r.player_id = t.player_id
UNION ALL SELECT r.player_id, f.pos, f.title FROM {req} r, (VALUES {FALLBACK_VALUES}) f(pos, title)
WHERE NOT EXISTS (SELECT 1 FROM prof p WHERE p.player_id = r.player_id)"""


def _genres_text(df):
    txt = F.array_join(
        F.transform("favorite_genres", lambda g: F.concat(F.coalesce(g["genre"], F.lit("null")), F.lit(":"),
                                                          g["n"].cast("string"))), ",")
    return df.select("player_id", "total_play_time", txt.alias("genres_text"), "skill_level", "preferred_game_types")


def _long(recs):
    return titles_long(recs).select("player_id", F.col("pos").cast("long").alias("pos"), "title")


# --------------------------------------------------------------- validation
@query("valid_documents", oracle=with_ctes(extra=[("docs", DOCS_SQL)]) + f"""
SELECT doc_seq, json_extract_string(raw, '$.player_id') AS player_id,
  '{COLLECT_QUALITY}' AS data_quality, '{COLLECT_TIMESTAMP}' AS timestamp FROM docs WHERE {HAS_KEY}""")
def q_valid_documents(spark, d):
    return V.collect_valid(fx.player_documents(spark, d))


@query("rejected_documents", oracle=with_ctes(extra=[("docs", DOCS_SQL)]) + """
SELECT doc_seq, reason FROM (SELECT doc_seq, CASE
  WHEN raw IS NULL THEN 'missing'
  WHEN NOT json_valid(raw) THEN 'malformed'
  WHEN json_type(raw) = 'OBJECT' THEN CASE WHEN list_contains(json_keys(raw), 'player_id') THEN NULL ELSE 'missing' END
  WHEN json_type(raw) = 'ARRAY' THEN CASE WHEN list_contains(CAST(json_transform(raw, '["VARCHAR"]') AS VARCHAR[]),
       'player_id') THEN 'error' ELSE 'missing' END
  WHEN json_type(raw) = 'VARCHAR' THEN CASE WHEN contains(json_extract_string(raw, '$'), 'player_id')
       THEN 'error' ELSE 'missing' END
  WHEN json_type(raw) = 'BOOLEAN' THEN CASE WHEN raw = 'true' THEN 'error' ELSE 'missing' END
  WHEN json_type(raw) = 'NULL' THEN 'missing'
  ELSE CASE WHEN CAST(raw AS DOUBLE) = 0 THEN 'missing' ELSE 'error' END END AS reason FROM docs) x
WHERE reason IS NOT NULL""")
def q_rejected_documents(spark, d):
    return V.collect_rejected(fx.player_documents(spark, d)).select("doc_seq", "reason")


@query("truthy_documents", oracle=with_ctes(extra=[("docs", DOCS_SQL)]) + f"""
SELECT doc_seq, json_extract_string(raw, '$.player_id') AS player_id FROM docs WHERE {HAS_KEY} AND {ID_TRUTHY}""")
def q_truthy_documents(spark, d):
    admitted = V.admit(fx.player_documents(spark, d))
    return V.require_truthy_id(admitted, raw_col="raw").select("doc_seq", "player_id")


@query("history_defaults", oracle=with_ctes("history", extra=[("histdocs", HISTDOCS_SQL), ("hd", HISTDEF_SQL)]) + """
SELECT player_id, ord_o AS order_key, ord_l AS line, game_id, genre, duration, game_type, poison FROM hd""")
def q_history_defaults(spark, d):
    h = V.apply_history_defaults(fx.history_documents(spark, d), raw_col="raw")
    return h.select("player_id", F.col("ord.o").alias("order_key"), F.col("ord.l").alias("line"),
                    F.col("ord.p").alias("game_id"), "genre", "duration", "game_type", "poison")


_CLEAN_ORDER = ["l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
                "l_returnflag", "l_linestatus"]


@query("clean_lineitem", ts=('l_shipdate',), oracle="""
SELECT * EXCLUDE (rn) FROM (SELECT l_orderkey, l_linenumber, l_shipdate, l_partkey, l_suppkey, l_quantity,
  l_extendedprice, l_discount, l_tax, NULLIF(trim(l_returnflag), '') AS l_returnflag,
  NULLIF(trim(l_linestatus), '') AS l_linestatus,
  row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY """ + ", ".join(
    f"{c} DESC NULLS LAST" for c in _CLEAN_ORDER) + """) AS rn
  FROM lineitem WHERE l_orderkey IS NOT NULL AND l_linenumber IS NOT NULL) x WHERE rn = 1""")
def q_clean_lineitem(spark, d):
    from lodestar.sources.tables import read_table

    li = read_table(spark, d, "lineitem")
    return V.clean(li, ["l_orderkey", "l_linenumber"], order_by=["l_shipdate"])


@query("resolved_ids", oracle="""
WITH req AS (SELECT c_custkey AS request_id, CASE c_custkey % 3
    WHEN 0 THEN CAST(10000000000000000 + c_custkey AS VARCHAR)
    WHEN 1 THEN '  ' || upper(c_name) || ' ' ELSE c_name || '-x' END AS requested FROM customer),
 amap AS (SELECT lower(c_name) AS alias, MIN(c_custkey) AS pid FROM customer GROUP BY lower(c_name))
SELECT r.request_id, r.requested,
  CAST(CASE WHEN regexp_full_match(r.requested, '[0-9]{17}') THEN CAST(r.requested AS BIGINT) ELSE a.pid END
       AS VARCHAR) AS player_id,
  CASE WHEN regexp_full_match(r.requested, '[0-9]{17}') THEN 'numeric_id' WHEN a.pid IS NOT NULL THEN 'alias'
       ELSE 'unresolved' END AS resolved_by
FROM req r LEFT JOIN amap a ON NOT regexp_full_match(r.requested, '[0-9]{17}') AND lower(trim(r.requested)) = a.alias""")
def q_resolved_ids(spark, d):
    out = V.resolve_ids(fx.id_requests(spark, d), fx.aliases(spark, d))
    # 17-digit ids exceed 2**53: render them as text so no client turns them into floats
    return out.withColumn("player_id", F.col("player_id").cast("string"))


@query("upserted_players", oracle="""
WITH cur AS (SELECT CAST(c_custkey AS VARCHAR) AS player_id,
    '{"player_id": ' || c_custkey || ', "name": "' || c_name || '"}' AS doc, 0 AS src, NULL::BIGINT AS seq FROM customer),
 upd AS (SELECT CAST(o_custkey AS VARCHAR) AS player_id, '{"player_id": ' || o_custkey || ', "status": "' ||
    o_orderstatus || '", "priority": "' || o_orderpriority || '"}' AS doc, 1 AS src, o_orderkey AS seq FROM orders),
 allr AS (SELECT * FROM cur UNION ALL SELECT * FROM upd)
SELECT player_id, doc FROM (SELECT player_id, doc, row_number() OVER (PARTITION BY player_id
  ORDER BY src DESC, COALESCE(seq, -9223372036854775808) DESC) AS rn FROM allr) x WHERE rn = 1""")
def q_upserted_players(spark, d):
    c = fx.players(spark, d)
    current = c.select(F.col("player_id").cast("string").alias("player_id"),
                       F.concat(F.lit('{"player_id": '), F.col("player_id"), F.lit(', "name": "'), F.col("name"),
                                F.lit('"}')).alias("doc"))
    return V.upsert_players(current, fx.player_updates(spark, d).select("player_id", "doc", "seq"))


# ----------------------------------------------------------------- profiles
_TRUTHY_PLAYERS = ("people", "SELECT player_id FROM players WHERE player_id IS NOT NULL AND player_id <> 0")


@query("profiles", oracle=with_ctes("players", "history", extra=[("ht", HIST_TAB_SQL), _TRUTHY_PLAYERS]
                                    + profile_ctes("ht", "people")) + PROFILE_SELECT)
def q_profiles(spark, d):
    h = V.apply_history_defaults(fx.game_history(spark, d))
    return _genres_text(build_profiles(fx.players(spark, d), h))


@query("profiles_from_documents", oracle=with_ctes(
    "players", "history", extra=[("histdocs", HISTDOCS_SQL), ("hd", HISTDEF_SQL), _TRUTHY_PLAYERS]
    + profile_ctes("hd", "people")) + PROFILE_SELECT)
def q_profiles_docs(spark, d):
    h = V.apply_history_defaults(fx.history_documents(spark, d), raw_col="raw")
    return _genres_text(build_profiles(fx.players(spark, d), h))


@query("titles", oracle=with_ctes("players", "history", extra=[("ht", HIST_TAB_SQL), _TRUTHY_PLAYERS]
                                  + profile_ctes("ht", "people")) + titles_select("players"))
def q_titles(spark, d):
    h = V.apply_history_defaults(fx.game_history(spark, d))
    p = fx.players(spark, d)
    return _long(recommend_titles(p, build_profiles(p, h)))


# Documents admitted, upserted into an empty store, profiled and titled.
_P3_EXTRA = [
    ("docs", DOCS_SQL),
    ("adm", f"SELECT doc_seq, raw, json_extract_string(raw, '$.player_id') AS player_id FROM docs WHERE {HAS_KEY}"),
    ("lastdoc", """SELECT player_id, raw FROM (SELECT *, row_number() OVER (PARTITION BY player_id
        ORDER BY doc_seq DESC) AS rn FROM adm) x WHERE rn = 1"""),
    ("people", f"SELECT player_id FROM lastdoc WHERE {ID_TRUTHY}"),
    ("hs", """SELECT CAST(player_id AS VARCHAR) AS player_id, ord_d, ord_o, ord_l, game_id,
        COALESCE(genre, 'unknown') AS genre, CAST(COALESCE(duration, 0) AS DOUBLE) AS duration,
        COALESCE(game_type, 'singleplayer') AS game_type, false AS poison FROM history"""),
    ("touched", "SELECT DISTINCT player_id FROM adm"),
]


def _p3(spark, d):
    empty = spark.createDataFrame([], STORE_SCHEMA)
    store_players = empty.select("player_id", "doc")
    store_recs = empty.select("player_id", "recommendations")
    return add_players(store_players, store_recs, fx.player_documents(spark, d),
                       V.apply_history_defaults(fx.game_history(spark, d)))


ADD_PLAYERS_SQL = with_ctes("history", extra=_P3_EXTRA + profile_ctes("hs", "people")) + titles_select("touched")


@query("add_players", oracle=ADD_PLAYERS_SQL)
def q_add_players(spark, d):
    _, recs = _p3(spark, d)
    return _long(recs)


_REQ = ("req", "SELECT CAST(c_custkey AS VARCHAR) AS player_id FROM customer")


@query("stored_recommendations", oracle=with_ctes(
    "history", extra=_P3_EXTRA + profile_ctes("hs", "people") + [("stored", titles_select("touched")), _REQ])
    + "SELECT r.player_id, s.pos, s.title FROM req r JOIN stored s ON r.player_id = s.player_id")
def q_stored_recs(spark, d):
    _, recs = _p3(spark, d)
    req = fx.players(spark, d).select(F.col("player_id").cast("string").alias("player_id"))
    found, _ = get_recommendations(recs, req)
    return _long(found)


@query("missing_recommendations", oracle=with_ctes(
    "history", extra=_P3_EXTRA + profile_ctes("hs", "people") + [("stored", titles_select("touched")), _REQ])
    + "SELECT r.player_id FROM req r WHERE NOT EXISTS (SELECT 1 FROM stored s WHERE s.player_id = r.player_id)")
def q_missing_recs(spark, d):
    _, recs = _p3(spark, d)
    req = fx.players(spark, d).select(F.col("player_id").cast("string").alias("player_id"))
    _, missing = get_recommendations(recs, req)
    return missing


__all__ = ["ORACLE_CTES", "profile_ctes", "titles_select"]


# P3 on a store that holds lists already: a second batch (every third document)
# over another history replaces what it touches, the NULL id included.
_P3_AGAIN = [(n, f"SELECT * FROM ({q}) AS _d WHERE doc_seq % 3 = 0" if n == "docs"
              else q + " WHERE genre <> 'action'" if n == "hs" else q) for n, q in _P3_EXTRA]
ADD_AGAIN_SQL = with_ctes("history", extra=_P3_AGAIN + profile_ctes("hs", "people")) + titles_select("touched")
_TOUCHED_AGAIN = with_ctes(extra=_P3_AGAIN[:2]) + "SELECT DISTINCT player_id FROM adm"


@query("add_players_again", oracle=f"""
SELECT a.* FROM ({ADD_PLAYERS_SQL}) a WHERE NOT EXISTS (
  SELECT 1 FROM ({_TOUCHED_AGAIN}) t WHERE t.player_id IS NOT DISTINCT FROM a.player_id)
UNION ALL SELECT b.* FROM ({ADD_AGAIN_SQL}) b""")
def q_add_players_again(spark, d):
    """P3 twice over one stored store (IO3, IO4): lists of players that the
    second batch does not name are kept, the others are replaced."""
    import uuid

    from lodestar.session import scratch_path
    from lodestar.sources.tables import read_store, write_store

    path = scratch_path(spark, f"io/store-{uuid.uuid4().hex}")
    write_store(*_p3(spark, d), path)
    docs = fx.player_documents(spark, d).where(F.col("doc_seq") % 3 == 0)
    history = V.apply_history_defaults(fx.game_history(spark, d)).where(F.col("genre") != "action")
    add_players_to_store(path, docs, history)
    _, recs = read_store(spark, path)
    return _long(recs)
