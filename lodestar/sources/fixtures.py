"""Relations of the game domain derived from the driver's tables.

Each relation exists twice: as a Spark DataFrame builder and as a DuckDB
CTE body used by the independent SQL oracle. Both derive every row from the
given tables, so the work grows with them.

| relation          | from                                   |
| ----------------- | -------------------------------------- |
| players           | customer                               |
| games, details    | part                                   |
| player_actions    | events                                 |
| game_sessions     | events, sessionised per player (12 h)  |
| game_history      | orders ⋈ lineitem ⋈ games              |
| interactions      | game_history per (player, game)        |
| recommendation_log| events                                 |
| player_documents  | customer, rendered as raw JSON text    |
| history_documents | game_history, rendered as raw JSON     |
| aliases, id_requests | customer                            |
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions.scalar import seconds_between
from lodestar.operators.sessions import sessionize
from lodestar.sources.tables import read_table

# ---------------------------------------------------------------------------
# Fixed values of the fixture mapping.
# Genre of a part type (other types are lower-cased as they are), game type by
# p_size % 4, the action that plays the part of the kill, session gap, the
# share of sessions left open (session_id % 10 = 0) and the as-of instants.
# ---------------------------------------------------------------------------
GENRE_OF_TYPE = {"ECONOMY": "action", "PROMO": "rpg", "STANDARD": "strategy"}
GAME_TYPE_BY_SIZE_MOD4 = ["singleplayer", "multiplayer", "coop", "arcade"]
KILL_EVENT = "purchase"
SESSION_GAP = "12 hours"
OPEN_SESSION_EVERY = 10
AS_OF = "2024-02-15 00:00:00"
AS_OF_DATE = "2024-01-30"
AS_OF_RECENT = "2024-01-31 00:00:00"


def games(spark: SparkSession, d: str) -> DataFrame:
    p = read_table(spark, d, "part", ["p_partkey", "p_name", "p_brand", "p_type", "p_size"])
    gmap = F.create_map(*[F.lit(x) for kv in GENRE_OF_TYPE.items() for x in kv])
    types = F.array(*[F.lit(t) for t in GAME_TYPE_BY_SIZE_MOD4])
    return p.select(
        F.col("p_partkey").alias("game_id"),
        F.coalesce(F.element_at(gmap, F.col("p_type")), F.lower("p_type")).alias("genre_id"),
        F.element_at(types, (F.col("p_size") % 4 + 1).cast("int")).alias("game_type"),
        F.concat(F.split("p_name", " "), F.array(F.lower("p_type"), F.lower("p_brand"))).alias("tags"),
    )


def game_details(spark: SparkSession, d: str) -> DataFrame:
    p = read_table(spark, d, "part", ["p_partkey", "p_brand", "p_size", "p_retailprice"])
    return p.select(
        F.col("p_partkey").alias("game_id"),
        F.col("p_brand").alias("publisher"),
        F.col("p_size").alias("size"),
        F.col("p_retailprice").alias("price"),
    )


def players(spark: SparkSession, d: str) -> DataFrame:
    c = read_table(spark, d, "customer", ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"])
    return c.select(
        F.col("c_custkey").alias("player_id"),
        F.col("c_name").alias("name"),
        F.col("c_nationkey").alias("country"),
        F.col("c_mktsegment").alias("segment"),
    )


def player_actions(spark: SparkSession, d: str) -> DataFrame:
    e = read_table(spark, d, "events", ["event_id", "ts", "user_id", "event_type", "props"])
    return e.select(
        "event_id",
        F.col("user_id").alias("player_id"),
        F.col("event_type").alias("action_type"),
        "ts",
        F.get_json_object("props", "$.k").cast("long").alias("k"),
    )


def game_sessions(spark: SparkSession, d: str, gap: str = SESSION_GAP) -> DataFrame:
    """Sessions per player: new iff ts - previous ts > gap; the first event's
    k is the game; every tenth session (by id) is left open."""
    a = player_actions(spark, d)
    s = sessionize(
        a,
        "player_id",
        "ts",
        gap,
        aggs=[
            F.min("event_id").alias("session_id"),
            F.min_by("k", F.struct("ts", "event_id")).alias("game_id"),
            F.count(F.lit(1)).alias("n_events"),
        ],
    )
    is_open = F.col("session_id") % OPEN_SESSION_EVERY == 0
    end = F.when(~is_open, F.col("session_end"))
    return s.select(
        "session_id",
        "player_id",
        "game_id",
        F.col("session_start").alias("start_time"),
        end.alias("end_time"),
        seconds_between(F.col("session_start"), end).alias("session_duration"),
        "n_events",
    )


def game_history(spark: SparkSession, d: str) -> DataFrame:
    """Ordered play history: one row per line item; ``ord`` is the order of
    appearance (order date, order, line, game)."""
    o = read_table(spark, d, "orders", ["o_orderkey", "o_custkey", "o_orderdate"])
    li = read_table(spark, d, "lineitem", ["l_orderkey", "l_partkey", "l_linenumber", "l_quantity"])
    g = games(spark, d).select("game_id", "genre_id", "game_type")
    h = li.join(o, li.l_orderkey == o.o_orderkey).join(g, li.l_partkey == g.game_id)
    return h.select(
        F.col("o_custkey").alias("player_id"),
        "game_id",
        F.col("genre_id").alias("genre"),
        "game_type",
        F.col("l_quantity").alias("duration"),
        F.col("o_orderdate").alias("played_at"),
        F.struct(
            F.col("o_orderdate").alias("d"),
            F.col("l_orderkey").alias("o"),
            F.col("l_linenumber").alias("l"),
            F.col("l_partkey").alias("p"),
        ).alias("ord"),
    )


def interactions(spark: SparkSession, d: str) -> DataFrame:
    from lodestar.operators.aggregates import interaction_matrix

    return interaction_matrix(game_history(spark, d))


def recommendation_log(spark: SparkSession, d: str) -> DataFrame:
    e = read_table(spark, d, "events", ["ts", "event_type"])
    return e.select(
        F.col("ts").alias("created_at"),
        F.when(F.col("event_type") == "click", 1.0).otherwise(0.0).alias("click_rate"),
        F.when(F.col("event_type") == KILL_EVENT, 1.0).otherwise(0.0).alias("conversion_rate"),
    )


def _doc_text(variant: F.Column, id_: F.Column, name: F.Column, seg: F.Column) -> F.Column:
    """Raw player document text; the variant (id % 10) picks a quirk."""
    body = F.concat(F.lit(', "name": "'), name, F.lit('", "segment": "'), seg, F.lit('"}'))
    return (
        F.when(variant == 0, F.concat(F.lit('{"name": "'), name, F.lit('", "segment": "'), seg, F.lit('"}')))
        .when(variant == 1, F.concat(F.lit('{"player_id": null'), body))
        .when(variant == 2, F.concat(F.lit('{"player_id": '), id_, F.lit(', "name": "'), name, F.lit('"')))
        .when(variant == 3, F.concat(F.lit('["player_id", "'), name, F.lit('"]')))
        .when(variant == 4, F.lit("{}"))
        .when(variant == 5, id_.cast("string"))
        .when(variant == 6, F.concat(F.lit('{"player_id": "'), id_, F.lit('"'), body))
        .otherwise(F.concat(F.lit('{"player_id": '), id_, body))
    )


def player_documents(spark: SparkSession, d: str) -> DataFrame:
    """Raw JSON documents (doc_seq, raw): one per customer, with every kind
    of quirk the validators must handle."""
    c = read_table(spark, d, "customer", ["c_custkey", "c_name", "c_mktsegment"])
    return c.select(
        F.col("c_custkey").alias("doc_seq"),
        _doc_text(F.col("c_custkey") % 10, F.col("c_custkey"), F.col("c_name"), F.col("c_mktsegment")).alias("raw"),
    )


def player_updates(spark: SparkSession, d: str) -> DataFrame:
    """Update stream for the upsert: one document per order, newer orders
    (higher key) win."""
    o = read_table(spark, d, "orders", ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"])
    return o.select(
        F.col("o_custkey").cast("string").alias("player_id"),
        F.col("o_orderkey").alias("seq"),
        F.concat(
            F.lit('{"player_id": '), F.col("o_custkey"), F.lit(', "status": "'), F.col("o_orderstatus"),
            F.lit('", "priority": "'), F.col("o_orderpriority"), F.lit('"}'),
        ).alias("doc"),
    )


def history_documents(spark: SparkSession, d: str) -> DataFrame:
    """Game history as raw JSON rows (player_id, ord, raw) with missing keys
    and explicit nulls, chosen by l_orderkey % 97."""
    h = game_history(spark, d)
    v = F.col("ord.o") % 97
    g = F.concat(F.lit('"genre": "'), F.col("genre"), F.lit('"'))
    du = F.concat(F.lit('"duration": '), F.col("duration").cast("long").cast("string"))
    t = F.concat(F.lit('"game_type": "'), F.col("game_type"), F.lit('"'))
    raw = (
        F.when(v == 0, F.concat(F.lit("{"), du, F.lit(", "), t, F.lit("}")))
        .when(v == 1, F.concat(F.lit('{"genre": null, '), du, F.lit(", "), t, F.lit("}")))
        .when(v == 2, F.concat(F.lit("{"), g, F.lit(", "), t, F.lit("}")))
        .when(v == 3, F.concat(F.lit("{"), g, F.lit(', "duration": null, '), t, F.lit("}")))
        .when(v == 4, F.concat(F.lit("{"), g, F.lit(", "), du, F.lit("}")))
        .when(v == 5, F.concat(F.lit("{"), g, F.lit(", "), du, F.lit(', "game_type": null}')))
        .otherwise(F.concat(F.lit("{"), g, F.lit(", "), du, F.lit(", "), t, F.lit("}")))
    )
    return h.select("player_id", "ord", raw.alias("raw"))


def aliases(spark: SparkSession, d: str) -> DataFrame:
    c = read_table(spark, d, "customer", ["c_custkey", "c_name"])
    return c.select(F.lower("c_name").alias("alias"), F.col("c_custkey").alias("player_id"))


def id_requests(spark: SparkSession, d: str) -> DataFrame:
    """Identifier requests: 17-digit ids, names in mixed case and unknown names."""
    c = read_table(spark, d, "customer", ["c_custkey", "c_name"])
    v = F.col("c_custkey") % 3
    text = (
        F.when(v == 0, (F.lit(10**16) + F.col("c_custkey")).cast("string"))
        .when(v == 1, F.concat(F.lit("  "), F.upper("c_name"), F.lit(" ")))
        .otherwise(F.concat(F.col("c_name"), F.lit("-x")))
    )
    return c.select(F.col("c_custkey").alias("request_id"), text.alias("requested"))


# ---------------------------------------------------------------------------
# The same relations as DuckDB CTEs for the oracle.
# ---------------------------------------------------------------------------
ORACLE_CTES: dict[str, str] = {
    "games": """SELECT p_partkey AS game_id,
        CASE p_type WHEN 'ECONOMY' THEN 'action' WHEN 'PROMO' THEN 'rpg'
             WHEN 'STANDARD' THEN 'strategy' ELSE lower(p_type) END AS genre_id,
        CASE p_size % 4 WHEN 0 THEN 'singleplayer' WHEN 1 THEN 'multiplayer'
             WHEN 2 THEN 'coop' ELSE 'arcade' END AS game_type,
        list_concat(string_split(p_name, ' '), [lower(p_type), lower(p_brand)]) AS tags
      FROM part""",
    "details": """SELECT p_partkey AS game_id, p_brand AS publisher, p_size AS size,
        p_retailprice AS price FROM part""",
    "players": """SELECT c_custkey AS player_id, c_name AS name, c_nationkey AS country,
        c_mktsegment AS segment FROM customer""",
    "actions": """SELECT event_id, user_id AS player_id, event_type AS action_type, ts,
        CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events""",
    "sess_marks": """SELECT *, CASE WHEN lag(ts) OVER w IS NULL
          OR ts - lag(ts) OVER w > INTERVAL 12 HOUR THEN 1 ELSE 0 END AS is_start
      FROM actions WINDOW w AS (PARTITION BY player_id ORDER BY ts, event_id)""",
    "sess_num": """SELECT *, sum(is_start) OVER (PARTITION BY player_id ORDER BY ts, event_id
          ROWS UNBOUNDED PRECEDING) AS sess_no FROM sess_marks""",
    "sessions_all": """SELECT min(event_id) AS session_id, player_id,
        arg_min(k, ts) AS game_id, min(ts) AS start_time, max(ts) AS last_ts,
        count(*) AS n_events FROM sess_num GROUP BY player_id, sess_no""",
    "sessions": """SELECT session_id, player_id, game_id, start_time,
        CASE WHEN session_id % 10 = 0 THEN NULL ELSE last_ts END AS end_time,
        CASE WHEN session_id % 10 = 0 THEN NULL
             ELSE (epoch_us(last_ts) - epoch_us(start_time)) / 1e6 END AS session_duration,
        n_events FROM sessions_all""",
    "history": """SELECT o.o_custkey AS player_id, l.l_partkey AS game_id, g.genre_id AS genre,
        g.game_type, l.l_quantity AS duration, o.o_orderdate AS played_at,
        o.o_orderdate AS ord_d, l.l_orderkey AS ord_o, l.l_linenumber AS ord_l
      FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
      JOIN games g ON l.l_partkey = g.game_id""",
    "inter": """SELECT player_id, game_id, CAST(sum(duration) AS DOUBLE) AS weight,
        count(*) AS n_plays, max(played_at) AS last_played FROM history GROUP BY player_id, game_id""",
    "reclog": """SELECT ts AS created_at,
        CASE WHEN event_type = 'click' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS click_rate,
        CASE WHEN event_type = 'purchase' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS conversion_rate FROM events""",
}
CTE_DEPS = {
    "sess_marks": ["actions"],
    "sess_num": ["sess_marks"],
    "sessions_all": ["sess_num"],
    "sessions": ["sessions_all"],
    "history": ["games"],
    "inter": ["history"],
}


def with_ctes(*names: str, extra: list[tuple[str, str]] | None = None) -> str:
    """WITH clause holding the named fixture CTEs (dependencies first)."""
    order: list[str] = []

    def visit(n: str) -> None:
        for dep in CTE_DEPS.get(n, []):
            visit(dep)
        if n not in order:
            order.append(n)

    for n in names:
        visit(n)
    parts = [f"{n} AS ({ORACLE_CTES[n]})" for n in order]
    parts += [f"{n} AS ({body})" for n, body in (extra or [])]
    return "WITH " + ",\n".join(parts) + "\n" if parts else ""
