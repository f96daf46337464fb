"""Registered queries: content model (M1-M4), post-processing (R1-R3),
metrics (EV1-EV4), factorisation, neural re-ranking, graph propagation and
the blend (M5-M8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar.operators import content as C
from lodestar.operators import models as M
from lodestar.operators.evaluate import REPLICATES, compare, compare_paired, evaluate, poisson_cuts
from lodestar.operators.joins import exclude_owned
from lodestar.operators.postprocess import apply_business_rules, explain_parts
from lodestar.operators.ranking import leave_last_out
from lodestar.operators.scoring import SCORE_DIGITS, dense_blend_top_n, dense_top_n, network_sides
from lodestar.plans.registry import query
from lodestar.session import cut_lineage
from lodestar.sources import fixtures as fx
from lodestar.sources.fixtures import AS_OF_RECENT, with_ctes

D = SCORE_DIGITS


# ------------------------------------------------------------ SQL fragments
def tfidf_ctes(v: int = C.VOCAB_SIZE, suffix: str = "") -> list[tuple[str, str]]:
    s = suffix
    return [
        (f"tf{s}", """SELECT game_id, term, COUNT(*) AS tf FROM (SELECT game_id, unnest(tags) AS term FROM games) t
            WHERE term IS NOT NULL GROUP BY game_id, term"""),
        (f"vocab{s}", f"""SELECT term, df, idx FROM (SELECT term, COUNT(*) AS df,
            row_number() OVER (ORDER BY COUNT(*) DESC, term ASC) - 1 AS idx FROM tf{s} GROUP BY term) x
            WHERE idx < {v}"""),
        (f"raw{s}", f"""SELECT t.game_id, t.term, v.idx,
            t.tf * ln((n.n + 1.0) / (v.df + 1.0)) AS w
            FROM tf{s} t JOIN vocab{s} v ON t.term = v.term, (SELECT COUNT(DISTINCT game_id) AS n FROM games) n"""),
        (f"iv{s}", f"""SELECT game_id, term, idx, w / nrm AS weight FROM (
            SELECT *, sqrt(SUM(w * w) OVER (PARTITION BY game_id)) AS nrm FROM raw{s}) x WHERE nrm > 0"""),
    ]


def user_vec_ctes(inter: str, iv: str = "iv", name: str = "uv") -> list[tuple[str, str]]:
    return [
        (f"{name}_num", f"""SELECT i.player_id, v.term, v.idx, SUM(i.weight * v.weight) AS s
            FROM {inter} i JOIN {iv} v ON i.game_id = v.game_id WHERE i.weight > 0 GROUP BY 1, 2, 3"""),
        (f"{name}_den", f"SELECT player_id, SUM(weight) AS tw FROM {inter} WHERE weight > 0 GROUP BY 1"),
        (name, f"""SELECT n.player_id, n.term, n.idx, n.s / d.tw AS weight
            FROM {name}_num n JOIN {name}_den d ON n.player_id = d.player_id"""),
    ]


def content_rec_ctes(uv: str, iv: str, owned: str, n: int | None, name: str) -> list[tuple[str, str]]:
    """Ranked unseen games by cosine; all of them without ``n``."""
    return [
        (f"{name}_un", f"SELECT player_id, sqrt(SUM(weight * weight)) AS nrm FROM {uv} GROUP BY 1"),
        (f"{name}_sc", f"""SELECT u.player_id, v.game_id, ROUND(SUM(u.weight * v.weight) / MAX(un.nrm), {D}) AS score
            FROM {uv} u JOIN {iv} v ON u.idx = v.idx JOIN {name}_un un ON u.player_id = un.player_id
            GROUP BY u.player_id, v.game_id"""),
        (name, f"""SELECT player_id, game_id, score, rank FROM (
            SELECT *, row_number() OVER (PARTITION BY player_id ORDER BY score DESC, game_id ASC) AS rank
            FROM {name}_sc s WHERE score > 0 AND NOT EXISTS (
              SELECT 1 FROM {owned} o WHERE o.player_id = s.player_id AND o.game_id = s.game_id)) x"""
         + (f" WHERE rank <= {n}" if n else "")),
    ]


def _inter(spark, d):
    """The interactions, built once: vectors, owned mask and split read the cut."""
    return cut_lineage(fx.interactions(spark, d))


def _r(c, digits=D):
    return F.round(c, digits).alias(c)


def _content(spark, d, n=10, **rules):
    games = fx.games(spark, d)
    inter = _inter(spark, d)
    iv, vocab = C.tfidf(games)
    uv = C.user_vectors(inter, iv)
    return C.content_recommend(uv, iv, inter, n, dim=vocab.count(), **rules), vocab


# ------------------------------------------------------------- M1 - M4
@query("tfidf_vectors", oracle=with_ctes("games", extra=tfidf_ctes()) + f"""
SELECT game_id, term, idx, ROUND(weight, {D}) AS weight FROM iv""")
def q_tfidf(spark, d):
    iv, _ = C.tfidf(fx.games(spark, d))
    return iv.select("game_id", "term", F.col("idx").cast("long").alias("idx"), _r("weight"))


@query("tfidf_vocab20", oracle=with_ctes("games", extra=tfidf_ctes(20)) + """
SELECT term, idx, df FROM vocab""")
def q_vocab20(spark, d):
    _, vocab = C.tfidf(fx.games(spark, d), vocab_size=20)
    return vocab.select("term", F.col("idx").cast("long").alias("idx"), "df")


@query("tfidf_vectors_vocab20", oracle=with_ctes("games", extra=tfidf_ctes(20)) + f"""
SELECT game_id, term, ROUND(weight, {D}) AS weight FROM iv""")
def q_tfidf20(spark, d):
    iv, _ = C.tfidf(fx.games(spark, d), vocab_size=20)
    return iv.select("game_id", "term", _r("weight"))


@query("user_vectors", oracle=with_ctes("inter", extra=tfidf_ctes() + user_vec_ctes("inter")) + f"""
SELECT player_id, term, ROUND(weight, {D}) AS weight FROM uv""")
def q_user_vectors(spark, d):
    iv, _ = C.tfidf(fx.games(spark, d))
    uv = C.user_vectors(fx.interactions(spark, d), iv)
    return uv.select("player_id", "term", _r("weight"))


_CONTENT10 = with_ctes("inter", extra=tfidf_ctes() + user_vec_ctes("inter")
                       + content_rec_ctes("uv", "iv", "inter", 10, "crec"))


@query("content_recommendations", oracle=_CONTENT10 + "SELECT player_id, game_id, score, rank FROM crec")
def q_content(spark, d):
    recs, _ = _content(spark, d)
    return recs.withColumn("rank", F.col("rank").cast("long"))


_COLD_EXTRA = [
    ("recent", f"""SELECT player_id, game_id, CAST(COUNT(*) AS DOUBLE) AS weight FROM sessions
        WHERE start_time > TIMESTAMP '{AS_OF_RECENT}' - INTERVAL 14 DAY GROUP BY player_id, game_id"""),
    *user_vec_ctes("recent", name="ruv"),
    ("played", "SELECT DISTINCT player_id, game_id FROM sessions"),
    *content_rec_ctes("ruv", "iv", "played", 10, "warm"),
    ("pop", "SELECT game_id, COUNT(DISTINCT player_id) AS n_players FROM sessions GROUP BY game_id"),
    ("cold", "SELECT player_id FROM players WHERE player_id NOT IN (SELECT player_id FROM recent)"),
    ("popular", """SELECT player_id, game_id, score, rank FROM (SELECT c.player_id, p.game_id,
        CAST(p.n_players AS DOUBLE) AS score, row_number() OVER (PARTITION BY c.player_id
          ORDER BY p.n_players DESC, p.game_id ASC) AS rank FROM cold c, pop p WHERE NOT EXISTS (
          SELECT 1 FROM played o WHERE o.player_id = c.player_id AND o.game_id = p.game_id)) x WHERE rank <= 10"""),
]


@query("cold_start_recommendations", oracle=with_ctes("players", "sessions", "games", extra=tfidf_ctes() + _COLD_EXTRA)
       + """SELECT player_id, game_id, score, rank, 'content' AS source FROM warm
UNION ALL SELECT player_id, game_id, score, rank, 'popular' AS source FROM popular""")
def q_cold_start(spark, d):
    iv, _ = C.tfidf(fx.games(spark, d))
    out = C.cold_start(fx.players(spark, d), fx.game_sessions(spark, d), iv, AS_OF_RECENT, 14, 10)
    return out.withColumn("rank", F.col("rank").cast("long"))


# --------------------------------------------------------------- R1 - R3
_CONTENT_ALL = with_ctes("inter", extra=tfidf_ctes() + user_vec_ctes("inter")
                         + content_rec_ctes("uv", "iv", "inter", None, "crec"))


@query("business_rules", oracle=_CONTENT_ALL + """
SELECT player_id, game_id, score, rank FROM (
  SELECT player_id, game_id, score, row_number() OVER (PARTITION BY player_id ORDER BY score DESC, game_id ASC) AS rank
  FROM crec c WHERE score >= 0.6 AND c.game_id NOT IN (SELECT game_id FROM games WHERE game_type = 'arcade')) x
WHERE rank <= 10""")
def q_business_rules(spark, d):
    """R1 inside the candidate generation: all unseen, allowed games compete."""
    blocked = fx.games(spark, d).where(F.col("game_type") == "arcade").select("game_id")
    out, _ = _content(spark, d, blocked=blocked, min_score=0.6)
    return out.select("player_id", "game_id", "score", F.col("rank").cast("long"))


@query("owned_excluded", oracle=with_ctes("inter") + """,
pop AS (SELECT game_id, n, row_number() OVER (ORDER BY n DESC, game_id ASC) AS place FROM (
  SELECT game_id, COUNT(DISTINCT player_id) AS n FROM inter GROUP BY game_id) x),
lists AS (SELECT p.player_id, pop.game_id, CAST(pop.n AS DOUBLE) AS score
  FROM (SELECT DISTINCT player_id FROM inter) p, pop WHERE place <= 200)
SELECT player_id, game_id, score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY player_id ORDER BY score DESC, game_id ASC) AS rank FROM lists l
  WHERE NOT EXISTS (SELECT 1 FROM inter o WHERE o.player_id = l.player_id AND o.game_id = l.game_id)) x
WHERE rank <= 10""")
def q_owned_excluded(spark, d):
    """J4 and R1 on lists that hold owned games: the 200 most popular games
    (a top-k report) are offered to everyone, what a player owns is dropped."""
    inter = _inter(spark, d)
    offer = F.array(*[F.struct(F.lit(g).alias("game_id"), F.lit(float(n)).alias("score")) for g, n in C.popular_items(inter, 200)])
    lists = inter.select("player_id").distinct().select("player_id", F.explode(offer).alias("p")).select("player_id", "p.*")
    kept = exclude_owned(lists, inter)
    return apply_business_rules(kept.withColumn("rank", F.lit(0)), n=10).select(
        "player_id", F.col("game_id").cast("long"), "score", F.col("rank").cast("long"))


@query("diversified", oracle=_CONTENT_ALL + """
SELECT player_id, game_id, genre_id, score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY player_id ORDER BY score DESC, game_id ASC) AS rank FROM (
    SELECT c.player_id, c.game_id, g.genre_id, c.score, row_number() OVER (PARTITION BY c.player_id, g.genre_id
      ORDER BY c.score DESC, c.game_id ASC) AS gr FROM crec c JOIN games g ON c.game_id = g.game_id) x
  WHERE gr <= 2) y WHERE rank <= 10""")
def q_diversified(spark, d):
    """R2 inside the candidate generation: the genre limit acts on all unseen games."""
    games = fx.games(spark, d)
    recs, _ = _content(spark, d, games=games, per_genre=2)
    return recs.join(games.select("game_id", "genre_id"), "game_id").select(
        "player_id", "game_id", "genre_id", "score", F.col("rank").cast("long"))


@query("explanations", oracle=_CONTENT10 + f""",
un AS (SELECT player_id, sqrt(SUM(weight * weight)) AS nrm FROM uv GROUP BY 1),
xn AS (SELECT game_id, sqrt(SUM(weight * weight)) AS nrm FROM iv GROUP BY 1),
contrib AS (SELECT r.player_id, r.game_id, v.term, u.weight * v.weight / (un.nrm * xn.nrm) AS contribution
  FROM crec r JOIN iv v ON r.game_id = v.game_id JOIN uv u ON u.player_id = r.player_id AND u.term = v.term
  JOIN un ON un.player_id = r.player_id JOIN xn ON xn.game_id = r.game_id),
ranked AS (SELECT *, contribution / SUM(contribution) OVER (PARTITION BY player_id, game_id) AS share,
  row_number() OVER (PARTITION BY player_id, game_id ORDER BY contribution DESC, term ASC) AS term_rank FROM contrib)
SELECT player_id, game_id, term_rank, term, ROUND(contribution, {D}) AS contribution, ROUND(share, 6) AS share
FROM ranked WHERE term_rank <= 3""")
def q_explanations(spark, d):
    recs, vocab = _content(spark, d, 10, parts=True)
    out = explain_parts(recs, vocab, k=3)
    return out.select("player_id", "game_id", F.col("term_rank").cast("long"), "term", _r("contribution"),
                      F.round("share", 6).alias("share"))


# ------------------------------------------------------------ EV1 - EV4
_SPLIT = [
    ("ranked_inter", """SELECT *, row_number() OVER (PARTITION BY player_id ORDER BY last_played DESC, game_id DESC)
        AS rk FROM inter"""),
    ("train", "SELECT player_id, game_id, weight FROM ranked_inter WHERE rk > 2"),
    ("test", "SELECT player_id, game_id FROM ranked_inter WHERE rk <= 2"),
]


def _eval_sql(recs: str) -> str:
    return f""",
nt AS (SELECT player_id, COUNT(*) AS n_truth FROM test GROUP BY 1),
hits AS (SELECT r.player_id, COUNT(*) AS hits, SUM(1.0 / log2(r.rank + 1.0)) AS dcg
  FROM {recs} r JOIN test t ON r.player_id = t.player_id AND r.game_id = t.game_id WHERE r.rank <= 10 GROUP BY 1),
idcg AS (SELECT nt.player_id, SUM(1.0 / log2(g.i + 1.0)) AS idcg FROM nt, range(1, 11) g(i)
  WHERE g.i <= LEAST(10, nt.n_truth) GROUP BY 1),
pp AS (SELECT nt.player_id, COALESCE(h.hits, 0) AS hits, COALESCE(h.dcg, 0.0) AS dcg, i.idcg
  FROM nt LEFT JOIN hits h ON nt.player_id = h.player_id JOIN idcg i ON nt.player_id = i.player_id)
SELECT ROUND(AVG(hits / 10.0), 6) AS precision_at_k, ROUND(AVG(CASE WHEN hits > 0 THEN 1.0 ELSE 0.0 END), 6) AS hit_rate,
  ROUND(AVG(dcg / idcg), 6) AS ndcg, COUNT(*) AS n_players FROM pp"""


def _split(spark, d):
    return leave_last_out(_inter(spark, d), k=2)


def _content_model(spark, d, train, n=10):
    iv, vocab = C.tfidf(fx.games(spark, d))
    return C.content_recommend(C.user_vectors(train, iv), iv, train, n, dim=vocab.count())


def _popularity_model(spark, d, train, n=10):
    return C.popular_recommend(train.select("player_id").distinct(), train, train.select("player_id", "game_id"), n)


def _rounded_metrics(df):
    return df.select(*[F.round(c, 6).alias(c) for c in ("precision_at_k", "hit_rate", "ndcg")], "n_players")


@query("evaluation_content", oracle=with_ctes("games", "inter", extra=_SPLIT + tfidf_ctes()
                                              + user_vec_ctes("train") + content_rec_ctes("uv", "iv", "train", 10,
                                                                                          "crec"))
       + _eval_sql("crec"))
def q_eval_content(spark, d):
    train, test = _split(spark, d)
    return _rounded_metrics(evaluate(_content_model(spark, d, train), test, 10))


@query("evaluation_popularity", oracle=with_ctes("inter", extra=_SPLIT + [
    ("popc", "SELECT game_id, CAST(COUNT(DISTINCT player_id) AS DOUBLE) AS pop FROM train GROUP BY 1"),
    ("prec", """SELECT player_id, game_id, score, rank FROM (SELECT u.player_id, p.game_id, p.pop AS score,
        row_number() OVER (PARTITION BY u.player_id ORDER BY p.pop DESC, p.game_id ASC) AS rank
        FROM (SELECT DISTINCT player_id FROM train) u, popc p WHERE NOT EXISTS (
          SELECT 1 FROM train o WHERE o.player_id = u.player_id AND o.game_id = p.game_id)) x WHERE rank <= 10"""),
]) + _eval_sql("prec"))
def q_eval_popularity(spark, d):
    train, test = _split(spark, d)
    return _rounded_metrics(evaluate(_popularity_model(spark, d, train), test, 10))


# ----------------------------------------------------- M5 - M8 (models)
ALS_RANK, ALS_REG, ALS_ITER = 64, 0.1, 5
NEURAL_POOL = 30  # list that the network re-ranks


@query("als_recommendations")
def q_als(spark, d):
    inter = _inter(spark, d)
    model = M.als_fit(inter, rank=ALS_RANK, reg=ALS_REG, max_iter=ALS_ITER)
    return M.als_recommend(model, inter, n=10)


@query("neural_rerank")
def q_neural(spark, d):
    return _neural(_inter(spark, d))


GRAPH_DIM = 4


def _graph_sides(inter):
    edges = inter.select("player_id", "game_id")
    u0 = edges.select("player_id").distinct().withColumn("vec", M.hash_init("player_id", GRAPH_DIM, 11))
    i0 = edges.select("game_id").distinct().withColumn("vec", M.hash_init("game_id", GRAPH_DIM, 29))
    return edges, u0, i0


def _graph_init(spark, d):
    # the edge list feeds the degrees, both initial layers and the owned mask
    return _graph_sides(_inter(spark, d))


def _init_sql(col: str, salt: int) -> str:
    return (f"((({col} % 1000003) * 2654435761 + (j + 1) * 40503 + {salt}) % 1000003) / 1000003.0 - 0.5")


_GRAPH_CTES = [
    ("edges", "SELECT DISTINCT player_id, game_id FROM inter"),
    ("du", "SELECT player_id, COUNT(*) AS d FROM edges GROUP BY 1"),
    ("di", "SELECT game_id, COUNT(*) AS d FROM edges GROUP BY 1"),
    ("ew", """SELECT e.player_id, e.game_id, 1.0 / sqrt(du.d * di.d) AS w FROM edges e
        JOIN du ON e.player_id = du.player_id JOIN di ON e.game_id = di.game_id"""),
    ("u0", f"""SELECT player_id AS node, j AS dim, {_init_sql('player_id', 11)} AS v
        FROM (SELECT DISTINCT player_id FROM edges) p, range(0, {GRAPH_DIM}) r(j)"""),
    ("i0", f"""SELECT game_id AS node, j AS dim, {_init_sql('game_id', 29)} AS v
        FROM (SELECT DISTINCT game_id FROM edges) g, range(0, {GRAPH_DIM}) r(j)"""),
] + [
    item for l in range(1, 4) for item in (
        (f"u{l}", f"""SELECT ew.player_id AS node, s.dim, SUM(ew.w * s.v) AS v FROM ew JOIN i{l - 1} s
            ON ew.game_id = s.node GROUP BY 1, 2"""),
        (f"i{l}", f"""SELECT ew.game_id AS node, s.dim, SUM(ew.w * s.v) AS v FROM ew JOIN u{l - 1} s
            ON ew.player_id = s.node GROUP BY 1, 2"""),
    )
]


@query("graph_embeddings", oracle=with_ctes("inter", extra=_GRAPH_CTES) + " UNION ALL ".join(
    f"SELECT '{kind}' AS node_type, node AS node_id, CAST({l} AS BIGINT) AS layer, dim, ROUND(v, {D}) AS value "
    f"FROM {p}{l}"
    for kind, p in (("player", "u"), ("game", "i")) for l in range(4)))
def q_graph_embeddings(spark, d):
    edges, u0, i0 = _graph_init(spark, d)
    us, its = M.propagate(edges, u0, i0, layers=3)
    out = None
    for kind, key, layers in (("player", "player_id", us), ("game", "game_id", its)):
        for l, df in enumerate(layers):
            x = df.select(F.lit(kind).alias("node_type"), F.col(key).alias("node_id"), F.lit(l).alias("layer"),
                          F.posexplode("vec").alias("dim", "value"))
            out = x if out is None else out.unionByName(x)
    return out.select("node_type", "node_id", F.col("layer").cast("long"), F.col("dim").cast("long"),
                      F.round("value", D).alias("value"))


_GRAPH_SCORES = [
    ("uc", " UNION ALL ".join(f"SELECT node, dim + {4 * l} AS dim, v FROM u{l}" for l in range(4))),
    ("ic", " UNION ALL ".join(f"SELECT node, dim + {4 * l} AS dim, v FROM i{l}" for l in range(4))),
    ("gsc", f"""SELECT u.node AS player_id, i.node AS game_id, ROUND(SUM(u.v * i.v), {D}) AS score
        FROM uc u JOIN ic i ON u.dim = i.dim GROUP BY 1, 2"""),
    ("grec", """SELECT player_id, game_id, score, rank FROM (
        SELECT *, row_number() OVER (PARTITION BY player_id ORDER BY score DESC, game_id ASC) AS rank FROM gsc s
        WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.player_id = s.player_id AND e.game_id = s.game_id)) x"""),
]


@query("graph_recommendations", oracle=with_ctes("inter", extra=_GRAPH_CTES + _GRAPH_SCORES)
       + "SELECT player_id, game_id, score, rank FROM grec WHERE rank <= 10")
def q_graph_recs(spark, d):
    edges, u0, i0 = _graph_init(spark, d)
    return M.graph_recommend(edges, u0, i0, layers=3, n=10).withColumn("rank", F.col("rank").cast("long"))


@query("blended_recommendations", oracle=_CONTENT_ALL + """,
popc AS (SELECT game_id, CAST(COUNT(DISTINCT player_id) AS DOUBLE) AS pop FROM inter GROUP BY 1),
prec AS (SELECT u.player_id, p.game_id, p.pop AS score
    FROM (SELECT DISTINCT player_id FROM inter) u, popc p WHERE NOT EXISTS (
      SELECT 1 FROM inter o WHERE o.player_id = u.player_id AND o.game_id = p.game_id)),
parts AS (SELECT player_id, game_id, score, 'content' AS model, 0.7::DOUBLE AS mw FROM crec
  UNION ALL SELECT player_id, game_id, score, 'popularity' AS model, 0.3::DOUBLE AS mw FROM prec),
mm AS (SELECT player_id, model, MIN(score) AS lo, MAX(score) AS hi FROM parts GROUP BY 1, 2),
sc AS (SELECT p.player_id, p.game_id, p.model, p.mw * CASE WHEN mm.hi = mm.lo THEN 1.0::DOUBLE
    ELSE (p.score - mm.lo) / (mm.hi - mm.lo) END AS s
  FROM parts p JOIN mm ON p.player_id = mm.player_id AND p.model = mm.model),
bl AS (SELECT player_id, game_id, ROUND(COALESCE(SUM(s) FILTER (model = 'content'), 0)
    + COALESCE(SUM(s) FILTER (model = 'popularity'), 0), 9) AS score FROM sc GROUP BY 1, 2)
SELECT player_id, game_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY player_id
  ORDER BY score DESC, game_id ASC) AS rank FROM bl) x WHERE rank <= 10""")
def q_blend(spark, d):
    """M8 over full score lists: every model scores every unseen game."""
    inter = _inter(spark, d)
    iv, vocab = C.tfidf(fx.games(spark, d))
    users, items, _ = C.dense_sides(C.user_vectors(inter, iv), iv, vocab.count())
    everyone = inter.select("player_id").distinct().withColumn("vec", F.array(F.lit(1.0)))
    models = {
        "content": {"users": users, "items": items, "weight": 0.7, "cosine": True, "positive_only": True},
        "popularity": {"users": everyone, "items": C.popular_vectors(inter), "weight": 0.3},
    }
    b = dense_blend_top_n(models, inter, n=10)
    return b.withColumn("rank", F.col("rank").cast("long"))


# ------------------------------------------- learned models: invariants (SQL)
# Factors and networks have no SQL form. What must hold of their lists has:
# per player the number of games, no owned game, gapless ranks.
def _lists_sql(owned: str) -> str:
    return f""",
cat AS (SELECT COUNT(DISTINCT game_id) AS n FROM {owned})
SELECT player_id, LEAST(10, MAX(cat.n) - COUNT(DISTINCT game_id)) AS n_games, 0::BIGINT AS n_owned, true AS ranks_ok
FROM {owned}, cat GROUP BY player_id"""


def _list_checks(recs, owned):
    """Per player of ``owned``: games listed, owned ones among them, ranks 1..n."""
    own = owned.select("player_id", "game_id").withColumn("_o", F.lit(1))
    per = recs.join(own, ["player_id", "game_id"], "left").groupBy("player_id").agg(
        F.count_distinct("game_id").alias("n"), F.count("_o").alias("o"),
        (F.sort_array(F.collect_list(F.col("rank").cast("int"))) == F.sequence(F.lit(1), F.count(F.lit(1)).cast("int"))).alias("r"))
    return owned.select("player_id").distinct().join(per, "player_id", "left").select(
        "player_id", F.coalesce("n", F.lit(0)).alias("n_games"), F.coalesce("o", F.lit(0)).alias("n_owned"),
        F.coalesce("r", F.lit(True)).alias("ranks_ok"))


@query("als_lists", oracle=with_ctes("inter") + _lists_sql("inter"))
def q_als_lists(spark, d):
    """M5: what must hold of the factor model's lists."""
    inter = _inter(spark, d)
    model = M.als_fit(inter, rank=16, reg=ALS_REG, max_iter=ALS_ITER)
    return _list_checks(M.als_recommend(model, inter, n=10), inter)


# Two dimensions, so that SQL can write the solution of the equations down.
_FOLD_SQL = f""",
iv2 AS (SELECT game_id, {_init_sql('game_id', 29).replace('(j + 1)', '1')} AS x, {_init_sql('game_id', 29).replace('(j + 1)', '2')} AS y
  FROM (SELECT DISTINCT game_id FROM inter) g),
s AS (SELECT i.player_id, SUM(x * x) + 0.1 AS a, SUM(x * y) AS b, SUM(y * y) + 0.1 AS c,
    SUM(ln(1 + i.weight) * x) AS p, SUM(ln(1 + i.weight) * y) AS q
  FROM inter i JOIN iv2 ON i.game_id = iv2.game_id GROUP BY 1)
SELECT player_id, ROUND((c * p - b * q) / (a * c - b * b), 6) AS u1, ROUND((a * q - b * p) / (a * c - b * b), 6) AS u2 FROM s"""


@query("fold_in_factors", oracle=with_ctes("inter") + _FOLD_SQL)
def q_fold_in_factors(spark, d):
    """M5: players folded into fixed game factors; exact in two dimensions."""
    inter = _inter(spark, d)
    items = inter.select("game_id").distinct().withColumn("vec", M.hash_init("game_id", 2, 29))
    return M.fold_in(inter, items, reg=ALS_REG, dim=2).select(
        "player_id", F.round(F.col("vec")[0], 6).alias("u1"), F.round(F.col("vec")[1], 6).alias("u2"))


@query("fold_in_lists", oracle=with_ctes("inter", extra=[("late", "SELECT * FROM inter WHERE player_id % 10 = 3")]) + """,
known AS (SELECT DISTINCT game_id FROM inter WHERE player_id % 10 <> 3),
cat AS (SELECT COUNT(*) AS n FROM known)
SELECT player_id, LEAST(10, MAX(cat.n) - COUNT(DISTINCT known.game_id)) AS n_games, 0::BIGINT AS n_owned, true AS ranks_ok
FROM late LEFT JOIN known ON late.game_id = known.game_id, cat GROUP BY player_id""")
def q_fold_in_lists(spark, d):
    """M5: lists for players that the fit has never seen (those with an id ending in
    3 join after it); the others are fitted."""
    inter = _inter(spark, d)
    late = F.col("player_id") % 10 == 3
    _, items = M.factors(M.als_fit(inter.where(~late), rank=16, reg=ALS_REG, max_iter=ALS_ITER))
    new = inter.where(late)
    items = cut_lineage(items)
    return _list_checks(dense_top_n(M.fold_in(new, items, reg=ALS_REG), items, new, n=10), new)


@query("als_fit_quality", oracle=with_ctes("inter") + """
SELECT COUNT(*) AS n_pairs, true AS better_than_mean FROM inter""")
def q_als_quality(spark, d):
    """M5: the factors explain the ratings better than their mean does."""
    inter = _inter(spark, d)
    users, items = M.factors(M.als_fit(inter, rank=16, reg=ALS_REG, max_iter=ALS_ITER), "array<float>")
    # a row a pair carries the player's vector to the game's: in single precision, multiplied in double
    dot = F.aggregate(F.zip_with("uv", "iv", lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)
    e = inter.select("player_id", "game_id", F.log1p("weight").alias("r")).join(
        users.withColumnRenamed("vec", "uv"), "player_id").join(items.withColumnRenamed("vec", "iv"), "game_id")
    return e.agg(F.count(F.lit(1)).alias("n_pairs"),
                 (F.avg(F.pow(F.col("r") - dot, 2)) < F.var_pop("r")).alias("better_than_mean"))


@query("neural_lists", oracle=with_ctes("inter") + _lists_sql("inter"))
def q_neural_lists(spark, d):
    """M6: what must hold of the re-ranked lists."""
    inter = _inter(spark, d)
    return _list_checks(_neural(inter, n=10), inter)


def _neural(inter, n=10, pool=NEURAL_POOL):
    """Factors, network and re-ranked lists. ``pool`` is the size of the list
    that is re-ranked (the stage's parameter: a network re-ranks candidates)."""
    model = M.als_fit(inter, rank=16, reg=ALS_REG, max_iter=5)
    users, items = (cut_lineage(x) for x in M.factors(model))
    cands = M.als_recommend(model, inter, n=pool)
    mlp = M.neural_fit(inter, users, items, hidden=(128, 64), max_iter=10)
    return M.neural_rerank(cands, mlp, users, items, n=n)


def hybrid(inter, games, n=10, max_iter=10, **kw):
    """M8 over the four models, each scoring every unseen game of every player."""
    iv, vocab = C.tfidf(games)
    cu, ci, _ = C.dense_sides(C.user_vectors(inter, iv), iv, vocab.count())
    au, ai = (cut_lineage(x) for x in M.factors(M.als_fit(inter, rank=16, reg=ALS_REG, max_iter=5)))
    edges, u0, i0 = _graph_sides(inter)
    us, its = M.propagate(edges, u0, i0, layers=3, dim=GRAPH_DIM)
    mlp = M.neural_fit(inter, au, ai, hidden=(128, 64), max_iter=max_iter)
    nu, ni, rest = network_sides(au, ai, M.network_layers(mlp))
    models = {
        "content": {"users": cu, "items": ci, "weight": 0.3, "cosine": True, "positive_only": True},
        "pmf_als": {"users": au, "items": ai, "weight": 0.3},
        "graph": {"users": M.concat_layers(us, "player_id"), "items": M.concat_layers(its, "game_id"), "weight": 0.15},
        "neural": {"users": nu, "items": ni, "rest": rest, "weight": 0.25},
    }
    return dense_blend_top_n(models, inter, n=n, **kw), models, (au, ai, mlp)


@query("hybrid_lists", oracle=with_ctes("inter") + _lists_sql("inter"))
def q_hybrid_lists(spark, d):
    """M8 over the four models: what must hold of the lists."""
    inter = _inter(spark, d)
    return _list_checks(hybrid(inter, fx.games(spark, d))[0], inter)


@query("neural_unpooled_lists", oracle=with_ctes("inter") + _lists_sql("inter"))
def q_neural_unpooled_lists(spark, d):
    """M6 over all unseen games: what must hold of the lists."""
    inter = _inter(spark, d)
    users, items = (cut_lineage(x) for x in M.factors(M.als_fit(inter, rank=16, reg=ALS_REG, max_iter=5)))
    mlp = M.neural_fit(inter, users, items, hidden=(128, 64), max_iter=10)
    return _list_checks(M.neural_recommend(mlp, users, items, inter), inter)


_COMPARED = ["content", "popularity", "graph"]


def _compare_sql() -> str:
    """One metrics row for each deterministic model."""
    rows = {"content": "crec", "popularity": "prec", "graph": "grec"}
    parts = [f"SELECT '{m}' AS model, x.* FROM (" + _eval_sql(rows[m]).replace(",\nnt AS", "WITH nt AS", 1) + ") x" for m in _COMPARED]
    return " UNION ALL ".join(parts)


_TRAIN_GRAPH = [(n, q.replace("FROM inter", "FROM train")) for n, q in _GRAPH_CTES + _GRAPH_SCORES]


_COMPARED_LISTS = with_ctes("games", "inter", extra=_SPLIT + tfidf_ctes() + user_vec_ctes("train")
       + content_rec_ctes("uv", "iv", "train", 10, "crec") + _TRAIN_GRAPH + [
    ("popc", "SELECT game_id, CAST(COUNT(DISTINCT player_id) AS DOUBLE) AS pop FROM train GROUP BY 1"),
    ("prec", """SELECT player_id, game_id, score, rank FROM (SELECT u.player_id, p.game_id, p.pop AS score,
        row_number() OVER (PARTITION BY u.player_id ORDER BY p.pop DESC, p.game_id ASC) AS rank
        FROM (SELECT DISTINCT player_id FROM train) u, popc p WHERE NOT EXISTS (
          SELECT 1 FROM train o WHERE o.player_id = u.player_id AND o.game_id = p.game_id)) x WHERE rank <= 10"""),
])


def _split_models(spark, d, learned: bool = False):
    """Models fitted on the split's train side, by name, and its test side."""
    train, test = _split(spark, d)
    train, test = cut_lineage(train), cut_lineage(test)
    edges, u0, i0 = _graph_sides(train)
    models = {"content": _content_model(spark, d, train)}
    if learned:
        users, items = (cut_lineage(x) for x in M.factors(M.als_fit(train, rank=16, reg=ALS_REG, max_iter=5)))
        mlp = M.neural_fit(train, users, items, hidden=(128, 64), max_iter=10)
        models["pmf_als"] = dense_top_n(users, items, train, n=10)
        models["neural"] = M.neural_recommend(mlp, users, items, train)
    else:
        models["popularity"] = _popularity_model(spark, d, train)
    models["graph"] = M.graph_recommend(edges, u0, i0, layers=3, n=10)
    return models, test


@query("model_comparison", oracle=_COMPARED_LISTS + _compare_sql())
def q_compare(spark, d):
    """EV4 over the models that SQL can compute as well."""
    models, test = _split_models(spark, d)
    out = compare(models, test, 10)
    return out.select("model", *[F.round(c, 6).alias(c) for c in ("precision_at_k", "hit_rate", "ndcg")], "n_players")


@query("learned_model_comparison", oracle=with_ctes("inter", extra=_SPLIT) + """
SELECT model, COUNT(DISTINCT player_id) AS n_players, true AS in_range
FROM test, (SELECT unnest(['pmf_als', 'neural']) AS model) m GROUP BY model""")
def q_compare_learned(spark, d):
    """EV4 over the learned models: the metrics are there and in range."""
    train, test = _split(spark, d)
    train, test = cut_lineage(train), cut_lineage(test)
    model = M.als_fit(train, rank=16, reg=ALS_REG, max_iter=5)
    models = {"pmf_als": M.als_recommend(model, train, n=10), "neural": _neural(train)}
    m = compare(models, test, 10)
    ok = [F.col(c).between(0.0, 1.0) for c in ("precision_at_k", "hit_rate", "ndcg")]
    return m.select("model", "n_players", (ok[0] & ok[1] & ok[2] & (F.col("hit_rate") >= F.col("precision_at_k"))).alias("in_range"))


def _paired_sql() -> str:
    """Weights, sums, means and ranks of the paired comparison, written out."""
    lists = " UNION ALL ".join(
        f"SELECT '{m}' AS model, {i} AS place, player_id, game_id, rank FROM {t} WHERE rank <= 10"
        for i, (m, t) in enumerate({"content": "crec", "popularity": "prec", "graph": "grec"}.items()))
    weight = " + ".join(f"CAST(u >= {c} AS INT)" for c in poisson_cuts())
    return f""",
lists AS ({lists}),
names AS (SELECT DISTINCT model, place FROM lists),
truth AS (SELECT DISTINCT player_id, game_id FROM test),
nt AS (SELECT player_id, COUNT(*) AS n_truth FROM truth GROUP BY 1),
ideal AS (SELECT nt.player_id, SUM(1.0 / log2(g.i + 1.0)) AS idcg FROM nt, range(1, 11) g(i) WHERE g.i <= LEAST(10, nt.n_truth) GROUP BY 1),
hits AS (SELECT l.player_id, l.model, COUNT(*) AS hits, SUM(1.0 / log2(l.rank + 1.0)) AS dcg
  FROM lists l JOIN truth t ON l.player_id = t.player_id AND l.game_id = t.game_id GROUP BY 1, 2),
per AS (SELECT i.player_id, m.model, m.place, CAST(ROUND(COALESCE(h.hits, 0) / 10.0 * 1e9) AS BIGINT) AS precision_at_k,
    CAST(CASE WHEN h.hits > 0 THEN 1000000000 ELSE 0 END AS BIGINT) AS hit_rate, CAST(ROUND(COALESCE(h.dcg, 0.0) / i.idcg * 1e9) AS BIGINT) AS ndcg
  FROM ideal i CROSS JOIN names m LEFT JOIN hits h ON h.player_id = i.player_id AND h.model = m.model),
drawn AS (SELECT player_id, r AS rep, CASE WHEN r = 0 THEN 1 ELSE {weight} END AS w
  FROM (SELECT player_id, r, CAST('0x' || substr(md5(player_id || ':' || r), 1, 8) AS BIGINT) AS u FROM ideal, range(0, {REPLICATES + 1}) g(r)) x),
means AS (SELECT d.rep, p.model, p.place, SUM(d.w) AS n, SUM(d.w * p.precision_at_k)::DOUBLE / SUM(d.w) / 1e9 AS precision_at_k,
    SUM(d.w * p.hit_rate)::DOUBLE / SUM(d.w) / 1e9 AS hit_rate, SUM(d.w * p.ndcg)::DOUBLE / SUM(d.w) / 1e9 AS ndcg
  FROM per p JOIN drawn d ON d.player_id = p.player_id GROUP BY 1, 2, 3 HAVING SUM(d.w) > 0),
long AS (UNPIVOT means ON precision_at_k, hit_rate, ndcg INTO NAME metric VALUE v),
pairs AS (SELECT a.rep, a.model AS model_a, b.model AS model_b, a.metric, a.n, a.v AS a, b.v AS b, ROUND(a.v - b.v, 9) AS d
  FROM long a JOIN long b ON a.rep = b.rep AND a.metric = b.metric AND a.place < b.place),
ds AS (SELECT model_a, model_b, metric, list_sort(list(d)) AS ds FROM pairs WHERE rep > 0 GROUP BY 1, 2, 3)
SELECT p.model_a, p.model_b, p.metric, CAST(p.n AS BIGINT) AS n_players, ROUND(p.a, 6) AS value_a, ROUND(p.b, 6) AS value_b,
  ROUND(p.d, 6) AS difference, ROUND(ds[GREATEST(1, CAST(ceil(len(ds) * 0.025) AS BIGINT))], 6) AS low,
  ROUND(ds[GREATEST(1, CAST(ceil(len(ds) * 0.975) AS BIGINT))], 6) AS high,
  ROUND(len(list_filter(ds, lambda x: x > 0)) / len(ds), 6) AS share_above
FROM pairs p JOIN ds ON p.model_a = ds.model_a AND p.model_b = ds.model_b AND p.metric = ds.metric WHERE p.rep = 0"""


def _rounded_pairs(df):
    return df.select("model_a", "model_b", "metric", "n_players",
                     *[F.round(c, 6).alias(c) for c in ("value_a", "value_b", "difference", "low", "high", "share_above")])


@query("paired_comparison", oracle=_COMPARED_LISTS + _paired_sql())
def q_paired(spark, d):
    """EV4: differences of metrics with intervals, for the models that SQL can compute as well."""
    models, test = _split_models(spark, d)
    return _rounded_pairs(compare_paired(models, test, 10))


@query("four_model_comparison")
def q_four_models(spark, d):
    """EV4: content, factors, network and graph, on one split, in one table of paired
    differences with intervals; each scores every unseen game."""
    models, test = _split_models(spark, d, learned=True)
    return _rounded_pairs(compare_paired(models, test, 10))
