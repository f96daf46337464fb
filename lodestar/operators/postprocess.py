"""Post-processing of recommendations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.operators.joins import exclude_owned, maybe_broadcast
from lodestar.operators.ranking import top_n


def apply_business_rules(recs: DataFrame, owned: DataFrame | None = None, blocked: DataFrame | None = None,
                         min_score: float | None = None, n: int = 10) -> DataFrame:
    """Drop owned items (J4) and blocked items, apply a score floor and
    re-rank the rest (score desc, item asc)."""
    out = recs
    if owned is not None:
        out = exclude_owned(out, owned)
    if blocked is not None:
        out = out.join(maybe_broadcast(blocked.select("game_id").distinct()), "game_id", "left_anti")
    if min_score is not None:
        out = out.where(F.col("score") >= F.lit(min_score))
    return top_n(out.drop("rank"), n)


def diversify(recs: DataFrame, games: DataFrame, max_per_genre: int = 2, n: int = 10) -> DataFrame:
    """R2: at most ``max_per_genre`` items per (player, genre) by score, then
    the top ``n``. Deterministic; both steps are group-limited windows."""
    g = recs.drop("rank").join(maybe_broadcast(games.select("game_id", "genre_id")), "game_id")
    w = Window.partitionBy("player_id", "genre_id").orderBy(F.col("score").desc(), F.col("game_id").asc())
    capped = g.withColumn("_gr", F.row_number().over(w)).where(F.col("_gr") <= max_per_genre).drop("_gr")
    return top_n(capped, n)


def explain(recs: DataFrame, user_vec: DataFrame, item_vec: DataFrame, k: int = 3) -> DataFrame:
    """For each recommended (player, item), the ``k`` terms contributing
    most to the cosine score: contribution = u_t * x_t / (|u| |x|), with its
    share of the score. Work is bounded by recs x terms per item."""
    un = user_vec.groupBy("player_id").agg(F.sqrt(F.sum(F.col("weight") ** 2)).alias("_un"))
    xn = item_vec.groupBy("game_id").agg(F.sqrt(F.sum(F.col("weight") ** 2)).alias("_xn"))
    pairs = recs.select("player_id", "game_id")
    c = (
        pairs.join(item_vec.withColumnRenamed("weight", "_x"), "game_id")
        .join(user_vec.withColumnRenamed("weight", "_u"), ["player_id", "term"])
        .join(un, "player_id")
        .join(xn, "game_id")
        .withColumn("contribution", F.col("_u") * F.col("_x") / (F.col("_un") * F.col("_xn")))
    )
    tot = F.sum("contribution").over(Window.partitionBy("player_id", "game_id"))
    w = Window.partitionBy("player_id", "game_id").orderBy(F.col("contribution").desc(), F.col("term").asc())
    ranked = c.withColumn("share", F.col("contribution") / tot).withColumn("term_rank", F.row_number().over(w))
    return ranked.where(F.col("term_rank") <= k).select("player_id", "game_id", "term_rank", "term",
                                                        "contribution", "share")


def explain_parts(recs: DataFrame, vocab: DataFrame, k: int = 3) -> DataFrame:
    """R3 from lists that carry their parts of the score (``content_recommend``
    with ``parts``): as ``explain``, without joining vectors again. ``vocab`` (term,
    idx) has at most the vocabulary's size, which is a parameter of M1."""
    names = sorted((r["idx"], r["term"]) for r in vocab.select("idx", "term").collect())
    if not names:
        names = [(0, "")]
    held = F.create_map(*[F.lit(x) for pair in names for x in pair])
    pair = F.arrays_zip(F.transform("terms", lambda i: held[i]).alias("term"), F.col("shares").alias("part"))
    # largest part first, equal parts by term
    keyed = F.array_sort(F.transform(pair, lambda x: F.struct((-x["part"]).alias("o"), x["term"].alias("term"), x["part"].alias("part"))))
    total = F.aggregate("shares", F.lit(0.0), lambda a, x: a + x)
    rows = recs.select("player_id", "game_id", total.alias("total"), F.posexplode(F.slice(keyed, 1, k)).alias("place", "x"))
    return rows.select("player_id", "game_id", (F.col("place") + 1).alias("term_rank"), F.col("x.term").alias("term"),
                       F.col("x.part").alias("contribution"), (F.col("x.part") / F.col("total")).alias("share"))
