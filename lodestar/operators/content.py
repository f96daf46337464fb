"""Content-based recommendation (M1-M4): TF-IDF item vectors over genres/tags,
weighted-mean player vectors, cosine top-N over unseen items, cold start.

Vectors are long DataFrames (id, term, idx, weight); ``idx`` is the term's
position in the vocabulary (df desc, term asc), so a dense form is
``to_dense``. The vocabulary is capped at ``vocab_size`` terms, which bounds
every per-id collection and the broadcast vocabulary.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.operators.filters import recently_played
from lodestar.operators.joins import maybe_broadcast
from lodestar.operators.sparse import packed, sparse_top_n

VOCAB_SIZE = 100


def tfidf(items: DataFrame, vocab_size: int = VOCAB_SIZE, item: str = "game_id",
          tags: str = "tags") -> tuple[DataFrame, DataFrame]:
    """M1: (item_vectors(item, term, idx, weight), vocab(term, idx, df, idf)).

    tf = occurrences of the term in the item's tags; df = items holding it;
    vocabulary = top ``vocab_size`` terms by (df desc, term asc);
    weight = tf * ln((N + 1) / (df + 1)), L2-normalised per item."""
    spark = items.sparkSession
    terms = items.select(item, F.explode(tags).alias("term")).where(F.col("term").isNotNull())
    tf = terms.groupBy(item, "term").agg(F.count(F.lit(1)).alias("tf"))
    n_items = items.select(item).distinct().count()
    # The vocabulary has at most vocab_size rows: a global top-k, collected once.
    top = (tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
           .orderBy(F.col("df").desc(), F.col("term").asc()).limit(vocab_size).collect())
    vocab = spark.createDataFrame(
        [(r["term"], i, int(r["df"])) for i, r in enumerate(top)], "term string, idx int, df long"
    ).withColumn("idf", F.log((F.lit(float(n_items)) + 1.0) / (F.col("df") + 1.0)))
    w = tf.join(F.broadcast(vocab), "term").withColumn("w", F.col("tf") * F.col("idf"))
    norm = w.groupBy(item).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("_n"))
    vecs = (w.join(norm, item).where(F.col("_n") > 0)
            .select(item, "term", "idx", (F.col("w") / F.col("_n")).alias("weight")))
    return vecs, vocab


def user_vectors(inter: DataFrame, item_vec: DataFrame, key: str = "player_id", item: str = "game_id",
                 weight: str = "weight") -> DataFrame:
    """M2: player vector = weighted mean of the vectors of the items the
    player likes (positive weight): sum_i w_i x_it / sum_i w_i.

    An item's vector meets a liked pair as one row. The rows go to their player
    before the entries are taken apart, so a task sums its own players' terms
    only, at most a vocabulary a player, and no sums are shuffled."""
    liked = inter.where(F.col(weight) > 0).select(key, item, F.col(weight).alias("_w"))
    met = liked.join(maybe_broadcast(packed(item_vec, item)), item).select(key, "_w", "idx", "w").repartition(key)
    num = (met.select(key, "_w", F.explode(F.arrays_zip("idx", "w")).alias("_x"))
           .groupBy(key, F.col("_x.idx").alias("idx")).agg(F.sum(F.col("_w") * F.col("_x.w")).alias("_s")))
    den = liked.groupBy(key).agg(F.sum("_w").alias("_tw"))
    names = item_vec.select(F.col("idx").cast("int").alias("idx"), "term").distinct()  # the vocabulary
    kind = item_vec.schema["idx"].dataType
    return num.join(den, key).join(F.broadcast(names), "idx").select(
        key, "term", F.col("idx").cast(kind).alias("idx"), (F.col("_s") / F.col("_tw")).alias("weight"))


def to_dense(vecs: DataFrame, key: str, dim: int) -> DataFrame:
    """(key, vec ARRAY<DOUBLE>[dim]) from a long (key, idx, weight) form; one
    collection per key of at most ``dim`` entries."""
    m = F.map_from_entries(F.collect_list(F.struct(F.col("idx").cast("int"), F.col("weight").cast("double"))))
    return vecs.groupBy(key).agg(m.alias("_m")).select(
        key, F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(F.col("_m")[i], F.lit(0.0)))
        .alias("vec"))


def dense_sides(user_vec: DataFrame, item_vec: DataFrame, dim: int | None = None) -> tuple[DataFrame, DataFrame, int]:
    """Player and item vectors in dense form, and their dimension (by default
    the vocabulary actually used)."""
    if dim is None:
        dim = int(item_vec.agg(F.max("idx").alias("m")).first()["m"] or 0) + 1
    return to_dense(user_vec, "player_id", dim), to_dense(item_vec, "game_id", dim), dim


def content_recommend(user_vec: DataFrame, item_vec: DataFrame, owned: DataFrame | None, n: int = 10,
                      dim: int | None = None, blocked: DataFrame | None = None, min_score: float | None = None,
                      games: DataFrame | None = None, per_genre: int | None = None, parts: bool = False) -> DataFrame:
    """M3: cosine(player, item) over items the player does not own, top
    ``n`` (score desc, item asc); only positive scores. Item vectors are
    L2-normalised by M1; they are searched by posting lists (``sparse``).

    Rules act on all candidates, before the list is cut: ``blocked`` games
    never compete, ``min_score`` is a floor, and with ``games`` (game_id,
    genre_id) a list holds at most ``per_genre`` games of a genre. With
    ``parts`` each row carries the shared terms and their parts of the score."""
    if dim is None:
        dim = int(item_vec.agg(F.max("idx").alias("m")).first()["m"] or 0) + 1
    users, items = packed(user_vec, "player_id"), packed(item_vec, "game_id")
    if blocked is not None:
        items = items.join(maybe_broadcast(blocked.select("game_id").distinct()), "game_id", "left_anti")
    if per_genre is not None:
        items = items.join(maybe_broadcast(games.select("game_id", "genre_id")), "game_id")
    own = owned.select("player_id", "game_id") if owned is not None else None
    return sparse_top_n(users, items, own, max(dim, 1), n, cosine=True, positive_only=True, min_score=min_score,
                        group="genre_id" if per_genre is not None else None, per_group=per_genre, parts=parts)


def popular_recommend(players: DataFrame, sessions: DataFrame, owned: DataFrame | None, n: int = 10) -> DataFrame:
    """The ``n`` unseen games with the most distinct players, for each player."""
    one = F.array(F.lit(0)).alias("idx")
    users = players.select("player_id", one, F.array(F.lit(1.0)).alias("w"))
    items = popular_vectors(sessions).select("game_id", one, F.col("vec").alias("w"))
    return sparse_top_n(users, items, owned, 1, n)


def popular_vectors(sessions: DataFrame) -> DataFrame:
    """(game_id, vec) with one dimension: the game's number of distinct players."""
    return sessions.groupBy("game_id").agg(F.array(F.count_distinct("player_id").cast("double")).alias("vec"))


def popular_items(sessions: DataFrame, n: int = 10) -> list[tuple[int, int]]:
    """Top ``n`` games by distinct players (ties: smaller id) - a global
    top-k of at most ``n`` rows."""
    rows = (sessions.groupBy("game_id").agg(F.count_distinct("player_id").alias("n_players"))
            .orderBy(F.col("n_players").desc(), F.col("game_id").asc()).limit(n).collect())
    return [(int(r["game_id"]), int(r["n_players"])) for r in rows]


def cold_start(players: DataFrame, sessions: DataFrame, item_vec: DataFrame, as_of: str, days: int = 14,
               n: int = 10, dim: int | None = None) -> DataFrame:
    """M4: profile from the last ``days`` only (F3 -> M2 -> M3, weight =
    sessions per game); players with nothing recent get the most popular
    games (by distinct players; score = their number). Neither list holds a
    game the player ever played. Output (player_id, game_id, score, rank,
    source)."""
    owned = sessions.select("player_id", "game_id").distinct()
    recent = recently_played(sessions, as_of, days)
    inter = recent.select("player_id", "game_id", F.col("n_sessions").cast("double").alias("weight"))
    warm = content_recommend(user_vectors(inter, item_vec), item_vec, owned, n, dim)
    cold = players.select("player_id").join(recent.select("player_id").distinct(), "player_id", "left_anti")
    popular = popular_recommend(cold, sessions, owned, n)
    return warm.withColumn("source", F.lit("content")).unionByName(popular.withColumn("source", F.lit("popular")))
