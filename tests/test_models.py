"""Model queries without an SQL oracle: shape and invariants."""

from pyspark.sql import functions as F

from tests.conftest import SF_SMALL

import __spark_entry__ as E
from lodestar.sources import fixtures as fx


def _check_topn(spark, df, n=10):
    inter = fx.interactions(spark, SF_SMALL).select("player_id", "game_id")
    assert df.groupBy("player_id").count().where(F.col("count") > n).count() == 0
    assert df.join(inter, ["player_id", "game_id"]).count() == 0  # no owned item
    assert df.select("player_id", "game_id").distinct().count() == df.count()


def test_als_recommendations(spark):
    df = E.queries()["als_recommendations"](spark, SF_SMALL)
    assert df.count() > 0
    _check_topn(spark, df)


def test_neural_rerank(spark):
    df = E.queries()["neural_rerank"](spark, SF_SMALL)
    assert df.count() > 0
    _check_topn(spark, df)
    assert df.where((F.col("score") < 0) | (F.col("score") > 1)).count() == 0


def test_model_comparison(spark):
    rows = E.queries()["model_comparison"](spark, SF_SMALL).collect()
    assert sorted(r["model"] for r in rows) == ["content", "graph", "popularity"]
    for r in rows:
        assert 0 <= r["precision_at_k"] <= 1 and 0 <= r["hit_rate"] <= 1 and 0 <= r["ndcg"] <= 1


def test_blocked_scoring_equals_single_block(spark):
    """Item blocks (used beyond the broadcast bound) give the same exact top-N."""
    from lodestar.operators import content as C
    from lodestar.operators.scoring import dense_top_n

    iv, _ = C.tfidf(fx.games(spark, SF_SMALL))
    inter = fx.interactions(spark, SF_SMALL)
    users = C.to_dense(C.user_vectors(inter, iv), "player_id", C.VOCAB_SIZE)
    items = C.to_dense(iv, "game_id", C.VOCAB_SIZE)
    owned = inter.select("player_id", "game_id")
    dense = dense_top_n(users, items, owned, n=5, cosine=True)
    sparse = dense_top_n(users, items, owned, n=5, cosine=True, max_bytes=40_000)
    a = sorted(tuple(r) for r in dense.select("player_id", "game_id", "rank").collect())
    b = sorted(tuple(r) for r in sparse.select("player_id", "game_id", "rank").collect())
    assert a == b and len(a) > 0


def test_als_with_ids_beyond_int_range(spark):
    """ALS ids are INT: large ids go through a dense index and come back."""
    from lodestar.operators import models as M

    inter = fx.interactions(spark, SF_SMALL)
    big = inter.withColumn("player_id", F.col("player_id") + F.lit(10**12))
    fm = M.als_fit(big, rank=4, max_iter=2)
    assert fm.user_map is not None
    users, _ = M.factors(fm)
    assert users.agg(F.min("player_id")).first()[0] >= 10**12
    recs = M.als_recommend(fm, big.select("player_id", "game_id"), n=5)
    assert recs.join(big.select("player_id", "game_id"), ["player_id", "game_id"]).count() == 0
    assert recs.count() > 0


def test_dense_top_n_ties_and_blocks(spark):
    """Equal scores rank by smaller game id; blocked and single-block paths agree with brute force."""
    from lodestar.operators.scoring import dense_top_n

    users = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0])], "player_id long, vec array<double>")
    item_rows = [(g, [float(g % 3), float((g * 7) % 4)]) for g in range(60)]
    items = spark.createDataFrame(item_rows, "game_id long, vec array<double>")
    owned = spark.createDataFrame([(1, 3), (3, 5)], "player_id long, game_id long")
    want = set()
    own = {(1, 3), (3, 5)}
    for p, u in [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0])]:
        sc = [(-(u[0] * v[0] + u[1] * v[1]), g) for g, v in item_rows if (p, g) not in own and u[0] * v[0] + u[1] * v[1] > 0]
        for r, (s, g) in enumerate(sorted(sc)[:7]):
            want.add((p, g, r + 1))
    for max_bytes in (10**6, 200):  # one block / many blocks
        got = {(r["player_id"], r["game_id"], r["rank"]) for r in
               dense_top_n(users, items, owned, n=7, max_bytes=max_bytes, dim=2).collect()}
        assert got == want
    none = dense_top_n(users, items, None, n=3, dim=2).where("player_id = 1").orderBy("rank").collect()
    assert [r["game_id"] for r in none] == [2, 5, 8]  # score 2.0 ties, smallest ids first


def test_scores_of_any_sign_and_group_limit(spark):
    """Non-positive scores are ranked unless asked not to; the group limit acts before the cut."""
    from lodestar.operators.scoring import dense_top_n

    users = spark.createDataFrame([(1, [1.0])], "player_id long, vec array<double>")
    items = spark.createDataFrame([(g, [float(10 - g)], "a" if g < 8 else "b") for g in range(20)],
                                  "game_id long, vec array<double>, genre string")
    for max_bytes in (10**6, 40):
        get = lambda **k: [(r["game_id"], r["rank"]) for r in dense_top_n(
            users, items, None, n=15, dim=1, max_bytes=max_bytes, **k).orderBy("rank").collect()]
        assert get() == [(g, g + 1) for g in range(15)]
        assert get(positive_only=True) == [(g, g + 1) for g in range(10)]
        assert get(group="genre", per_group=2) == [(0, 1), (1, 2), (8, 3), (9, 4)]


def _seventeen_digits(inter):
    """The same pairs with 17-digit players and spread-out games."""
    return inter.withColumn("player_id", F.lit(76561198000000000) + F.col("player_id") * 1013).withColumn(
        "game_id", F.lit(10**12) + F.col("game_id") * 99991)


def test_models_take_seventeen_digit_ids(spark):
    from lodestar.operators import models as M
    from lodestar.session import cut_lineage

    inter = cut_lineage(fx.interactions(spark, SF_SMALL))
    big = cut_lineage(_seventeen_digits(inter))
    neg = M.negative_samples(big, big.select("game_id").distinct())
    n_pos, n_neg = big.count(), neg.count()
    assert n_neg > 0.5 * n_pos  # draws hit existing games whatever their ids
    assert neg.join(big.select("player_id", "game_id"), ["player_id", "game_id"]).count() == 0
    fm = M.als_fit(big, rank=4, max_iter=2)
    users, items = M.factors(fm)
    assert users.join(big.select("player_id").distinct(), "player_id").count() == users.count() == big.select("player_id").distinct().count()
    mlp = M.neural_fit(big, users, items, hidden=(4,), max_iter=3, max_positives=500)
    cands = M.als_recommend(fm, big, n=5)
    assert M.neural_rerank(cands, mlp, users, items, n=3).groupBy("player_id").count().where("count > 3").count() == 0
    edges = big.select("player_id", "game_id")
    u0 = edges.select("player_id").distinct().withColumn("vec", M.hash_init("player_id", 2, 11))
    i0 = edges.select("game_id").distinct().withColumn("vec", M.hash_init("game_id", 2, 29))
    recs = M.graph_recommend(edges, u0, i0, layers=1, n=3)
    assert recs.count() == 3 * edges.select("player_id").distinct().count()


def test_same_lists_with_other_ids(spark):
    """Only the names of players and games differ, so do the lists (content-free graph layers)."""
    from lodestar.operators import models as M
    from lodestar.session import cut_lineage

    inter = cut_lineage(fx.interactions(spark, SF_SMALL).select("player_id", "game_id"))
    big = cut_lineage(_seventeen_digits(inter))

    def recs(edges, back):
        u0 = edges.select("player_id").distinct().withColumn("vec", M.hash_init(back("player_id"), 2, 11))
        i0 = edges.select("game_id").distinct().withColumn("vec", M.hash_init(back("game_id"), 2, 29))
        out = M.graph_recommend(edges, u0, i0, layers=2, n=5)
        return {(r["p"], r["g"], r["rank"]) for r in out.select(back("player_id").alias("p"), back("game_id").alias("g"), "rank").collect()}

    plain = recs(inter, lambda c: F.col(c))
    again = recs(big, lambda c: ((F.col(c) - F.lit(76561198000000000)) / 1013 if c == "player_id" else (F.col(c) - F.lit(10**12)) / 99991).cast("long"))
    assert plain == again


def test_dense_index_is_stable_and_gapless(spark):
    from lodestar.operators import models as M

    ids = spark.range(5000).select((F.col("id") * 7919 + 10**15).alias("game_id"))
    a = {r["game_id"]: r["idx"] for r in M.dense_index(ids, "game_id").collect()}
    b = {r["game_id"]: r["idx"] for r in M.dense_index(ids.repartition(13).unionByName(ids), "game_id").collect()}
    assert a == b and sorted(a.values()) == list(range(5000))


def test_scorer_never_collects_items(spark, monkeypatch):
    from pyspark.sql import DataFrame

    from lodestar.operators.scoring import dense_top_n

    def no(*_):
        raise AssertionError("rows were fetched to the driver")

    users = spark.createDataFrame([(1, [1.0])], "player_id long, vec array<double>")
    items = spark.createDataFrame([(g, [float(g)]) for g in range(50)], "game_id long, vec array<double>")
    monkeypatch.setattr(DataFrame, "toPandas", no)
    monkeypatch.setattr(DataFrame, "collect", no)
    out = dense_top_n(users, items, None, n=5, dim=1, max_bytes=80)
    monkeypatch.undo()
    assert [r["game_id"] for r in out.orderBy("rank").collect()] == [49, 48, 47, 46, 45]


def test_blend_with_a_list_scales_over_all_unseen(spark):
    """A list's first game keeps its dense part wherever that ranks it."""
    from lodestar.operators.scoring import dense_blend_top_n

    users = spark.createDataFrame([(1, [1.0])], "player_id long, vec array<double>")
    items = spark.createDataFrame([(g, [100.0 - g]) for g in range(50)], "game_id long, vec array<double>")
    owned = spark.createDataFrame([(1, 0)], "player_id long, game_id long")
    listed = spark.createDataFrame([(1, 31, 0.9), (1, 30, 0.5), (1, 2, 0.1), (1, 0, 1.0)], "player_id long, game_id long, score double")
    got = dense_blend_top_n({"d": {"users": users, "items": items, "weight": 1.0}}, owned, n=49,
                            lists={"l": {"scores": listed, "weight": 0.25}}, dense_weight=0.75).collect()
    want = {g: 0.75 * (49 - g) / 48 + 0.25 * {31: 1.0, 30: 0.5}.get(g, 0.0) for g in range(1, 50)}
    assert {r["game_id"] for r in got} == set(want)
    assert all(abs(r["score"] - want[r["game_id"]]) < 1e-6 for r in got)
    order = sorted(want, key=lambda g: (-round(want[g], 6), g))
    assert [r["game_id"] for r in sorted(got, key=lambda r: r["rank"])] == order
