"""Steps of the models that move less: vectors to blocks and players, nodes to edges."""

import random

from pyspark.sql import functions as F

from lodestar.operators import content as C
from lodestar.operators import models as M
from lodestar.operators.scoring import dense_top_n


def test_user_vectors_take_items_apart_at_the_player(spark):
    """An item's entries are spread out after the shuffle by player (F21); sums as by hand."""
    iv = spark.createDataFrame([(1, "a", 0, 0.6), (1, "b", 1, 0.8), (2, "b", 1, 1.0)], "game_id long, term string, idx int, weight double")
    inter = spark.createDataFrame([(7, 1, 1.0), (7, 2, 3.0), (7, 9, 4.0), (8, 9, 1.0), (8, 1, 0.0), (None, 1, 2.0)],
                                  "player_id long, game_id long, weight double")
    uv = C.user_vectors(inter, iv)
    got = {(r["player_id"], r["term"], r["idx"]): round(r["weight"], 9) for r in uv.collect()}
    assert got == {(7, "a", 0): 0.075, (7, "b", 1): 0.475}
    plan = uv._jdf.queryExecution().sparkPlan().toString()
    assert "Generate explode" in plan and plan.index("Generate explode") < plan.index("hashpartitioning(player_id")


def test_factors_travel_in_single_precision(spark):
    """lists from floats are those from doubles; ALS leaves one iteration's shuffles."""
    rng = random.Random(2)
    inter = spark.createDataFrame([(p, g, 1.0 + rng.randrange(9)) for p in range(30) for g in rng.sample(range(40), 8)],
                                  "player_id long, game_id long, weight double")
    fm = M.als_fit(inter, rank=4, max_iter=2)
    users, items = M.factors(fm, "array<float>")
    assert users.schema["vec"].dataType.simpleString() == "array<float>"
    want = dense_top_n(*M.factors(fm), inter, n=5)
    assert sorted(M.als_recommend(fm, inter, n=5).collect()) == sorted(want.collect())
    sent = dense_top_n(users, items, inter, n=5)._jdf.queryExecution().analyzed().toString()
    assert "cast(vec" not in sent


def test_hops_leave_the_edges_in_place(spark):
    """a hop moves the nodes to edges that lie and are sorted by either end."""
    edges = spark.range(4000).select((F.col("id") % 97).alias("player_id"), (F.col("id") * 7 % 311).alias("game_id"))
    graph = M.Graph(edges)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for key in ("player_id", "game_id"):
            nodes = spark.range(400).select(F.col("id").alias(key), F.array(F.lit(1.0)).alias("_v"))
            joined = graph.with_node(graph.by[key], nodes, key)
            plan = joined._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" in plan and plan.count("Exchange") == 1 and plan.count("Sort [") == 1, plan
            assert joined.count() == edges.distinct().count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
