"""Point-in-time lookup against a loop, with a hot key; fold-in by its equations."""

import random
from datetime import datetime, timedelta

import numpy as np
from pyspark.sql import functions as F

from lodestar.operators import models as M
from lodestar.operators.features import as_of_features

START = datetime(2024, 1, 1)


def test_as_of_equals_a_loop_and_spreads_a_hot_player(spark):
    rng = random.Random(3)
    moment = lambda: START + timedelta(hours=rng.randrange(24 * 120))
    events = [(i, rng.choice([7, 7, 7, *range(20)]), moment()) for i in range(900)]
    events += [(1000, None, START), (1001, 7, None), (1002, 7, None), (1003, 99, START)]
    versions = [(rng.choice([7, *range(15)]), moment(), rng.randrange(100)) for _ in range(150)]
    versions += [(5, START, None), (5, START, 3), (None, START, 1), (6, None, 1), (8, START + timedelta(days=1), None)]
    e = spark.createDataFrame(events, "id long, player_id long, ts timestamp_ntz").repartition(5)
    v = spark.createDataFrame(versions, "player_id long, as_of timestamp_ntz, level int")
    out = as_of_features(e, v)
    assert out.columns == ["id", "player_id", "ts", "as_of", "level"]
    got = {r["id"]: (r["as_of"], r["level"]) for r in out.collect()}
    want = {}
    for i, p, t in events:
        known = [(a, -1 if x is None else x) for k, a, x in versions if k == p and k is not None and a is not None and t is not None and a <= t]
        best = max(known, default=(None, -1))
        want[i] = (best[0], None if best[1] == -1 else best[1])
    assert got == want
    # the hot player's events are dealt over its time buckets
    per = e.where("player_id = 7").groupBy(F.window("ts", "7 days")).count().agg(F.max("count")).first()[0]
    assert per < 0.15 * e.where("player_id = 7").count()
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    assert as_of_features(e.limit(0), v).collect() == []
    assert as_of_features(e, v.limit(0)).where("level IS NOT NULL").count() == 0


def test_fold_in_solves_its_equations(spark):
    rng = np.random.default_rng(4)
    factors = rng.normal(0, 1, (60, 5))
    pairs = {(int(p), int(g)): float(w) for p, g, w in zip(rng.integers(0, 30, 700), rng.integers(0, 70, 700), rng.exponential(40, 700))}
    pairs |= {(100, g): 1.0 for g in range(60)}  # a player of every game
    pairs |= {(200, 65): 3.0}  # no game with factors
    inter = spark.createDataFrame([(p, g, w) for (p, g), w in pairs.items()], "player_id long, game_id long, weight double")
    items = spark.createDataFrame([(g, v.tolist()) for g, v in enumerate(factors)], "game_id long, vec array<double>")
    out = {r["player_id"]: np.array(r["vec"]) for r in M.fold_in(inter, items, reg=0.1).collect()}
    assert set(out) == {p for p, g in pairs if g < 60}
    for p, u in out.items():
        mine = [(g, w) for (q, g), w in pairs.items() if q == p and g < 60]
        left = sum((np.log1p(w) - factors[g] @ u) * factors[g] for g, w in mine) - 0.1 * u
        assert np.abs(left).max() < 1e-9
