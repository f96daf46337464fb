"""op5: targets, the dual's optimum and the rounding against plain computations."""

import math
import random

import pytest
from pyspark.sql import functions as F
from tests.llm.helpers import DOCS

from lodestar.llm.common import materialise
from lodestar.llm.mixing import CAP, WEIGHTS, mix, solve_dual, targets


def water_level(sizes: dict, weights=WEIGHTS, cap=CAP):
    """Excess shared by weight, again and again, until none is above its stop."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        rest = total - sum(cap * sizes[s] for s in full)
        open_ = [s for s in names if s not in full]
        t = {s: rest * w[s] / sum(w[x] for x in open_) for s in open_} if open_ else {}
        over = {s for s in open_ if t[s] > cap * sizes[s]}
        if not over:
            return {**{s: cap * sizes[s] for s in full}, **t}
        full |= over


def table(spark, seed=1, n=600):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        source = rng.choice(["a"] * 6 + ["b", "c", "d", "é", None])
        words = rng.choice([0, 3, 10, 10, 50, rng.randrange(1, 300)])
        rows.append((i, " ".join(["w"] * words), "en", source, None))
    rows += [(n, None, None, "b", None), (n + 1, "w " * 9000, "en", "a", None), (5, rows[5][1], "en", rows[5][3], 1)]
    rows += [(None, "x y", "en", "c", 1), (n + 2, "tiny one", "en", "small", 1)]
    return rows


def test_mix_meets_targets(spark):
    rows = table(spark)
    docs = spark.createDataFrame(rows, DOCS).withColumn("size", F.lit("clash")).withColumn("copies", F.lit("clash")).withColumn("hash", F.lit(1))
    first = mix(docs.repartition(5)).collect()
    assert len(first) == len(rows)
    sizes, taken, target = {}, {}, {}
    for r in first:
        s = r["row"]["source"]
        assert r["size"] == len((r["row"]["text"] or "").split())
        assert r["taken"] == r["copies"] * r["size"] <= CAP * r["size"]
        sizes[s] = sizes.get(s, 0) + r["size"]
        taken[s] = taken.get(s, 0) + r["taken"]
        target[s] = r["target"]
        assert r["row"]["hash"] == 1 and r["row"]["copies"] == "clash"
    want = water_level(sizes)
    for s in sizes:
        assert target[s] == pytest.approx(want[s], rel=1e-9)
        assert abs(taken[s] - want[s]) <= max(3, 0.01 * want[s]), s
    assert {r["source_size"] for r in first} == set(sizes.values())
    again = mix(docs.repartition(2)).collect()
    key = lambda r: (repr(r["row"]), r["copies"])
    assert sorted(map(key, first)) == sorted(map(key, again))


def test_dual_is_the_entropy_optimum(spark):
    """At the multiplier the capped tilt meets the target of every source."""
    rng = random.Random(3)
    hist = [("p", s, rng.randrange(1, 5)) for s in range(1, 200)] + [("q", s * s, 2) for s in range(1, 60)] + [(None, 7, 3)]
    df = materialise(spark.createDataFrame(hist, "source string, size long, n long"), "test")
    goal = targets(df)
    goals = {r["source"]: r["target"] for r in goal.collect()}
    for r in solve_dual(df, goal).collect():
        got = sum(n * s * min(CAP, math.exp(r["lam"] * s)) for src, s, n in hist if src == r["source"])
        assert got == pytest.approx(goals[r["source"]], rel=1e-6)


def test_small_and_empty(spark):
    assert mix(spark.createDataFrame([], DOCS)).collect() == []
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n", "en", "a", 1)]
    assert sorted((r["row"]["doc_id"], r["size"], r["target"], r["taken"]) for r in mix(spark.createDataFrame(rows, DOCS)).collect()) == [
        (1, 0, 0.0, 0),
        (2, 0, 0.0, 0),
        (3, 0, 0.0, 0),
    ]
    one = mix(spark.createDataFrame([(1, "a b c", "en", "s", 1)], DOCS)).collect()[0]
    assert (one["target"], one["taken"]) == (3.0, 3)


def test_hot_group_is_split_by_hash(spark):
    rows = [(i, "same text here", "en", "hot" if i < 900 else "z", 1) for i in range(1500)]
    out = mix(spark.createDataFrame(rows, DOCS)).groupBy(F.col("row.source").alias("s"), "target").agg(F.sum("taken").alias("t")).collect()
    for r in out:
        assert abs(r["t"] - r["target"]) <= 3


@pytest.mark.parametrize("kind", ["null ids", "one id", "equal rows"])
def test_rows_without_ids_of_their_own_meet_the_target(spark, kind):
    """Equal ids and sizes, or equal rows, are taken one by one."""
    rows = []
    for i in range(600):
        doc = None if kind == "null ids" else 7
        word = "w" if kind == "equal rows" else f"w{i}"
        rows.append((doc, " ".join([word] * 50), "en", "a" if i < 300 else "b", 1))
    rows += [(1000 + i, "x y z", "en", "c", 1) for i in range(500)]
    docs = spark.createDataFrame(rows, DOCS)
    first = mix(docs.repartition(5)).collect()
    assert len(first) == len(rows)
    for s in "abc":
        mine = [r for r in first if r["row"]["source"] == s]
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= mine[0]["size"], s
        assert max(r["copies"] for r in mine) <= CAP
    again = mix(docs.repartition(3)).collect()
    key = lambda r: (repr(r["row"]), r["copies"])
    assert sorted(map(key, first)) == sorted(map(key, again))
