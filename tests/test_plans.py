"""Physical-plan properties that matter at scale."""

from lodestar.operators.filters import recent_sessions
from lodestar.operators.ranking import top_n
from lodestar.sources import fixtures as fx
from lodestar.sources.tables import read_table
from tests.conftest import SF_SMALL


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_sessions_pre_merge_before_shuffle(spark):
    plan = df_plan = _plan(fx.game_sessions(spark, SF_SMALL))
    # partial (map-side) aggregation of session windows before the exchange
    assert "partial_min" in plan and "MergingSessions" in df_plan


def test_topn_uses_group_limit(spark):
    s = fx.interactions(spark, SF_SMALL).withColumnRenamed("weight", "score")
    assert "WindowGroupLimit" in _plan(top_n(s, 10))


def test_scan_prunes_columns_and_pushes_filter(spark):
    o = read_table(spark, SF_SMALL, "orders")
    df = o.where(o.o_orderdate > "1998-01-01").select("o_orderkey")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(o_orderdate), GreaterThan(o_orderdate" in plan
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderdate:timestamp_ntz>" in plan


def test_recent_filter_reaches_scan(spark):
    e = read_table(spark, SF_SMALL, "events").withColumnRenamed("ts", "start_time")
    plan = _plan(recent_sessions(e, "2024-01-20 00:00:00", 7))
    assert "PushedFilters: [IsNotNull(ts), GreaterThan(ts" in plan


def test_left_join_null_keys_equal_plain_join(spark):
    from lodestar.operators.joins import left_join

    left = spark.createDataFrame([(1, "a"), (None, "b"), (2, "c"), (None, "d")], "k long, x string")
    right = spark.createDataFrame([(1, 10.0), (3, 30.0)], "k long, y double")
    for how in ("left", "left_anti"):
        a = sorted(map(tuple, left_join(left, right, "k", how).collect()), key=repr)
        b = sorted(map(tuple, left.join(right, "k", how).select(*left_join(left, right, "k", how).columns)
                       .collect()), key=repr)
        assert a == b


def test_profiles_read_history_once(spark):
    import __spark_entry__ as E

    plan = _plan(E.queries()["profiles"](spark, SF_SMALL))
    assert plan.count("lineitem.parquet") == 1 and plan.count("orders.parquet") == 1


def test_scorer_multiplies_blocks_by_key(spark):
    import __spark_entry__ as E

    df = E.queries()["graph_recommendations"](spark, SF_SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInPandas" in plan and "hashpartitioning(ub" in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_no_cross_join_anywhere(spark):
    import __spark_entry__ as E

    for name in ["titles", "add_players", "cold_start_recommendations", "blended_recommendations",
                 "behavioral_features", "normalized_zscore", "describe_lineitem"]:
        plan = E.queries()[name](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


def test_recent_sessions_prunes_date_partitions(spark):
    import uuid

    from lodestar.session import scratch_path
    from lodestar.sources.tables import append_sessions

    path = scratch_path(spark, f"tests/sessions-{uuid.uuid4().hex}")
    append_sessions(fx.game_sessions(spark, SF_SMALL), path)
    stored = spark.read.parquet(path)
    df = recent_sessions(stored, "2024-01-31 00:00:00", 7)
    plan = _plan(df)
    assert "PartitionFilters: [isnotnull(start_date" in plan and "PushedFilters: [IsNotNull(start_time)" in plan
    expected = fx.game_sessions(spark, SF_SMALL).where("start_time > timestamp_ntz'2024-01-24 00:00:00'").count()
    assert df.count() == expected > 0


def test_content_is_searched_by_posting_lists(spark):
    """No dense item block: items travel as classes (terms, weights, ids), by block."""
    import __spark_entry__ as E

    for name in ("content_recommendations", "diversified", "business_rules", "explanations"):
        plan = E.queries()[name](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
        assert "FlatMapCoGroupsInArrow" in plan and "hashpartitioning(ub" in plan
        assert "CartesianProduct" not in plan and "vec#" not in plan
