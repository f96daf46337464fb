"""Aggregations (A1-A11). All are partial + final aggregations: each task
combines its rows per key before the shuffle, so a hot key costs one row per
task on the wire."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.scalar import (
    KILL_ACTION,
    KNOWN_GAME_TYPES,
    avg_seconds,
    micros_between,
    percent_of,
)
from lodestar.operators.filters import recent_recs, recent_sessions
from lodestar.operators.joins import sessions_with_games


def _avg_duration():
    """AVG(session_duration) of the stored column (NULLs skipped), summed as
    whole microseconds, so the order of the rows can't change it."""
    return avg_seconds(F.round(F.col("session_duration").cast("double") * 1_000_000.0).cast("long"))


def player_stats_one(sessions: DataFrame, player_id, as_of: str, days: int = 30) -> DataFrame:
    """A1: COUNT(*), AVG(session_duration) for one player, no GROUP BY:
    always one row; no sessions -> (0, NULL)."""
    r = recent_sessions(sessions, as_of, days, player_id=player_id)
    return r.agg(F.count(F.lit(1)).alias("n_sessions"), _avg_duration().alias("avg_duration"))


def player_stats(sessions: DataFrame, requests: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """A1 for a request table: one row per requested player, (0, NULL) when
    nothing is recent."""
    r = recent_sessions(sessions, as_of, days).groupBy("player_id").agg(
        F.count(F.lit(1)).alias("n_sessions"), _avg_duration().alias("avg_duration")
    )
    j = requests.select("player_id").join(r, "player_id", "left")
    return j.select("player_id", F.coalesce("n_sessions", F.lit(0)).alias("n_sessions"), "avg_duration")


def aggression(actions: DataFrame, kill: str = KILL_ACTION) -> DataFrame:
    """A2: 100 * count(action = kill) / GREATEST(count(*), 1) per player (DOUBLE)."""
    return actions.groupBy("player_id").agg(
        percent_of(F.col("action_type") == F.lit(kill)).alias("aggression_coef")
    )


def genre_preference(sessions: DataFrame, games: DataFrame) -> DataFrame:
    """A3: total seconds (end - start) per (player, genre); NULL ends are
    skipped, all-NULL group -> NULL. Sums microseconds (exact), divides once."""
    j = sessions_with_games(sessions, games.select("game_id", "genre_id"))
    micros = micros_between("start_time", "end_time")
    return j.groupBy("player_id", "genre_id").agg(
        (F.sum(micros) / F.lit(1_000_000.0)).alias("total_play_time")
    )


def daily_quality(recs: DataFrame, as_of_date: str, days: int = 7) -> DataFrame:
    """A4: per day of the last ``days`` (inclusive): count, avg click rate,
    avg conversion rate (avg skips NULLs, count does not)."""
    r = recent_recs(recs, as_of_date, days)
    return r.groupBy(F.to_date("created_at").alias("date")).agg(
        F.count(F.lit(1)).alias("total_recommendations"),
        F.avg("click_rate").alias("avg_click_rate"),
        F.avg("conversion_rate").alias("avg_conversion"),
    )


def genre_stats(sessions: DataFrame, games: DataFrame) -> DataFrame:
    """A5: per genre COUNT(DISTINCT player_id), AVG(session_duration)."""
    j = sessions_with_games(sessions, games.select("game_id", "genre_id"))
    return j.groupBy("genre_id").agg(
        F.count_distinct("player_id").alias("unique_players"),
        _avg_duration().alias("avg_session_time"),
    )


def exact_sum(col: str):
    """Sum of a DOUBLE column as whole millionths, so that no order of the
    rows moves it across a threshold."""
    return (F.sum(F.round(F.col(col).cast("double") * 1_000_000.0).cast("long")) / F.lit(1_000_000.0))


def total_play_time(players: DataFrame, history: DataFrame) -> DataFrame:
    """Total play time per player, 0 for an empty history."""
    t = history.groupBy("player_id").agg(exact_sum("duration").alias("total_play_time"))
    j = players.select("player_id").join(t, "player_id", "left")
    return j.select("player_id", F.coalesce("total_play_time", F.lit(0.0)).alias("total_play_time"))


def genre_counts(history: DataFrame) -> DataFrame:
    """Sessions per (player, genre) and the first appearance (min ord)."""
    return history.groupBy("player_id", "genre").agg(
        F.count(F.lit(1)).alias("n"), F.min("ord").alias("first_seen")
    )


def type_counts(history: DataFrame) -> DataFrame:
    """Sessions per player for the three known game types only."""
    return history.groupBy("player_id").agg(
        *[F.count_if(F.col("game_type") == F.lit(t)).alias(f"n_{t}") for t in KNOWN_GAME_TYPES]
    )


def _bin(lo: float, hi: float, bins: int) -> Column:
    """Bin of ``value`` among ``bins`` of equal width on lo .. hi, in the order of the
    values; halves keep the width finite."""
    width = hi / 2 - lo / 2
    if width == 0:  # neighbours so small that their halves meet
        return F.when(F.col("value") > F.lit(lo), 1).otherwise(0)
    at = F.floor((F.col("value") / 2 - F.lit(lo / 2)) / F.lit(width) * bins)
    return F.greatest(F.lit(0), F.least(F.lit(bins - 1), at)).cast("int")


def exact_quantiles(long: DataFrame, qs: list[float], buckets: int = 1024, stats: list | None = None,
                    small: int = 100_000) -> DataFrame:
    """Exact quantiles with linear interpolation (as ``percentile``) of
    ``value`` per ``column`` in a long (column, value) DataFrame, without
    holding a column in one task and without shuffling its values.

    1. per column: n, least and greatest value;
    2. rows, least and greatest value per (column, interval, one of ``buckets`` bins of
       equal width), counted in each task, so that only bins are shuffled and collected;
    3. a bin that holds a wanted rank, more than one value and more than ``small`` rows
       is the next interval, from its least to its greatest value (its ends fall into
       different bins, so this ends), and 2 again;
    4. the values of the bins left, at most ``small`` rows each, are counted by value and
       ranked, one window partition a bin. A bin of one value needs no ranking.

    ``stats`` may carry rows (column, n, least, greatest) computed by the caller in
    the same pass as other statistics. Returns (column, q, value)."""
    spark = long.sparkSession
    vals = long.where(F.col("value").isNotNull() & ~F.isnan("value"))
    st = stats if stats is not None else vals.groupBy("column").agg(
        F.count(F.lit(1)).alias("n"), F.min("value").alias("least"), F.max("value").alias("greatest")).collect()
    n_of = {r["column"]: int(r["n"]) for r in st if r["n"]}
    if not n_of:
        return spark.createDataFrame([], "column string, q double, value double")
    ranks = {c: sorted({r for q in qs for r in (int(q * (n - 1) // 1), int(-(-(q * (n - 1)) // 1)))}) for c, n in n_of.items()}
    # closed intervals: column, number -> least and greatest value, wanted ranks, rows before
    todo = {(r["column"], 0): (r["least"], r["greatest"], ranks[r["column"]], 0) for r in st if r["n"]}
    known: list[tuple] = []  # column, rank, value
    final: dict[tuple[str, int], tuple] = {}
    serial = 0
    while todo:
        open_ = {}
        for (c, i), (lo, hi, want, before) in todo.items():
            if lo == hi:
                known += [(c, r, lo) for r in want]
            else:
                open_[(c, i)] = (lo, hi, want, before)
        if not open_:
            break
        rows = _in_intervals(vals, open_)
        # infinite ends have bins of their own; the others share the finite values' width
        ends = {k: (max(lo, -_MAX), min(hi, _MAX)) for k, (lo, hi, *_) in open_.items()}
        b = None
        for k, (lo, hi) in ends.items():
            inside = F.col("iv") == F.lit(_number(open_, k))
            b = F.when(inside, _bin(lo, hi, buckets)) if b is None else b.when(inside, _bin(lo, hi, buckets))
        b = F.when(F.col("value") == F.lit(float("-inf")), -1).when(F.col("value") == F.lit(float("inf")), buckets).otherwise(b)
        counted = rows.groupBy("iv", b.alias("b")).agg(
            F.count(F.lit(1)).alias("n"), F.min("value").alias("least"), F.max("value").alias("greatest")).collect()
        bins: dict = {}
        for r in sorted(counted, key=lambda r: (r["iv"], r["b"])):
            bins.setdefault(r["iv"], []).append(r)
        todo = {}
        for k, (_, _, want, before) in open_.items():
            for r in bins.get(_number(open_, k), []):
                n = int(r["n"])
                held = [x for x in want if before <= x < before + n]
                if held:
                    serial += 1
                    narrow = n > small or r["least"] == r["greatest"]
                    (todo if narrow else final)[(k[0], serial)] = (r["least"], r["greatest"], held, before)
                before += n
    at = spark.createDataFrame(known, "column string, r long, value double")
    if final:
        inside = _in_intervals(vals, final).groupBy("iv", "value").agg(F.count(F.lit(1)).alias("cnt"))
        wanted = spark.createDataFrame([(k[0], _number(final, k), r, before) for k, (_, _, held, before) in final.items() for r in held],
                                       "column string, iv int, r long, off long")
        w = Window.partitionBy("iv").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
        ranked = inside.withColumn("upto", F.sum("cnt").over(w))
        at = at.unionByName(ranked.join(F.broadcast(wanted), "iv").where(  # a row a wanted rank
            (F.col("r") >= F.col("off") + F.col("upto") - F.col("cnt")) & (F.col("r") < F.col("off") + F.col("upto"))
        ).select("column", "r", "value"))
    qrows = []
    for c, n in n_of.items():
        for q in qs:
            pos = q * (n - 1)
            qrows.append((c, float(q), int(pos // 1), int(-(-pos // 1)), float(pos - pos // 1)))
    qdf = spark.createDataFrame(qrows, "column string, q double, lo long, hi long, frac double")
    # a row a quantile meets at most two ranks: both ends in one grouping
    ends = qdf.join(F.broadcast(at), "column").where(F.col("r").isin(F.col("lo"), F.col("hi")))  # rows: quantiles and ranks
    both = ends.groupBy("column", "q", "frac").agg(F.min_by("value", "r").alias("v_lo"), F.max_by("value", "r").alias("v_hi"))
    mixed = F.col("v_lo") + F.col("frac") * (F.col("v_hi") - F.col("v_lo"))
    return both.select("column", "q", F.when(F.col("v_lo") == F.col("v_hi"), F.col("v_lo")).otherwise(mixed).alias("value"))


_MAX = 1.7976931348623157e308  # the greatest finite double


def _number(intervals: dict, key: tuple[str, int]) -> int:
    return list(intervals).index(key)


def _in_intervals(vals: DataFrame, intervals: dict) -> DataFrame:
    """Values inside the closed intervals (least to greatest) of their column, with the
    interval's place in ``intervals`` as ``iv``."""
    pick = None
    for i, ((c, _), (lo, hi, *_rest)) in enumerate(intervals.items()):
        inside = (F.col("column") == F.lit(c)) & F.col("value").between(F.lit(float(lo)), F.lit(float(hi)))
        pick = F.when(inside, F.lit(i)) if pick is None else pick.when(inside, F.lit(i))
    return vals.withColumn("iv", pick).where(F.col("iv").isNotNull())


def describe(df: DataFrame, cols: list[str], buckets: int = 1024) -> DataFrame:
    """Long-form statistics, one row per column: count, nulls, mean,
    sample stddev, min, max and exact quartiles (linear interpolation).

    The columns are unpivoted to (column, value); moments are one
    aggregation by column, quartiles come from ``exact_quantiles`` (no
    per-column buffer of all values)."""
    long = df.select(
        F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value"))
                            for c in cols])).alias("kv")
    ).select("kv.column", "kv.value")
    spark = df.sparkSession
    ok = F.col("value").isNotNull() & ~F.isnan("value")
    rows = long.groupBy("column").agg(
        F.count("value").alias("n_all"),
        F.count_if(F.col("value").isNull()).alias("nulls"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("stddev"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        F.count_if(ok).alias("n"),
        F.min(F.when(ok, F.col("value"))).alias("least"),
        F.max(F.when(ok, F.col("value"))).alias("greatest"),
    ).collect()  # one row per column
    moments = spark.createDataFrame(
        [(r["column"], r["n_all"], r["nulls"], r["mean"], r["stddev"], r["min"], r["max"]) for r in rows],
        "column string, n long, nulls long, mean double, stddev double, min double, max double")
    q = exact_quantiles(long, [0.25, 0.5, 0.75], buckets, stats=rows)
    wide = q.groupBy("column").pivot("q", [0.25, 0.5, 0.75]).agg(F.first("value"))
    wide = wide.toDF("column", "q25", "q50", "q75")
    return moments.join(wide, "column", "left")


def list_players(players: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A10: (player ids, total)."""
    ids = players.select("player_id")
    return ids, ids.agg(F.count(F.lit(1)).alias("total"))


def interaction_matrix(history: DataFrame) -> DataFrame:
    """Long-form user x item matrix: summed play time, plays, last play."""
    return history.groupBy("player_id", "game_id").agg(
        F.sum("duration").cast("double").alias("weight"),
        F.count(F.lit(1)).alias("n_plays"),
        F.max("played_at").alias("last_played"),
    )


interactions = interaction_matrix  # A11 under its inventory name

__all__ = [
    "aggression", "daily_quality", "describe", "genre_counts", "genre_preference", "genre_stats",
    "interaction_matrix", "list_players", "player_stats", "player_stats_one",
    "total_play_time", "type_counts", "maybe_broadcast",
]
