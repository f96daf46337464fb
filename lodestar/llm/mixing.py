"""Mixing sources to target weights by entropy balancing, with DataFrame
operations only.

Every source gets a token target: sources in code point order (NULL last) weigh
``weights``, repeating, and share the tokens of all documents; a target stops
at ``cap`` times what its source holds, and the excess is shared by weight
among the others. Stopped targets and shares ``t * weight`` are one and the
same water level ``t``, found by a running sum over the sources in the order of
the level at which they stop.

Rates: among all document rates that meet a source's token target, the ones
closest in relative entropy to taking each document once are exponential tilts
``exp(lambda * size)``, at most ``cap``. The multiplier of each source solves a
convex dual. Newton steps run for all sources at once: a step is one aggregation
(gradient and curvature by source) over the histogram of (source, size), as
rates depend on nothing else; a bracket keeps the steps safe.

Copies: rates times counts are rounded along the sizes of a source, largest
first, so that running sums of copies stay within half a copy; the tokens that
are still missing or too many are then given to or taken from the largest size
that fits, until less than the smallest movable document is left. Within a
(source, size) group the documents with the smallest hashes of the whole row take
the extra copy. The cut between them is found in a histogram of hash buckets
and by counts of equal hashes in one bucket only, so a group with a third of all
rows is never in one task. Rows that share the hash at the cut are numbered
within the tasks that read them, and as many as are due take the extra copy.

Defined results: a NULL or blank text has size 0 and is taken once, adding no
tokens; NULL sources form one source; repeated ids and NULL ids are rows like
others; of fully equal rows some may be taken once more than the others; a source
without words has target 0; an empty table gives an empty result. Extra columns
are kept (maps take no part in the hash); added names replace clashing ones.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestar.llm.common import materialise, release, space_words
from lodestar.operators.joins import maybe_broadcast

WEIGHTS = (5, 2, 1)
CAP = 3
TOLERANCE = 1e-9
MAX_STEPS = 80
BUCKETS = 1024


def word_count(text: Column) -> Column:
    return F.size(space_words(text)).cast("long")


def rank_hash(docs: DataFrame, row: str | None = None) -> Column:
    """A hash of all columns of a row, from the columns or from the struct ``row``."""
    names = [f.name for f in docs.schema.fields if not any(t in f.dataType.simpleString() for t in ("map<", "variant"))]
    cols = [F.col(row)[n] if row else F.col(f"`{n}`") for n in names]
    # hashes pass over NULL, so the places of NULLs are hashed too
    return F.xxhash64(F.lit("mix"), F.array(*[c.isNull() for c in cols]), *cols)


def targets(hist: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """source, source_size, target: one row a source."""
    per = hist.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).cast("long").alias("source_size"))
    every = Window.partitionBy()  # sources only: one row each
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    w = per.withColumn("place", F.row_number().over(by_name) - 1).withColumn("weight", weight)
    w = w.withColumn("total", F.sum("source_size").over(every)).withColumn("stop", F.col("source_size") * float(cap) / F.col("weight"))
    before = Window.orderBy("stop", "place").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy("stop", "place").rowsBetween(0, Window.unboundedFollowing)
    # the level if all sources before this one are stopped and the others are not
    level = (F.col("total") - F.coalesce(F.sum(F.col("source_size") * cap).over(before), F.lit(0))) / F.sum("weight").over(after)
    w = w.withColumn("level", level)
    # the water level is the first one that its own source does not stop
    w = w.withColumn("t", F.min(F.when(F.col("level") <= F.col("stop"), F.struct("stop", "place", "level"))).over(every)["level"])
    full = F.col("source_size") * float(cap)
    return w.select("source", "source_size", F.when(F.col("total") == 0, 0.0).otherwise(F.least(full, F.col("t") * F.col("weight"))).alias("target"))


def _with_source(left: DataFrame, right: DataFrame) -> DataFrame:
    """Join on the source, NULL with NULL; ``right`` has a row a source."""
    r = maybe_broadcast(right.withColumnRenamed("source", "__src"))
    return left.join(r, F.col("source").eqNullSafe(F.col("__src"))).drop("__src")


def solve_dual(hist: DataFrame, goal: DataFrame, cap: int = CAP) -> DataFrame:
    """source, lam (multiplier a token): Newton iterations on the dual of all sources."""
    top = math.log(cap)
    mean = hist.groupBy("source").agg((F.sum(F.col("n") * F.col("size")) / F.sum("n")).alias("unit"))
    full = F.col("target") >= F.col("source_size") * float(cap) * (1 - 1e-12)
    state = _with_source(goal, mean).where(F.col("source_size") > 0).select(
        "source",
        "target",
        "unit",
        # at +top a single token is at the cap already; there all documents are
        F.when(full, F.lit(top) * F.col("unit")).otherwise(F.lit(0.0)).alias("lam"),
        (F.lit(-800.0) * F.col("unit")).alias("lo"),
        (F.lit(top) * F.col("unit")).alias("hi"),
        full.alias("done"),
    )
    state = materialise(state, "mix-dual")
    for _ in range(MAX_STEPS):
        tilt = F.col("lam") * F.col("size") / F.col("unit")
        open_ = tilt < top
        held = F.col("n") * F.col("size")
        parts = _with_source(hist.where(F.col("size") > 0), state.where(~F.col("done"))).groupBy(
            "source", "target", "unit", "lam", "lo", "hi"
        ).agg(
            F.sum(held * F.when(open_, F.exp(tilt)).otherwise(float(cap))).alias("got"),
            F.sum(F.when(open_, held * F.col("size") / F.col("unit") * F.exp(tilt)).otherwise(0.0)).alias("curve"),
        )
        gap = F.col("got") - F.col("target")
        lo = F.when(gap < 0, F.col("lam")).otherwise(F.col("lo"))
        hi = F.when(gap > 0, F.col("lam")).otherwise(F.col("hi"))
        newton = F.when(F.col("curve") > 0, F.col("lam") - gap / F.col("curve"))
        step = F.when((newton > lo) & (newton < hi), newton).otherwise((lo + hi) / 2)
        near = (F.abs(gap) <= F.col("target") * TOLERANCE) | (hi - lo <= F.lit(1e-15) * F.greatest(F.abs(lo), F.abs(hi)))
        moved = parts.select(
            "source", "target", "unit", F.when(near, F.col("lam")).otherwise(step).alias("lam"), lo.alias("lo"), hi.alias("hi"), near.alias("done")
        )
        new = materialise(moved.unionByName(state.where("done")), "mix-dual")
        release(state)
        state = new
        if state.where(~F.col("done")).isEmpty():
            break
    return state.select("source", (F.col("lam") / F.col("unit")).alias("lam"))


def rounded_groups(hist: DataFrame, goal: DataFrame, lam: DataFrame, cap: int = CAP) -> DataFrame:
    """(source, size, n, source_size, target, copies): whole copies a group."""
    multiplier = lam.withColumnRenamed("source", "__s2")
    g = _with_source(hist, goal)
    g = g.join(maybe_broadcast(multiplier), F.col("source").eqNullSafe(F.col("__s2")), "left").drop("__s2")
    rate = F.coalesce(F.least(F.lit(float(cap)), F.exp(F.least(F.col("lam") * F.col("size"), F.lit(50.0)))), F.lit(1.0))
    src = Window.partitionBy("source")
    upto = src.orderBy(F.col("size").desc()).rowsBetween(Window.unboundedPreceding, 0)
    g = g.withColumn("want", F.col("n") * rate).withColumn("run", F.floor(F.sum("want").over(upto) + 0.5))
    prev = F.coalesce(F.lag("run").over(src.orderBy(F.col("size").desc())), F.lit(0))
    g = g.withColumn("copies", F.greatest(F.lit(0), F.least(F.col("n") * cap, F.col("run") - prev)).cast("long")).select(
        "source", "size", "n", "source_size", "target", "copies"
    )
    g = materialise(g, "mix-groups")
    while True:
        moved = g
        for _ in range(4):
            miss = F.col("target") - F.sum(F.col("copies") * F.col("size")).over(src)
            moved = moved.withColumn("miss", miss)
            room = F.when(F.col("miss") > 0, F.col("n") * cap - F.col("copies")).otherwise(F.col("copies"))
            fits = (F.col("size") > 0) & (F.col("size") <= F.abs("miss")) & (room > 0)
            moved = moved.withColumn("pick", F.max(F.when(fits, F.col("size"))).over(src))
            by = F.least(room, F.floor(F.abs("miss") / F.col("size"))) * F.signum("miss").cast("long")
            moved = moved.withColumn("copies", F.when(F.col("size") == F.col("pick"), F.col("copies") + by).otherwise(F.col("copies")))
        moved = moved.withColumn("copies", F.col("copies").cast("long"))
        left = moved.where(F.col("pick").isNotNull()).isEmpty()
        new = materialise(moved.drop("miss", "pick"), "mix-groups")
        release(g)
        g = new
        if left:
            return g


def with_cuts(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Groups with ``base`` copies of every document and ``cut``: documents
    whose hash is below ``cut`` take one more, and ``take`` of the ``ties``
    documents that have it. ``rows``: source, size, hash."""
    g = groups.withColumn("base", F.floor(F.col("copies") / F.col("n"))).withColumn("extra", F.col("copies") - F.col("base") * F.col("n"))
    part = g.where(F.col("extra") > 0).select(F.col("source").alias("s"), F.col("size").alias("z"), "extra")
    bucket = F.shiftrightunsigned(F.col("hash"), 54)  # the top 10 bits
    top = F.pmod(bucket + BUCKETS // 2, F.lit(BUCKETS))  # in the order of the signed hash
    counts = rows.select("source", "size", top.alias("b")).groupBy("source", "size", "b").agg(F.count(F.lit(1)).alias("c"))
    near = counts.join(maybe_broadcast(part), F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")))
    order = Window.partitionBy("source", "size").orderBy("b")
    run = near.withColumn("upto", F.sum("c").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    # the bucket in which the last extra copy falls, and how many it takes there
    hit = run.where((F.col("upto") >= F.col("extra")) & (F.col("upto") - F.col("c") < F.col("extra"))).select(
        F.col("source").alias("s"), F.col("size").alias("z"), F.col("b").alias("cb"), (F.col("extra") - F.col("upto") + F.col("c")).alias("k")
    )
    inside = rows.select("source", "size", "hash", top.alias("b")).join(
        maybe_broadcast(hit), F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")) & (F.col("b") == F.col("cb"))
    )
    ties = inside.groupBy("source", "size", "k", "hash").agg(F.count(F.lit(1)).alias("ties"))
    by_hash = Window.partitionBy("source", "size").orderBy("hash").rowsBetween(Window.unboundedPreceding, 0)
    ranked = ties.withColumn("upto", F.sum("ties").over(by_hash)).withColumn("take", F.col("k") - F.col("upto") + F.col("ties"))
    cut = ranked.where((F.col("take") > 0) & (F.col("take") <= F.col("ties"))).select(
        F.col("source").alias("s"), F.col("size").alias("z"), F.col("hash").alias("cut"), "take", "ties"
    )
    return g.join(cut, F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")), "left").select(
        F.col("source").alias("g_source"), F.col("size").alias("g_size"), "source_size", "target", "base", "cut", "take", "ties"
    )


def plan_mix(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """The group table of a mix from ``rows`` (source, size, hash), materialised."""
    hist = materialise(rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "mix-sizes")
    goal = materialise(targets(hist, weights, cap), "mix-targets")
    groups = rounded_groups(hist, goal, solve_dual(hist, goal, cap), cap)
    return materialise(with_cuts(rows, groups), "mix-cuts")


def with_copies(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``rows`` (with source, size, hash) and source_size, target, copies, taken."""
    joined = rows.join(maybe_broadcast(plan), F.col("source").eqNullSafe(F.col("g_source")) & (F.col("size") == F.col("g_size")))
    split = F.coalesce((F.col("hash") == F.col("cut")) & (F.col("take") < F.col("ties")), F.lit(False))
    more = F.coalesce((F.col("hash") <= F.col("cut")).cast("long"), F.lit(0))
    out = joined.where(~split).withColumn("extra", more)
    if not plan.where(F.col("take") < F.col("ties")).isEmpty():
        out = out.unionByName(_split_ties(joined.where(split)))
    return out.withColumn("copies", (F.col("base") + F.col("extra")).cast("long")).withColumn("taken", F.col("copies") * F.col("size")).drop(
        "g_source", "g_size", "base", "cut", "take", "ties", "extra"
    )


def _split_ties(tied: DataFrame) -> DataFrame:
    """Rows that share the hash at their group's cut, with ``extra`` 1 for ``take``
    of them: each task's rows are counted, and numbered among themselves."""
    stored = materialise(tied.withColumn("part", F.spark_partition_id()), "mix-ties")
    upto = Window.partitionBy("s", "z").orderBy("p").rowsBetween(Window.unboundedPreceding, 0)
    per = stored.groupBy(F.col("source").alias("s"), F.col("size").alias("z"), F.col("part").alias("p")).agg(F.count(F.lit(1)).alias("c"))
    per = per.withColumn("before", F.sum("c").over(upto) - F.col("c")).drop("c")
    same = F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")) & (F.col("part") == F.col("p"))
    inside = Window.partitionBy("source", "size", "part").orderBy("hash")
    numbered = stored.withColumn("r", F.row_number().over(inside)).join(maybe_broadcast(per), same)
    extra = (F.col("before") + F.col("r") <= F.col("take")).cast("long")
    return numbered.withColumn("extra", extra).drop("s", "z", "p", "part", "before", "r")


def mix(
    docs: DataFrame, text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, cap: int = CAP
) -> DataFrame:
    """``row`` (all columns of a document), size, source_size, target, copies
    and taken. ``copies`` times the row is the mix."""
    size = word_count(F.col(text))
    key = [F.col(source).alias("source"), size.alias("size"), rank_hash(docs).alias("hash")]
    rows = materialise(docs.select(*key), "mix-rows")
    plan = plan_mix(rows, weights, cap)
    carried = docs.select(F.struct("*").alias("row")).select(
        "row",
        F.col("row")[source].alias("source"),
        word_count(F.col("row")[text]).alias("size"),
    )
    return with_copies(carried.withColumn("hash", rank_hash(docs, "row")), plan).drop("hash", "source")
