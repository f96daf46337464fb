"""Quality rules: base rules and robust multivariate outliers, DataFrame
operations only.

Base statistics are counted over whole texts with array functions: words,
their code points, symbols, repeated lines, and words inside 8-word windows that
occur twice or more (``base_statistics``). A text fails the base rules with too
few words or too many repeated ones.

The rest is judged against its own kind. Texts of one language and source form
a group, and of each a vector of transformed statistics is taken (``FEATURES``).
The group's centre and scatter come from the minimum covariance determinant: a
start from medians and absolute deviations, then concentration steps. A step
takes the ``SUPPORT`` share of the group closest in Mahalanobis distance and
computes mean and covariance of these, which never raises the determinant; it
is two aggregations by group over the small statistics table (the quantile of the
distances, then moments), until the determinant of every group settles. The
covariance is made consistent for the normal distribution, and a text farther
than the chi-square cut is rejected.

Robustness in both ways: means and covariances of junk never enter, as the half
with the smallest determinant decides; and a statistic that hardly varies in a
group (no repeated lines anywhere) has a least spread (``FLOORS``), so one odd
line is no outlier. Groups below ``MIN_GROUP`` texts have no estimate; they are
judged by that of their language over all sources, and kept if that is too small
as well.

Defined results: NULL, empty and blank texts have no words and fail the base;
NULL languages and sources are groups of their own; repeated rows count as
often as they occur and share a verdict; an empty table gives an empty result.
Columns of the input come back inside ``row``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import materialise, release, space_words
from lodestar.operators.joins import maybe_broadcast

SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30


def base_statistics(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` and word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words, n_lines."""
    t = F.coalesce(F.col(text), F.lit(""))
    a = docs.select("*", space_words(F.col(text)).alias("__words"))
    n = F.size("__words")
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    hashes = F.when(
        n >= WINDOW, F.transform(F.sequence(F.lit(1), n - WINDOW + 1), lambda i: F.xxhash64(F.slice("__words", i, WINDOW)))
    )
    b = a.select(
        *docs.columns,
        n.cast("long").alias("n_words"),
        F.size(F.split(t, "\n", -1)).cast("long").alias("n_lines"),
        F.length(F.array_join("__words", "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        lines.alias("__lines"),
        hashes.alias("__h"),
    )
    # places are sorted by window only where some window repeats
    repeats = F.size(F.array_distinct("__h")) < F.size("__h")
    c = b.select(
        *docs.columns,
        "n_words",
        "n_lines",
        "word_chars",
        "n_symbols",
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.when(repeats, F.array_sort(F.transform("__h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("__s"),
    )
    s, last = F.col("__s"), F.size("__s") - 1
    same = lambda i, j: F.get(s, i)["h"] == F.get(s, j)["h"]
    twice = F.filter(
        F.sequence(F.lit(0), last), lambda i: ((i > 0) & same(i, i - 1)) | ((i < last) & same(i, i + 1))
    )
    d = c.withColumn("__p", F.when(s.isNotNull(), F.array_sort(F.transform(twice, lambda i: F.get(s, i)["i"]))))
    covered = F.aggregate(
        "__p",
        F.struct(F.lit(-WINDOW).alias("at"), F.lit(0).cast("long").alias("n")),
        lambda acc, p: F.struct(p.alias("at"), (acc["n"] + F.least(F.lit(WINDOW), p - acc["at"])).alias("n")),
    )["n"]
    return d.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("__s", "__p")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)


# Transformed statistics and the least standard deviation each is given.
FEATURES = ("x0", "x1", "x2", "x3")
FLOORS = (0.08, 0.04, 0.15, 0.18)
SUPPORT = 0.5  # share of a group that decides its centre and scatter; junk below half of it never does
STEPS = 10
SETTLED = 1e-6
MIN_GROUP = 40
TAIL = 1e-7  # a normal text is rejected with this probability


def features() -> list[Column]:
    """Log mean word length; roots of the shares of symbols, repeated words and repeated lines."""
    words = F.greatest(F.col("n_words"), F.lit(1))
    return [
        F.log(F.greatest(F.col("word_chars"), F.lit(1)) / words),
        F.sqrt(F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1))),
        F.sqrt(F.col("n_repeat_words") / words),
        F.sqrt(F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))),
    ]


def chi_square_tail(x: float, degrees: int) -> float:
    """P(X > x) for an even number of degrees of freedom."""
    return math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(degrees // 2))


def chi_square_cut(tail: float, degrees: int) -> float:
    lo, hi = 0.0, 1000.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi_square_tail(mid, degrees) > tail else (lo, mid)
    return hi


def consistency(support: float, degrees: int) -> float:
    """What the covariance of the closest ``support`` of a normal sample lacks."""
    return support / (1 - chi_square_tail(chi_square_cut(1 - support, degrees), degrees + 2))


def _on(rows: DataFrame, params: DataFrame, keys: list[str]) -> DataFrame:
    """Join on group keys, NULL with NULL; ``params`` has a row a group."""
    p = params.select(*[F.col(k).alias(f"__{k}") for k in keys], *[c for c in params.columns if c not in keys])
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return rows.join(maybe_broadcast(p), on).drop(*[f"__{k}" for k in keys])


def _scatter(params: DataFrame) -> DataFrame:
    """From means m_i and covariances c_ij: the inverse l_ij of the Cholesky
    factor of the covariance with least spreads, and its log determinant."""
    d = len(FEATURES)
    p = params
    for i in range(d):
        p = p.withColumn(f"c{i}{i}", F.greatest(F.col(f"c{i}{i}"), F.lit(FLOORS[i] ** 2)))
    for i in range(d):  # Cholesky factor, column by column
        for j in range(i + 1):
            rest = F.col(f"c{i}{j}")
            for k in range(j):
                rest = rest - F.col(f"f{i}{k}") * F.col(f"f{j}{k}")
            # enlarged diagonals keep the matrix positive; the bound is for rounding
            p = p.withColumn(f"f{i}{j}", F.sqrt(F.greatest(rest, F.lit(1e-12))) if i == j else rest / F.col(f"f{j}{j}"))
    for i in range(d):  # its inverse
        for j in range(i + 1):
            if i == j:
                p = p.withColumn(f"l{i}{j}", 1 / F.col(f"f{i}{i}"))
            else:
                rest = F.lit(0.0)
                for k in range(j, i):
                    rest = rest - F.col(f"f{i}{k}") * F.col(f"l{k}{j}")
                p = p.withColumn(f"l{i}{j}", rest / F.col(f"f{i}{i}"))
    log_det = sum(F.log(F.col(f"f{i}{i}")) for i in range(d)) * 2
    keep = [c for c in params.columns if not (len(c) == 3 and c[0] == "c")]
    return p.select(*keep, *[f"l{i}{j}" for i in range(d) for j in range(i + 1)], log_det.alias("log_det"))


def distance() -> Column:
    """Squared Mahalanobis distance of x_i from m_i under the factor l_ij."""
    out = F.lit(0.0)
    for i in range(len(FEATURES)):
        y = F.lit(0.0)
        for j in range(i + 1):
            y = y + F.col(f"l{i}{j}") * (F.col(f"x{j}") - F.col(f"m{j}"))
        out = out + y * y
    return out


def _start(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Medians, and absolute deviations from them as a diagonal scatter."""
    d = len(FEATURES)
    middle = materialise(
        rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.percentile_approx(x, 0.5).alias(f"m{i}") for i, x in enumerate(FEATURES)]),
        "quality-medians",
    )
    away = _on(rows, middle, keys).groupBy(*keys, "n", *[f"m{i}" for i in range(d)]).agg(
        *[F.percentile_approx(F.abs(F.col(x) - F.col(f"m{i}")), 0.5).alias(f"a{i}") for i, x in enumerate(FEATURES)]
    )
    cov = [(F.pow(1.4826 * F.col(f"a{i}"), 2) if i == j else F.lit(0.0)).alias(f"c{i}{j}") for i in range(d) for j in range(i + 1)]
    return _scatter(away.select(*keys, "n", *[f"m{i}" for i in range(d)], *cov))


def _concentrate(rows: DataFrame, params: DataFrame, keys: list[str]) -> DataFrame:
    """One step: the closest share of each group, and its mean and covariance."""
    d = len(FEATURES)
    away = _on(rows, params, keys).withColumn("d", distance())
    limit = materialise(away.groupBy(*keys).agg(F.percentile_approx("d", SUPPORT, 100_000).alias("limit")), "quality-limits")
    near = _on(away, limit, keys).where(F.col("d") <= F.col("limit"))
    # moments about the old centre, which keeps the differences exact
    y = [F.col(f"x{i}") - F.col(f"m{i}") for i in range(d)]
    sums = near.groupBy(*keys, "n", *[f"m{i}" for i in range(d)]).agg(
        *[F.avg(y[i]).alias(f"s{i}") for i in range(d)],
        *[F.avg(y[i] * y[j]).alias(f"q{i}{j}") for i in range(d) for j in range(i + 1)],
    )
    factor = consistency(SUPPORT, d)
    cov = [((F.col(f"q{i}{j}") - F.col(f"s{i}") * F.col(f"s{j}")) * factor).alias(f"c{i}{j}") for i in range(d) for j in range(i + 1)]
    mean = [(F.col(f"m{i}") + F.col(f"s{i}")).alias(f"m{i}") for i in range(d)]
    return _scatter(sums.select(*keys, "n", *mean, *cov))


def minimum_covariance(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Centre m_i and factor l_ij of every group with MIN_GROUP rows or more."""
    params = materialise(_start(rows, keys).where(F.col("n") >= MIN_GROUP), "quality-start")
    for _ in range(STEPS):
        new = materialise(_concentrate(rows, params, keys), "quality-step")
        before = params.select(*keys, F.col("log_det").alias("old"))
        moved = _on(new, before, keys).where(F.abs(F.col("log_det") - F.col("old")) > SETTLED).isEmpty()
        release(params)
        params = new
        if moved:
            break
    return params


def judged(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", carry: list[str] | None = None) -> DataFrame:
    """``row`` (the carried columns, all by default), the base statistics,
    base_failed, distance (NULL where there is no estimate) and kept."""
    carry = docs.columns if carry is None else carry
    slim = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"), F.col(text).alias("t"), F.col(lang).alias("lang"), F.col(source).alias("source")
    )
    stats = base_statistics(slim, "t").drop("t").withColumn("base_failed", base_failed())
    stats = materialise(stats.select("*", *[x.alias(f"x{i}") for i, x in enumerate(features())]), "quality-statistics")
    rows = stats.where(~F.col("base_failed")).select("lang", "source", *FEATURES)
    own = minimum_covariance(rows, ["lang", "source"])
    whole = minimum_covariance(rows.select("lang", *FEATURES), ["lang"])
    names = [c for c in own.columns if c[0] in "ml" and c[1:].isdigit()]
    keys = own.select(F.col("lang").alias("k_lang"), F.col("source").alias("k_source"), F.struct(*names).alias("own"))
    langs = whole.select(F.col("lang").alias("w_lang"), F.struct(*names).alias("whole"))
    found = stats.join(
        maybe_broadcast(keys), F.col("lang").eqNullSafe(F.col("k_lang")) & F.col("source").eqNullSafe(F.col("k_source")), "left"
    ).join(maybe_broadcast(langs), F.col("lang").eqNullSafe(F.col("w_lang")), "left")
    found = found.withColumn("p", F.coalesce("own", "whole")).select(*stats.columns, "p.*")
    cut = chi_square_cut(TAIL, len(FEATURES))
    far = F.when(~F.col("base_failed"), distance())
    return found.withColumn("distance", far).select(
        "row",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "distance",
        (~F.col("base_failed") & F.coalesce(F.col("distance") <= cut, F.lit(True))).alias("kept"),
    )
