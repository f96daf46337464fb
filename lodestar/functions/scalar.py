"""Scalar column functions (S1-S8). All are Catalyst expressions: no UDFs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's results.
# Titles per favourite genre, skill level and preferred game type, and the
# fallback list for a player without a profile.
# ---------------------------------------------------------------------------
GENRE_TITLES = {
    "action": "Новые экшн-игры",
    "rpg": "РПГ с глубоким сюжетом",
    "strategy": "Стратегии с тактическими боями",
}
SKILLED_TITLE = "Сложные игры для опытных игроков"
NOVICE_TITLE = "Игры для начинающих"
TYPE_TITLES = {
    "multiplayer": "Мультиплеерные хиты",
    "coop": "Кооперативные приключения",
}
FALLBACK_TITLES = ["Популярные новинки", "Бестселлеры"]
# Skill thresholds (all strict) and the known game types in tie-break order.
SKILL_THRESHOLDS = [(1000, "expert"), (500, "advanced"), (100, "intermediate")]
SKILL_DEFAULT = "beginner"
KNOWN_GAME_TYPES = ["singleplayer", "multiplayer", "coop"]
# Constant stamp of an accepted collection record.
COLLECT_QUALITY = "high"
COLLECT_TIMESTAMP = "2025-01-01 12:00:00"
# Literal action counted by the aggression ratio.
KILL_ACTION = "pvp_kill"


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def skill_level(total: Column | str) -> Column:
    """>1000 expert, >500 advanced, >100 intermediate, else beginner."""
    t = _c(total)
    expr = None
    for threshold, name in SKILL_THRESHOLDS:
        expr = F.when(t > threshold, name) if expr is None else expr.when(t > threshold, name)
    return expr.otherwise(SKILL_DEFAULT)


def percent_of(pred: Column, total: Column | None = None) -> Column:
    """100 * count(pred) / GREATEST(count(*), 1), as DOUBLE."""
    denom = F.count(F.lit(1)) if total is None else total
    return F.count(F.when(pred, F.lit(1))) * F.lit(100.0) / F.greatest(denom, F.lit(1))


def seconds_between(start: Column | str, end: Column | str) -> Column:
    """S3: seconds from start to end (NULL if either is NULL); works on NTZ and LTZ."""
    s, e = _c(start), _c(end)
    return F.timestamp_diff("MICROSECOND", s, e) / F.lit(1_000_000.0)


def micros_between(start: Column | str, end: Column | str) -> Column:
    """Whole microseconds from start to end (exact, LONG)."""
    return F.timestamp_diff("MICROSECOND", _c(start), _c(end))


def avg_seconds(micros: Column) -> Column:
    """Average of microsecond counts in seconds, from the exact integer sum:
    sum / count / 1e6 (NULLs skipped), identical on any engine and order."""
    return F.sum(micros).cast("double") / F.count(micros) / F.lit(1_000_000.0)


def day_of(ts: Column | str) -> Column:
    """Timestamp -> date."""
    return F.to_date(_c(ts))


def genre_title(genre: Column | str) -> Column:
    """Title for a favourite genre; NULL for genres without one."""
    m = F.create_map(*[F.lit(x) for kv in GENRE_TITLES.items() for x in kv])
    return F.element_at(m, _c(genre))


def skill_title(skill: Column | str) -> Column:
    """Title for the skill level."""
    return F.when(_c(skill).isin("advanced", "expert"), SKILLED_TITLE).otherwise(NOVICE_TITLE)


def type_title(game_type: Column | str) -> Column:
    """Title for the preferred game type; singleplayer gives none."""
    t = _c(game_type)
    expr = None
    for name, title in TYPE_TITLES.items():
        expr = F.when(t == name, title) if expr is None else expr.when(t == name, title)
    return expr


def compact(*arrays: Column, n: int = 5) -> Column:
    """Concatenate arrays, drop NULL entries, keep the first ``n``."""
    joined = F.concat(*arrays) if len(arrays) > 1 else arrays[0]
    return F.slice(F.filter(joined, lambda x: x.isNotNull()), 1, n)


def stamp(df: DataFrame, quality: str = COLLECT_QUALITY, ts: str = COLLECT_TIMESTAMP) -> DataFrame:
    """Constant quality and time stamp columns."""
    return df.withColumn("data_quality", F.lit(quality)).withColumn("timestamp", F.lit(ts))


def preferred_type(single: Column | str, multi: Column | str, coop: Column | str) -> Column:
    """First maximum in the order singleplayer, multiplayer, coop."""
    s, m, c = _c(single), _c(multi), _c(coop)
    return (
        F.when((s >= m) & (s >= c), "singleplayer")
        .when(m >= c, "multiplayer")
        .otherwise("coop")
    )


def truthy(col: Column | str, kind: str = "long") -> Column:
    """Python truthiness of an id column: not NULL, not 0 / not ''."""
    c = _c(col)
    if kind == "string":
        return c.isNotNull() & (c != F.lit(""))
    return c.isNotNull() & (c != F.lit(0))
