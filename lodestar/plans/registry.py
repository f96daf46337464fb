"""Registry of named queries: a Spark builder (spark, sf_dir) -> DataFrame and,
where the result is SQL-expressible, an independent DuckDB oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# Registered results render timestamps as text with microseconds (like dates
# as yyyy-MM-dd), so the comparison with the oracle does not depend on how a
# client converts timestamp types; the library functions return timestamps.
TS_FORMAT_SPARK = "yyyy-MM-dd HH:mm:ss.SSSSSS"
TS_FORMAT_SQL = "%Y-%m-%d %H:%M:%S.%f"


def _ts_text(df: DataFrame) -> DataFrame:
    kinds = dict(df.dtypes)
    return df.select(*[
        F.date_format(F.col(c), TS_FORMAT_SPARK).alias(c) if kinds[c] in ("timestamp", "timestamp_ntz") else F.col(c)
        for c in df.columns
    ])


def query(name: str, oracle: str | None = None, ts: tuple[str, ...] = ()):
    """Register a query; ``ts`` names the oracle's timestamp columns, which
    the oracle renders as text the same way."""

    def deco(fn: Callable[[SparkSession, str], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")

        def run(spark: SparkSession, d: str) -> DataFrame:
            return _ts_text(fn(spark, d))

        run.__name__, run.__doc__ = fn.__name__, fn.__doc__
        QUERIES[name] = run
        if oracle is not None:
            sql = oracle
            if ts:
                repl = ", ".join(f"strftime({c}, '{TS_FORMAT_SQL}') AS {c}" for c in ts)
                sql = f"SELECT * REPLACE ({repl}) FROM ({oracle}) AS _q"
            ORACLES[name] = sql
        return fn

    return deco


def r6(c: Column | str) -> Column:
    """Round a DOUBLE to 6 digits (the oracle rounds the same way)."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def date_text(c: Column | str) -> Column:
    return F.date_format(F.col(c) if isinstance(c, str) else c, "yyyy-MM-dd")
