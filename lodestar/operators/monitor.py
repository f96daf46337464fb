"""Monitoring (MO1-MO2): the daily quality log and alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.operators.aggregates import daily_quality
from lodestar.sources.tables import write_dataset


def log_quality(recs: DataFrame, as_of_date: str, path: str | None = None, days: int = 7) -> DataFrame:
    """MO1: A4 for the window ending at ``as_of_date``; when ``path`` is given
    the rows are written to a date-partitioned table (dynamic partition
    overwrite, so re-running a day replaces that day only)."""
    daily = daily_quality(recs, as_of_date, days)
    if path:
        write_dataset(daily.withColumn("day", F.col("date")), path, partition_by=["day"])
    return daily


def alerts(daily: DataFrame, metric: str = "avg_click_rate", min_value: float = 0.15,
           drop: float = 0.2, lookback: int = 7) -> DataFrame:
    """MO2: a day alerts when its ``metric`` is below ``min_value`` or below
    (1 - drop) x the mean of the previous ``lookback`` days.

    ``daily`` holds one row per day, so the ordered window over all rows is
    bounded by the number of days, not by the data volume."""
    w = Window.orderBy("date").rowsBetween(-lookback, -1)
    base = F.avg(metric).over(w)
    m = F.col(metric)
    return daily.select(
        "date", m.alias("value"), base.alias("baseline"),
        F.when(m < F.lit(min_value), "below_floor")
        .when(base.isNotNull() & (m < F.lit(1 - drop) * base), "drop")
        .alias("alert"),
    ).where(F.col("alert").isNotNull())
