"""Tumbling statistics windows named by their end.

A window ending at tick T with range R holds the hits of the milliseconds
strictly between T-R and T: the reference selects ``id > maxTimeuuid(T-R) and
id < minTimeuuid(T)``, so a hit in the boundary millisecond itself belongs to
no window. ``closed_left=True`` gives gap-free windows instead.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .timeid import ntz_lit


@dataclass(frozen=True)
class StatDefinition:
    """Type name and range of one statistics schedule."""
    stat_type: str
    range_ms: int

    @property
    def duration(self) -> str:
        return f"{self.range_ms} milliseconds"


# The schedule of the reference (every five minutes) plus an hour and a day.
FIVE_MINUTES = StatDefinition("5_minutes", 300_000)
ONE_HOUR = StatDefinition("1_hour", 3_600_000)
ONE_DAY = StatDefinition("1_day", 86_400_000)


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def with_window(df: DataFrame, ts: str, stat: StatDefinition, closed_left: bool = False,
                name: str = "stat_time") -> DataFrame:
    """Add the end of the window each row falls in; drop rows of the boundary
    millisecond unless ``closed_left``. Pure projection + filter (codegen)."""
    w = F.window(F.col(ts), stat.duration)
    out = df.withColumn("_w", w)
    if not closed_left:
        out = out.where(F.col(ts) >= F.col("_w.start") + F.expr("INTERVAL 1 MILLISECOND"))
    return out.withColumn(name, F.col("_w.end")).drop("_w")


def in_window_range(ts, end: dt.datetime, stat: StatDefinition,
                    closed_left: bool = False) -> Column:
    """Predicate for the hits of one window ending at ``end``: a plain range on
    literals, so it reaches the Parquet scan as pushed filters."""
    start = end - dt.timedelta(milliseconds=stat.range_ms)
    if not closed_left:
        start = start + dt.timedelta(milliseconds=1)
    lo = ntz_lit(start)
    hi = ntz_lit(end)
    return (_c(ts) >= lo) & (_c(ts) < hi)
