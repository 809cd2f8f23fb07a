"""Longer windows out of shorter ones (W2, A6).

Windows are open at both ends, so the hits of the millisecond in which a
short window begins are in no short window, but in the long one around it. These
*edge* hits are counted beside the windows, under the window they would
begin. A long window is then the sum of its short windows and of the edges
inside it; the edge at its own beginning becomes an edge of the long window,
so 5 minutes give hours, and hours give days.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.windows import StatDefinition
from .stats import LEVELS, stats_all_levels

_COLUMNS = ["level", "site_id", "stat_time", "key", "requests"]


def edges_of(stat: StatDefinition) -> StatDefinition:
    """The definition under which a stat type's edges are stored."""
    return StatDefinition(f"{stat.stat_type}_edges", stat.range_ms)


def levels_and_edges(logs: DataFrame, stat: StatDefinition, levels: tuple[str, ...] = LEVELS) -> DataFrame:
    """The level rows of windows (``edge`` false) and of edges (true), of one pass over the hits."""
    return stats_all_levels(logs, stat, levels=levels, edges=True)


def coarsen(rows: DataFrame, fine: StatDefinition, coarse: StatDefinition) -> DataFrame:
    """Level rows with ``edge`` of short windows as those of longer ones. A
    partial aggregate runs before the exchange, so a key costs a row a task."""
    if coarse.range_ms % fine.range_ms:
        raise ValueError(f"{coarse.stat_type} is no multiple of {fine.stat_type}")
    begin = F.col("stat_time") - F.expr(f"INTERVAL {fine.range_ms} MILLISECONDS")
    around = F.window(begin, coarse.duration)  # of the short window's beginning
    moved = rows.withColumn("_w", around)
    edge = F.col("edge") & (begin == F.col("_w.start"))
    return (moved.withColumn("edge", edge).withColumn("stat_time", F.col("_w.end"))
            .groupBy("level", "site_id", "stat_time", "key", "edge")
            .agg(F.sum("requests").cast("bigint").alias("requests")).select(*_COLUMNS, "edge"))
