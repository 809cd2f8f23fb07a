"""Load-test statistics over request outcomes (ts, status, outcome,
elapsed_ms): per period and overall.

Outcomes: ``ok`` (a response with a status), ``failed`` (sent, no response),
``dropped`` (queue full, never sent). Enqueued = ok + failed; total requests
= enqueued + dropped; the average time divides the summed times by the
number of timed requests (the same rows).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.windows import StatDefinition, with_window

# Fixed value: the load generator's report period.
REPORT_PERIOD = StatDefinition("5_seconds", 5_000)


def _counts():
    o = F.col("outcome")
    return [
        F.count_if(o.isin("ok", "failed")).alias("enqueued"),
        F.count_if(o == "dropped").alias("dropped"),
        F.count_if(o == "failed").alias("failed"),
        F.count_if(o == "ok").alias("responses"),
        F.min("elapsed_ms").alias("min_ms"),
        F.max("elapsed_ms").alias("max_ms"),
        F.coalesce(F.sum("elapsed_ms"), F.lit(0)).cast("bigint").alias("sum_ms"),
        F.count("elapsed_ms").alias("timed"),
    ]


def _finish(df: DataFrame) -> DataFrame:
    return (df.withColumn("total", F.col("enqueued") + F.col("dropped"))
              .withColumn("avg_ms", F.when(F.col("timed") > 0, F.expr("sum_ms div timed"))
                          .otherwise(F.lit(0)).cast("bigint")))


def load_stats_partial(outcomes: DataFrame, period: StatDefinition = REPORT_PERIOD) -> DataFrame:
    w = with_window(outcomes, "ts", period, closed_left=True, name="window_end")
    return _finish(w.groupBy("window_end").agg(*_counts()))


def load_stats_total(partial: DataFrame) -> DataFrame:
    """Overall figures out of the per-period ones (true minimum)."""
    agg = partial.agg(
        F.coalesce(F.sum("enqueued"), F.lit(0)).cast("bigint").alias("enqueued"),
        F.coalesce(F.sum("dropped"), F.lit(0)).cast("bigint").alias("dropped"),
        F.coalesce(F.sum("failed"), F.lit(0)).cast("bigint").alias("failed"),
        F.coalesce(F.sum("responses"), F.lit(0)).cast("bigint").alias("responses"),
        F.min("min_ms").alias("min_ms"), F.max("max_ms").alias("max_ms"),
        F.coalesce(F.sum("sum_ms"), F.lit(0)).cast("bigint").alias("sum_ms"),
        F.coalesce(F.sum("timed"), F.lit(0)).cast("bigint").alias("timed"))
    return _finish(agg)


def status_histograms(outcomes: DataFrame, period: StatDefinition = REPORT_PERIOD) -> DataFrame:
    """Responses by status code per period as a map (window_end, responses)."""
    w = with_window(outcomes.where(F.col("status").isNotNull()), "ts", period,
                    closed_left=True, name="window_end")
    counts = w.groupBy("window_end", "status").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("window_end").agg(
        F.map_from_entries(F.collect_list(F.struct("status", "n"))).alias("responses"))


def merge_histograms(maps: DataFrame, col: str = "responses") -> DataFrame:
    """Add histograms key by key: explode, then a hash aggregate per key."""
    e = maps.select(F.explode(F.col(col)).alias("status", "n"))
    return e.groupBy("status").agg(F.sum("n").cast("bigint").alias("responses"))
