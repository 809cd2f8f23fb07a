"""Streaming statistics: the same windows and tables as the batch job.

Hits are expanded into their four level rows (site, url, ip, browser) and
counted per (window, site, level, key) with a watermark, in **append** mode:
a window is emitted once, complete, after the watermark passes its end. Each
micro-batch is then written with the batch sinks (dynamic overwrite of the
window's partitions, ledger last), so a replayed micro-batch rewrites the
same partitions instead of adding to them. Hits behind the watermark are
not counted here (the query progress has their number,
``numRowsDroppedByWatermark``); they are in ``logs``, so ``stale_windows`` of
the batch job lists their windows and ``repair`` computes these again.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.timeid import ltz_from_ntz, ntz_from_ltz
from ..functions.windows import FIVE_MINUTES, StatDefinition
from ..session import staging


def level_counts(hits: DataFrame, stat: StatDefinition, watermark: str) -> DataFrame:
    """Streaming aggregate (window, site_id, level, key, requests). The
    watermark runs on the instant of ``log_time`` (UTC wall clock)."""
    w = F.window(F.col("_event_time"), stat.duration)
    rows = F.array(
        F.struct(F.lit("site").alias("level"), F.lit(None).cast("string").alias("key")),
        F.struct(F.lit("url").alias("level"), F.col("url").alias("key")),
        F.struct(F.lit("ip").alias("level"), F.col("ip_address").alias("key")),
        F.struct(F.lit("browser").alias("level"), F.col("user_agent").alias("key")))
    expanded = (hits.withColumn("_event_time", ltz_from_ntz(F.col("log_time")))
                .withWatermark("_event_time", watermark)
                .where(F.col("_event_time") >= w.start + F.expr("INTERVAL 1 MILLISECOND"))
                .select(w.alias("window"), "site_id", F.explode(rows).alias("lv")))
    return (expanded.groupBy("window", "site_id", F.col("lv.level").alias("level"),
                             F.col("lv.key").alias("key"))
            .agg(F.count(F.lit(1)).alias("requests")))


def write_levels_batch(levels: DataFrame, stat: StatDefinition, root: str,
                       fragments: int | None = None,
                       base_type: str = FIVE_MINUTES.stat_type) -> None:
    """Write one micro-batch of finished windows with the batch job's
    writers: partials, ledger last.

    Windows are emitted in order, so a window without hits before the last
    one emitted will never come: it gets its ledger row (0) here, as in the
    batch job.
    """
    from ..plans import stats_job as job

    spark, store = levels.sparkSession, job.StatsStore(root)
    store.record_base(spark, base_type)
    with staging(spark) as stage:
        levels = stage(levels, "levels")
        counts = (levels.where(F.col("level") == "site").groupBy("stat_time")
                  .agg(F.sum("requests").cast("bigint").alias("n")))
        first, last = counts.agg(F.min("stat_time"), F.max("stat_time")).first()
        if last is None:
            return
        newest = job.newest_window(spark, store, stat, first)  # from the last window that the ledger has
        first = first if newest is None else newest + dt.timedelta(milliseconds=stat.range_ms)
        days = job.days_between(first, last)
        due = job._calendar(spark, stat, first, last)
        done = job.done_windows(spark, store, stat, days)
        emitted = counts.select("stat_time")
        if done is not None:  # what this batch emits is written again when it is replayed
            due = due.join(done.join(emitted, "stat_time", "left_anti"), ["stat_type", "stat_time"], "left_anti")
        ledger = stage(due.join(counts, "stat_time", "left")
                       .select("stat_type", "stat_time", F.coalesce("n", F.lit(0)).alias("affected_records")), "counts")
        job.write_windows(spark, levels, ledger, stat, store, days, fragments)
        job.write_ledger(spark, store, stat, ledger, days)


def start_stats_stream(hits: DataFrame, stat: StatDefinition, root: str, checkpoint: str,
                       watermark: str = "10 minutes", trigger: dict | None = None,
                       fragments: int | None = None,
                       base_type: str = FIVE_MINUTES.stat_type) -> StreamingQuery:
    """Start the streaming statistics query over a streaming ``logs`` frame."""
    counts = level_counts(hits, stat, watermark)

    def per_batch(batch: DataFrame, epoch_id: int) -> None:
        levels = batch.select("level", "site_id", ntz_from_ltz(F.col("window.end")).alias("stat_time"),
                              "key", "requests")
        write_levels_batch(levels, stat, root, fragments, base_type)

    writer = (counts.writeStream.outputMode("append").foreachBatch(per_batch)
              .option("checkpointLocation", checkpoint))
    writer = writer.trigger(**(trigger or {"availableNow": True}))
    return writer.start()
