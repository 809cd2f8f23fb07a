"""Streaming hit ingestion: broker messages -> decoded, resolved hits in
``logs``, rejects in a quarantine table.

The source is any streaming frame with (key, value, partition, offset,
timestamp) - the Kafka source's shape (``timestamp`` is the broker's
instant, a ``timestamp``); ``kafka_messages`` builds that source
when the Kafka package is on the classpath (it is not here, so that format
itself is untested), the tests use a file source of
the same schema. Delivery is at-least-once: a message is known by its
position (partition, offset), which is also its ``log_id``, and a position
that any batch has stored is not stored again, however late it comes. The
site registry is re-read for every micro-batch (no stale cache).
"""

from __future__ import annotations

import datetime as dt
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import DateType, StructField, StructType

from .. import schemas
from ..functions.timeid import ntz_from_ltz
from ..functions.windows import FIVE_MINUTES, ONE_DAY, StatDefinition
from ..operators import ingest as ing
from ..operators import stats as st
from ..session import staging
from ..sources import sinks
from .batch_index import BatchIndex, merge_ranges


def kafka_messages(spark: SparkSession, bootstrap: str, topic: str = "logs",
                   max_offsets_per_trigger: int | None = None) -> DataFrame:
    """Hit messages from a Kafka topic, from the earliest offset (needs the
    spark-sql-kafka package at runtime)."""
    reader = (spark.readStream.format("kafka")
              .option("kafka.bootstrap.servers", bootstrap)
              .option("subscribe", topic)
              .option("startingOffsets", "earliest"))
    if max_offsets_per_trigger:
        reader = reader.option("maxOffsetsPerTrigger", str(max_offsets_per_trigger))
    return reader.load().select(
        F.col("key").cast("string"), F.col("value").cast("string"), "partition", "offset",
        "timestamp")


def to_raw_hits(messages: DataFrame) -> DataFrame:
    """Message -> raw hit: key carries the tracking id, value the JSON body."""
    return messages.select(
        F.concat_ws("-", F.col("partition").cast("string"), F.col("offset").cast("string"))
        .alias("hit_id"),
        F.col("key").alias("tracking_id"), ntz_from_ltz(F.col("timestamp")).alias("log_time"),
        F.col("value").alias("body"), "partition", "offset")


STORED_POSITIONS = "partition int, offset long, ingest_run string, ingest_batch long"
# Windows whose arrivals are counted as hits are stored.
ARRIVAL_WINDOWS = (FIVE_MINUTES, ONE_DAY)


def positions(root: str) -> BatchIndex:
    """The offset ranges that batches set out to store, per topic partition:
    joined to as many intervals as there are gaps between them."""
    return BatchIndex(root, "positions", "partition int, first long, last long", merge_ranges)


def arrivals(root: str) -> BatchIndex:
    """Stored hits per window: what the ledger has to agree with."""
    return BatchIndex(root, "arrivals", "stat_type string, stat_time timestamp_ntz, hits long",
                      lambda rows: rows.groupBy("stat_type", "stat_time").agg(F.sum("hits").alias("hits")))


def _new_messages(raw: DataFrame, root: str, run: str, batch_id: int) -> DataFrame:
    """The batch's messages, one per position, without those that another
    batch (of this query or of any other on the same root) has stored.

    The ranges of ``positions`` only tell whether anything may have been
    delivered before: no, as long as messages come in order. If so, the stored
    rows themselves are looked up, by the offsets they lie between."""
    spark = raw.sparkSession
    once = raw.dropDuplicates(["partition", "offset"])
    known = positions(root).read(spark, without=(run, batch_id))
    mine = once.groupBy("partition").agg(F.min("offset").alias("low"), F.max("offset").alias("high"))
    overlap = (mine.join(known, "partition").where((F.col("first") <= F.col("high")) & (F.col("last") >= F.col("low")))
               .groupBy("partition").agg(F.greatest(F.min("first"), F.min("low")).alias("low"), F.least(F.max("last"), F.max("high")).alias("high"))
               .collect())  # at most one row a topic partition
    if not overlap:
        return once
    near = F.lit(False)
    for r in overlap:
        near = near | ((F.col("partition") == r.partition) & F.col("offset").between(r.low, r.high))
    own = (F.col("ingest_run") == run) & (F.col("ingest_batch") == batch_id)
    for table in ("logs", "quarantine"):
        stored = sinks.read_or_none(spark, f"{root}/{table}", STORED_POSITIONS)
        if stored is not None:
            once = once.join(stored.where(near & ~own).select("partition", "offset"), ["partition", "offset"], "left_anti")
    return once


def _arrivals_of(hits: DataFrame) -> DataFrame:
    """(stat_type, stat_time, hits) of stored hits, of every kind of window."""
    counts = [st.windowed(hits, stat).groupBy("stat_time").agg(F.count(F.lit(1)).alias("hits"))
              .select(F.lit(stat.stat_type).alias("stat_type"), "stat_time", "hits") for stat in ARRIVAL_WINDOWS]
    out = counts[0]
    for more in counts[1:]:
        out = out.unionByName(more)
    return out


def complete_arrivals(spark: SparkSession, root: str) -> None:
    """Count the arrivals of batches that a crash left without, from their own
    folders of ``logs``. Folder names alone are listed to find them."""
    index = arrivals(root)
    for run in sinks.children(spark, f"{root}/logs", "ingest_run="):
        for b in sinks.children(spark, f"{root}/logs/ingest_run={run}", "ingest_batch="):
            if not index.has(spark, run, int(b)):
                stored = spark.read.schema(schemas.LOGS).parquet(f"{root}/logs/ingest_run={run}/ingest_batch={b}")
                index.write(_arrivals_of(stored), run, int(b))


def late_windows(spark: SparkSession, root: str, ledger: DataFrame, stat: StatDefinition) -> DataFrame:
    """The finished windows whose stored hits are not what the ledger has
    (stat_type, stat_time, affected_records, hits): from the index of arrivals
    and the ledger alone, whatever the size of ``logs``. Equal to ``stale_windows``."""
    complete_arrivals(spark, root)
    came = (arrivals(root).read(spark).where(F.col("stat_type") == stat.stat_type)
            .groupBy("stat_time").agg(F.sum("hits").alias("hits")))
    done = ledger.where((F.col("stat_type") == stat.stat_type) & F.col("affected_records").isNotNull())
    return (done.join(came, "stat_time", "left").withColumn("hits", F.coalesce("hits", F.lit(0)))
            .where("hits <> affected_records").select("stat_type", "stat_time", "affected_records", "hits"))


def ingest_batch(raw: DataFrame, by_tracking: DataFrame, root: str, run: str, batch_id: int,
                 broadcast: bool = False, expiry: dt.timedelta | None = None) -> None:
    """Write one batch: its offset ranges to ``positions``, accepted hits to
    ``logs``, everything else with its reason to ``quarantine``, its hits
    per window to ``arrivals``.

    Each goes to the batch's own folder, which is replaced as a whole: a
    replay clears what it wrote before, also where it has nothing to write
    now. ``run`` is the query's id, so a new checkpoint writes beside the
    old one's batches, not over them. The ranges come first: after a crash
    at any later step another query finds that these positions may be
    stored, and looks. With ``expiry``, ``by_tracking`` holds validity
    intervals, and hits are resolved as of their own time."""
    own = f"ingest_run={run}/ingest_batch={batch_id}"
    spark = raw.sparkSession
    for index in (positions(root), arrivals(root)):
        index.fold(spark)
    with staging(spark) as stage:
        fresh = stage(_new_messages(raw, root, run, batch_id), "messages")
        ranges = fresh.groupBy("partition").agg(F.min("offset").alias("first"), F.max("offset").alias("last"))
        positions(root).write(ranges, run, batch_id)
        outcomes = stage(ing.ingest(fresh, by_tracking, broadcast=broadcast, expiry=expiry), "outcomes")
        good = (outcomes.where(F.col("outcome") == "accepted")
                .select("site_id", F.col("hit_id").alias("log_id"), "log_time", "url", "ip_address",
                        "user_agent", "partition", "offset", F.to_date("log_time").alias("log_date")))
        sinks.overwrite_folder(good.hint("rebalance", "log_date"), f"{root}/logs/{own}", ("log_date",))
        bad = (outcomes.where(F.col("outcome") != "accepted")
               .select("hit_id", "tracking_id", "log_time", "outcome", "status", "partition", "offset"))
        sinks.overwrite_folder(bad, f"{root}/quarantine/{own}")
        arrivals(root).write(_arrivals_of(good), run, batch_id)


def stored_logs(spark: SparkSession, root: str) -> DataFrame | None:
    """The ``logs`` table that the stream writes, with its ``log_date`` partition."""
    schema = StructType(schemas.LOGS.fields + [StructField("log_date", DateType())])
    return sinks.read_or_none(spark, f"{root}/logs", schema)


def stored_quarantine(spark: SparkSession, root: str) -> DataFrame | None:
    schema = "hit_id string, tracking_id string, log_time timestamp_ntz, outcome string, status int, partition int, offset long"
    return sinks.read_or_none(spark, f"{root}/quarantine", schema)


def start_ingest_stream(messages: DataFrame, registry: Callable[[], DataFrame], root: str,
                        checkpoint: str, trigger: dict | None = None,
                        broadcast: bool = False, expiry: dt.timedelta | None = None) -> StreamingQuery:
    """``registry()`` returns the current tracking registry, or with
    ``expiry`` its validity intervals; it is called
    once per micro-batch (``broadcast``: it is known to be small). Messages
    are taken whenever they come: there is no time after which a first
    delivery is dropped."""
    raw, root = to_raw_hits(messages), root.rstrip("/")

    def per_batch(batch: DataFrame, epoch_id: int) -> None:
        run = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        ingest_batch(batch, registry(), root, run, epoch_id, broadcast, expiry)

    writer = (raw.writeStream.outputMode("append").foreachBatch(per_batch)
              .option("checkpointLocation", checkpoint))
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def publish(hits: DataFrame, partitions: int, key: str = "tracking_id", topic: str = "logs") -> DataFrame:
    """Accepted requests as messages spread round-robin over ``partitions``
    (the frame a Kafka sink takes: topic, key, value, partition)."""
    body = F.to_json(F.struct(F.col("url"), F.col("ip_address").alias("ipAddress"),
                              F.col("user_agent").alias("userAgent")))
    spread = hits.repartition(partitions)
    return spread.select(F.lit(topic).alias("topic"), F.col(key).alias("key"), body.alias("value"),
                         F.spark_partition_id().alias("partition"))


def write_messages(messages: DataFrame, fmt: str = "kafka", **options: str) -> None:
    """Send published messages: to Kafka with its package and
    ``kafka.bootstrap.servers``, or to any other format and path."""
    messages.write.format(fmt).mode("append").options(**options).save()
