"""Hits bucketed and sorted by site, so that grouping by site needs no shuffle (A1).

The table is bucketed by ``(site_id, salt)`` and partitioned by day. A site
that holds more than a bucket's fair share of a write is dealt over as many
salts as it has shares; all others have salt ``-1``. So a site with a third
of all hits is read by many tasks, and of any other site one task sees all.

There are fewer hot sites than buckets, whatever the data: their list is
counted map-side and broadcast.

The files and the bucket layout are all that is stored. ``open`` puts the
table into the session's catalog (again), from its folder.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from . import sinks

COLD = -1
_BY = ("site_id", "salt")


@dataclass(frozen=True)
class BucketedLogs:
    spark: SparkSession
    path: str
    name: str
    buckets: int

    @staticmethod
    def open(spark: SparkSession, path: str, buckets: int, name: str | None = None) -> "BucketedLogs":
        """The table at a folder, whether it holds hits yet or not. A folder
        keeps the number of buckets it was first written with."""
        table = BucketedLogs(spark, path.rstrip("/"), name or f"bucketed_logs_{uuid.uuid4().hex}", buckets)
        columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schemas.LOGS.fields)
        spark.sql(f"CREATE TABLE {table.name} ({columns}, salt int, log_date date) USING parquet PARTITIONED BY (log_date) "
                  f"CLUSTERED BY ({', '.join(_BY)}) SORTED BY (site_id, log_time) INTO {buckets} BUCKETS LOCATION '{table.path}'")
        if sinks.exists(spark, table.path):
            spark.catalog.recoverPartitions(table.name)
        return table

    def salted(self, logs: DataFrame) -> DataFrame:
        """Hits with their salt: ``COLD``, or one of as many numbers as the
        site has bucket shares of these hits."""
        counts = logs.groupBy("site_id").agg(F.count(F.lit(1)).alias("n"))
        total = logs.count()
        # fewer than `buckets` sites can hold more than one share
        hot = (counts.where(F.col("n") * self.buckets > total)
               .select(F.col("site_id").alias("_hot"), F.ceil(F.col("n") * self.buckets / max(1, total)).cast("int").alias("_shares")))
        joined = logs.join(F.broadcast(hot), F.col("site_id").eqNullSafe(F.col("_hot")), "left")
        salt = F.when(F.col("_shares").isNull(), F.lit(COLD)).otherwise(
            F.pmod(F.xxhash64("log_id", "log_time", "url"), F.col("_shares")).cast("int"))
        return joined.withColumn("salt", salt).select(*schemas.LOGS.names, "salt", F.to_date("log_time").alias("log_date"))

    def write(self, logs: DataFrame) -> None:
        """Store hits; the days they hold are replaced as a whole."""
        rows = self.salted(schemas.conform(logs, schemas.LOGS))
        mode = self.spark.conf.get("spark.sql.sources.partitionOverwriteMode")
        self.spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
        try:  # one task a bucket writes one file a bucket and day
            rows.repartition(self.buckets, *_BY).write.mode("overwrite").insertInto(self.name)
        finally:
            self.spark.conf.set("spark.sql.sources.partitionOverwriteMode", mode)

    def read(self) -> DataFrame:
        return self.spark.table(self.name)
