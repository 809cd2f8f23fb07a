"""Session helpers: a tuned builder for local runs and the checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings every job in this package assumes. AQE re-plans joins and shuffle
# partition counts from runtime sizes and splits skewed join partitions.
# Broadcasts are decided on *measured* sizes only: the static planner's
# estimate (file size x column share) undershoots computed columns such as
# text ids several times, so it never broadcasts; AQE turns a shuffled join
# into a broadcast once the materialised side is under 10 MB.
DEFAULT_CONF = {
    "spark.ui.enabled": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "10485760",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # streaming state off the JVM heap, checkpointed incrementally
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def get_session(master: str = "local[*]", shuffle_partitions: int = 8,
                app_name: str = "hitlens", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.master(master).appName(app_name)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder the cluster names in
    ``spark.checkpoint.dir``; only when it is unset in a local session
    (tests) a fresh scratch folder is created and registered."""
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir: executors do not share a machine-local folder")
        configured = tempfile.mkdtemp(prefix="hitlens-ckpt-")
    spark.sparkContext.setCheckpointDir(configured)
    return spark.sparkContext.getCheckpointDir() or configured


@contextmanager
def staging(spark: SparkSession):
    """Give ``stage(df, name)``, which cuts lineage by writing ``df`` as
    Parquet under the shared checkpoint folder and reading it back; the
    folder is removed at the end of the block, also after an error.

    One pass (an eager RDD checkpoint computes the plan twice and stores
    serialized rows); the staged copy is columnar, so later readers prune
    columns and push filters. Survives the loss of executors like any table.
    """
    folder = f"{checkpoint_dir(spark).rstrip('/')}/hitlens-stage-{uuid.uuid4().hex}"

    def stage(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    try:
        yield stage
    finally:
        from .sources.sinks import remove

        remove(spark, folder)
