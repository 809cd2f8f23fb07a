import datetime as dt

from pyspark.sql import functions as F

from hitlens import schemas
from hitlens.functions.timeid import time_uuid, uuid_from_text
from hitlens.functions.windows import FIVE_MINUTES
from hitlens.operators import registry as reg
from hitlens.operators import stats as st
from hitlens.sources import model
from hitlens.streaming.ingest_stream import publish

from .conftest import SF001


def test_calendar_blocks_equal_plain_sequence(spark):
    first, last = dt.datetime(2024, 1, 1, 0, 5), dt.datetime(2024, 1, 12, 0, 0)
    bounds = spark.createDataFrame([(first, last)], "first timestamp_ntz, last timestamp_ntz")
    got = [r.stat_time for r in st.calendar(bounds, FIVE_MINUTES).collect()]
    n = int((last - first) / dt.timedelta(minutes=5)) + 1
    assert n > 3 * st.CALENDAR_BLOCK
    assert sorted(got) == [first + i * dt.timedelta(minutes=5) for i in range(n)]


def test_table_order_and_conform(spark):
    names = [n for n, _ in schemas.TABLES]
    assert names == ["users_by_id", "users_by_credentials", "sites_by_id", "sites_by_tracking_id",
                     "sites_by_users", "logs", "partial_stats", "partial_stats_url", "global_stats",
                     "global_stats_url", "stats_reference"]
    lg = schemas.conform(model.logs(spark, SF001), schemas.LOGS)
    assert lg.schema == schemas.LOGS


def test_publish_spreads_round_robin(spark):
    hits = model.logs(spark, SF001).withColumn("tracking_id", uuid_from_text(F.col("site_id")))
    msgs = publish(hits, 3)
    parts = {r.partition: r.n for r in msgs.groupBy("partition").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert sorted(parts) == [0, 1, 2] and msgs.columns == ["topic", "key", "value", "partition"]
    assert max(parts.values()) - min(parts.values()) <= 1
    body = msgs.select(F.from_json("value", schemas.HIT_BODY).alias("b")).where(F.col("b.userAgent").isNull())
    assert body.count() == 0


def test_new_sites_fan_out(spark):
    req = spark.createDataFrame(
        [(1, "00000000-0000-1000-8000-000000000001", "example.com"),
         (2, "00000000-0000-1000-8000-000000000001", "another-example.com"),
         (3, "not-an-id", "bad.com")], "request_id long, user_id string, domain string")
    ts = F.lit(dt.datetime(2024, 1, 1)).cast("timestamp_ntz")
    sites = reg.new_sites(req, time_uuid(ts, F.col("request_id")), uuid_from_text(F.col("request_id")))
    assert sites.count() == 2
    assert reg.sites_by_users(sites).select("site_id").distinct().count() == 2
    assert reg.sites_by_tracking_id(sites).count() == 2


def test_stored_logs_prune_days(spark, scratch):
    path = scratch + "/logs"
    model.logs(spark, SF001).withColumn("log_date", F.to_date("log_time")).write.partitionBy("log_date").parquet(path)
    stored = spark.read.parquet(path)
    from hitlens.plans import stats_job
    src = stored.where((F.col("log_time") >= F.lit(dt.datetime(2024, 1, 3)).cast("timestamp_ntz"))
                       & (F.col("log_date").between(F.lit(dt.date(2024, 1, 3)), F.lit(dt.date(2024, 1, 4)))))
    plan = src._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(log_date" in plan
    assert stats_job is not None
