import datetime as dt
import os

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from hitlens import schemas
from hitlens.functions.windows import ONE_DAY
from hitlens.operators import ingest as ing
from hitlens.operators import stats as st
from hitlens.sources import model
from hitlens.plans import stats_job
from hitlens.streaming.ingest_stream import start_ingest_stream, stored_logs, stored_quarantine, write_messages
from hitlens.streaming.stats_stream import start_stats_stream

from .conftest import SF001


def _write_chunk(pdf, path):
    table = pa.Table.from_pandas(pdf, preserve_index=False)
    pq.write_table(table, path, coerce_timestamps="us", allow_truncated_timestamps=True)


def _chunks(spark, n=3):
    pdf = model.logs(spark, SF001).orderBy("log_time").toPandas()
    size = (len(pdf) + n - 1) // n
    return [pdf.iloc[i * size:(i + 1) * size] for i in range(n)], pdf


def _sentinel(pdf, when):
    s = pdf.iloc[:1].copy()
    s["log_time"] = when
    s["log_id"] = "sentinel"
    return s


def _stream(spark, src, root, ckpt, watermark="1 hour"):
    hits = (spark.readStream.schema(schemas.LOGS).option("maxFilesPerTrigger", 1).parquet(src))
    q = start_stats_stream(hits, ONE_DAY, root, ckpt, watermark=watermark)
    q.awaitTermination(300)
    return q


def _table(spark, root, name, schema):
    from hitlens.plans.stats_job import StatsStore
    return schemas.conform(StatsStore(root).table(spark, name), schema)


def _stored(spark, root):
    return stored_logs(spark, root), stored_quarantine(spark, root)


def test_stream_equals_batch_and_restart(spark, scratch):
    src, root, ckpt = (os.path.join(scratch, d) for d in ("src", "out", "ckpt"))
    os.makedirs(src)
    chunks, pdf = _chunks(spark)
    _write_chunk(chunks[0], os.path.join(src, "c0.parquet"))
    _write_chunk(chunks[1], os.path.join(src, "c1.parquet"))
    _stream(spark, src, root, ckpt)
    # restart from the checkpoint with the third file and a sentinel that
    # moves the watermark past the last day
    _write_chunk(chunks[2], os.path.join(src, "c2.parquet"))
    _write_chunk(_sentinel(pdf, dt.datetime(2024, 6, 1)), os.path.join(src, "c3.parquet"))
    _stream(spark, src, root, ckpt)

    batch_logs = model.logs(spark, SF001)
    for name, schema, direct in (
            ("partial_stats_requests", schemas.PARTIAL_STATS_REQUESTS, st.partial_stats_requests(batch_logs, ONE_DAY)),
            ("partial_stats_url", schemas.PARTIAL_STATS_URL, st.partial_stats_url(batch_logs, ONE_DAY)),
            ("partial_stats_ip", schemas.PARTIAL_STATS_IP, st.partial_stats_ip(batch_logs, ONE_DAY))):
        got = _table(spark, root, name, schema)
        assert got.exceptAll(direct).count() == 0, name
        assert direct.exceptAll(got).count() == 0, name
    ledger = _table(spark, root, "stats_reference", schemas.STATS_REFERENCE)
    assert ledger.agg(F.sum("affected_records")).first()[0] == st.windowed(batch_logs, ONE_DAY).count()


def test_late_rows_dropped_and_counted(spark, scratch):
    src, root, ckpt = (os.path.join(scratch, d) for d in ("src", "out", "ckpt"))
    os.makedirs(src)
    chunks, pdf = _chunks(spark, 2)
    _write_chunk(chunks[0], os.path.join(src, "c0.parquet"))
    _write_chunk(chunks[1], os.path.join(src, "c1.parquet"))
    late = _sentinel(pdf, dt.datetime(2024, 1, 1, 12))
    late["log_id"] = "late"
    _write_chunk(late, os.path.join(src, "c2.parquet"))
    q = _stream(spark, src, root, ckpt, watermark="1 hour")
    dropped = sum(op.get("numRowsDroppedByWatermark", 0)
                  for p in q.recentProgress for op in p.get("stateOperators", []))
    # counted per operator row: the late hit is four level rows there
    assert dropped >= 1
    ledger = _table(spark, root, "stats_reference", schemas.STATS_REFERENCE)
    first_day = ledger.where(F.col("stat_time") == dt.datetime(2024, 1, 2)).first()
    expected = st.windowed(model.logs(spark, SF001), ONE_DAY).where(
        F.col("stat_time") == dt.datetime(2024, 1, 2)).count()
    assert first_day.affected_records == expected
    # the account of late hits, and their windows computed again
    store, logs = stats_job.StatsStore(root), spark.read.schema(schemas.LOGS).parquet(src)
    span = (dt.datetime(2024, 1, 2), ledger.agg(F.max("stat_time")).first()[0])
    late_windows = stats_job.stale_windows(spark, logs, store, ONE_DAY, *span).collect()
    assert [(r.stat_time, r.hits - r.affected_records) for r in late_windows] == [(dt.datetime(2024, 1, 2), 1)]
    assert stats_job.repair(spark, logs, store, ONE_DAY, *span) == 1
    assert stats_job.stale_windows(spark, logs, store, ONE_DAY, *span).count() == 0
    assert store.table(spark, "stats_reference").where(F.col("stat_time") == dt.datetime(2024, 1, 2)).first().affected_records == expected + 1


def test_ingest_stream_dedupes_redelivery(spark, scratch):
    src, root, ckpt = (os.path.join(scratch, d) for d in ("src", "out", "ckpt"))
    os.makedirs(src)
    raw = model.raw_hits(spark, SF001)
    msgs = raw.select(F.col("tracking_id").alias("key"), F.col("body").alias("value"),
                      F.lit(0).alias("partition"), F.col("hit_id").cast("bigint").alias("offset"),
                      F.col("log_time").alias("timestamp")).orderBy("offset").toPandas()
    msgs["partition"] = msgs["partition"].astype("int32")
    msgs["timestamp"] = msgs["timestamp"].dt.tz_localize("UTC")
    half = len(msgs) // 2
    _write_chunk(msgs.iloc[:half], os.path.join(src, "m0.parquet"))
    # the second file redelivers every 10th message of the first
    again = msgs.iloc[:half][msgs.iloc[:half]["offset"] % 10 == 0]
    _write_chunk(__import__("pandas").concat([msgs.iloc[half:], again]), os.path.join(src, "m1.parquet"))
    stream = spark.readStream.schema(schemas.MESSAGES).option("maxFilesPerTrigger", 1).parquet(src)
    q = start_ingest_stream(stream, lambda: model.sites_by_tracking(spark, SF001), root, ckpt)
    q.awaitTermination(300)
    logs, quarantine = _stored(spark, root)
    batch = ing.ingest(raw, model.sites_by_tracking(spark, SF001))
    accepted = batch.where(F.col("outcome") == "accepted")
    assert logs.count() == accepted.count()
    assert logs.select("log_id").distinct().count() == logs.count()
    assert quarantine.count() == batch.count() - accepted.count()


def test_stream_keeps_running_totals(spark, scratch):
    src, root, ckpt = (os.path.join(scratch, d) for d in ("src", "out", "ckpt"))
    os.makedirs(src)
    chunks, pdf = _chunks(spark, 2)
    _write_chunk(chunks[0], os.path.join(src, "c0.parquet"))
    _write_chunk(chunks[1], os.path.join(src, "c1.parquet"))
    _write_chunk(_sentinel(pdf, dt.datetime(2024, 6, 1)), os.path.join(src, "c2.parquet"))
    hits = spark.readStream.schema(schemas.LOGS).option("maxFilesPerTrigger", 1).parquet(src)
    start_stats_stream(hits, ONE_DAY, root, ckpt, watermark="1 hour",
                       base_type=ONE_DAY.stat_type).awaitTermination(300)
    got = _table(spark, root, "global_stats", schemas.GLOBAL_STATS)
    expected = st.global_stats(st.partial_stats_requests(model.logs(spark, SF001), ONE_DAY), ONE_DAY.stat_type)
    assert got.exceptAll(expected).count() == 0 and expected.exceptAll(got).count() == 0


def _messages(rows):
    import pandas as pd
    pdf = pd.DataFrame(rows, columns=["key", "value", "partition", "offset", "timestamp"])
    pdf["partition"] = pdf["partition"].astype("int32")
    pdf["timestamp"] = pd.to_datetime(pdf["timestamp"]).dt.tz_localize("UTC")
    return pdf


def test_ingest_restart_and_registry_refresh(spark, scratch):
    src, root, ckpt, regp = (os.path.join(scratch, d) for d in ("src", "out", "ckpt", "reg"))
    os.makedirs(src)
    known, later = "00000000-0000-4000-8000-000000000001", "00000000-0000-4000-8000-000000000002"
    body = '{"url":"/","ipAddress":"1.2.3.4","userAgent":"ua"}'
    t = dt.datetime(2024, 1, 1)
    spark.createDataFrame([(known, "site-1")], "tracking_id string, site_id string") \
        .write.mode("overwrite").parquet(regp)
    _write_chunk(_messages([(known, body, 0, 0, t), (later, body, 0, 1, t)]), os.path.join(src, "m0.parquet"))

    def run():
        stream = spark.readStream.schema(schemas.MESSAGES).option("maxFilesPerTrigger", 1).parquet(src)
        start_ingest_stream(stream, lambda: spark.read.parquet(regp), root, ckpt).awaitTermination(300)

    run()
    # the second site registers; a redelivery of offset 0 and a new hit of it follow
    spark.createDataFrame([(known, "site-1"), (later, "site-2")], "tracking_id string, site_id string") \
        .write.mode("overwrite").parquet(regp)
    _write_chunk(_messages([(known, body, 0, 0, t), (later, body, 0, 2, t)]), os.path.join(src, "m1.parquet"))
    run()
    logs, quarantine = _stored(spark, root)
    assert {r.log_id: r.site_id for r in logs.collect()} == {"0-0": "site-1", "0-2": "site-2"}
    q = {r.hit_id: r.status for r in quarantine.collect()}
    assert q == {"0-1": 404}


KNOWN, LATER = "00000000-0000-4000-8000-000000000001", "00000000-0000-4000-8000-000000000002"
BODY = '{"url":"/","ipAddress":"1.2.3.4","userAgent":"ua"}'
T0 = dt.datetime(2024, 1, 1)


def _ingest(spark, src, root, ckpt, sites=((KNOWN, "site-1"),), per_trigger=1):
    reg = spark.createDataFrame(list(sites), "tracking_id string, site_id string")
    stream = spark.readStream.schema(schemas.MESSAGES).option("maxFilesPerTrigger", per_trigger).parquet(src)
    start_ingest_stream(stream, lambda: reg, root, ckpt).awaitTermination(300)


def test_lagging_partition_loses_nothing(spark, scratch):
    """Default settings: 6 messages of one partition, then 7 that are two hours older, of another."""
    src, root, ckpt = (os.path.join(scratch, d) for d in ("src", "out", "ckpt"))
    os.makedirs(src)
    _write_chunk(_messages([(KNOWN, BODY, 0, i, T0) for i in range(6)]), os.path.join(src, "m0.parquet"))
    old = T0 - dt.timedelta(hours=2)
    _write_chunk(_messages([(KNOWN if i % 2 else LATER, BODY, 1, i, old) for i in range(7)]), os.path.join(src, "m1.parquet"))
    _ingest(spark, src, root, ckpt)
    logs, quarantine = _stored(spark, root)
    assert logs.count() == 6 + 3 and quarantine.count() == 4


def test_new_checkpoint_and_second_query_keep_stored_hits(spark, scratch):
    src, other, root = (os.path.join(scratch, d) for d in ("src", "other", "out"))
    os.makedirs(src), os.makedirs(other)
    _write_chunk(_messages([(KNOWN, BODY, 0, i, T0) for i in range(5)]), os.path.join(src, "m0.parquet"))
    _ingest(spark, src, root, os.path.join(scratch, "c0"))
    _write_chunk(_messages([(KNOWN, BODY, 0, i, T0) for i in range(5, 10)]), os.path.join(other, "m0.parquet"))
    _ingest(spark, other, root, os.path.join(scratch, "c1"))
    assert stored_logs(spark, root).count() == 10
    # all of it read again under a third checkpoint: every position is known
    _ingest(spark, src, root, os.path.join(scratch, "c2"))
    logs = stored_logs(spark, root)
    assert logs.count() == 10 and logs.select("log_id").distinct().count() == 10


def test_replay_after_a_registry_change_leaves_one_place(spark, scratch):
    from hitlens.streaming.ingest_stream import ingest_batch, to_raw_hits

    raw = to_raw_hits(spark.createDataFrame([(KNOWN, BODY, 0, 0, T0), (LATER, BODY, 0, 1, T0)],
                                            "key string, value string, partition int, offset long, timestamp timestamp"))
    reg = lambda *ids: spark.createDataFrame([(i, "s") for i in ids], "tracking_id string, site_id string")
    places = lambda: [sorted(x) for x in (
        [r.log_id for r in stored_logs(spark, scratch).collect()], [r.hit_id for r in stored_quarantine(spark, scratch).collect()])]
    ingest_batch(raw, reg(KNOWN, LATER), scratch, "run", 0)
    assert places() == [["0-0", "0-1"], []]
    ingest_batch(raw, reg(KNOWN), scratch, "run", 0)
    assert places() == [["0-0"], ["0-1"]]
    ingest_batch(raw, reg("x"), scratch, "run", 0)
    assert places() == [[], ["0-0", "0-1"]]


def test_stream_ledger_has_empty_windows(spark, scratch):
    from hitlens.functions.windows import FIVE_MINUTES

    from .conftest import hits_frame, ts

    src, root, ckpt = (os.path.join(scratch, d) for d in ("src", "out", "ckpt"))
    rows = [("s1", ts(2024, 1, 1, 0, 1), "/a", "1", "x"), ("s1", ts(2024, 1, 1, 0, 21), "/a", "1", "x")]
    hits = hits_frame(spark, rows)
    hits.coalesce(1).write.parquet(src)
    sentinel = hits_frame(spark, [("s1", ts(2024, 1, 1, 3), "/a", "1", "x")])
    sentinel.coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(schemas.LOGS).parquet(src)
    start_stats_stream(stream, FIVE_MINUTES, root, ckpt).awaitTermination(300)
    got = {(r.stat_time, r.affected_records) for r in stats_job.StatsStore(root).table(spark, "stats_reference").collect()}
    store = stats_job.StatsStore(root + "-batch")
    stats_job.run_statistics(spark, hits, store, FIVE_MINUTES, ts(2024, 1, 1, 0, 5), ts(2024, 1, 1, 0, 25))
    assert got == {(r.stat_time, r.affected_records) for r in store.table(spark, "stats_reference").collect()}
    assert {t.minute: n for t, n in got} == {5: 1, 10: 0, 15: 0, 20: 0, 25: 1}


def test_messages_are_written(spark, scratch):
    from hitlens.streaming.ingest_stream import publish

    hits = spark.createDataFrame([("k", "/", "1", "a")], "tracking_id string, url string, ip_address string, user_agent string")
    write_messages(publish(hits, 2, topic="t"), "parquet", path=scratch + "/out")
    assert [(r.topic, r.key) for r in spark.read.parquet(scratch + "/out").collect()] == [("t", "k")]
