"""Offset intervals written first, arrivals counted per window, both folded."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from hitlens.functions.windows import FIVE_MINUTES, ONE_DAY
from hitlens.plans import stats_job as job
from hitlens.plans.stats_job import StatsStore, run_statistics
from hitlens.sources import sinks
from hitlens.streaming import batch_index, ingest_stream
from hitlens.streaming.batch_index import merge_ranges
from hitlens.streaming.ingest_stream import arrivals, ingest_batch, late_windows, positions, stored_logs, to_raw_hits

KNOWN = "00000000-0000-4000-8000-000000000001"
BODY = '{"url":"/","ipAddress":"1.2.3.4","userAgent":"ua"}'


def messages(spark, offsets, partition=0, minutes=7):
    t0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    rows = [(KNOWN, BODY, partition, o, t0 + dt.timedelta(minutes=minutes * o, seconds=1)) for o in offsets]
    return to_raw_hits(spark.createDataFrame(rows, "key string, value string, partition int, offset long, timestamp timestamp"))


def sites(spark):
    return spark.createDataFrame([(KNOWN, "site-1")], "tracking_id string, site_id string")


def stored(spark, root):
    return sorted(r.log_id for r in stored_logs(spark, root).collect())


def test_merged_ranges(spark):
    rng = random.Random(4)
    rows = [(p, a := rng.randrange(200), a + rng.randrange(5)) for p in range(3) for _ in range(40)]
    want = []
    for p in range(3):
        held = sorted({o for q, a, b in rows if q == p for o in range(a, b + 1)})
        for o in held:
            if want and want[-1][0] == p and o == want[-1][2] + 1:
                want[-1][2] = o
            else:
                want.append([p, o, o])
    got = merge_ranges(spark.createDataFrame(rows, "partition int, first long, last long"))
    assert sorted(map(list, got.collect())) == want


@pytest.mark.parametrize("step", ["logs", "quarantine", "arrivals"])
def test_crash_between_writes_then_a_new_checkpoint_stores_each_hit_once(spark, scratch, monkeypatch, step):
    real = sinks.overwrite_folder

    def crash(df, path, *args, **kwargs):
        if f"/{step}/" in path:
            raise RuntimeError("crash")
        return real(df, path, *args, **kwargs)

    with monkeypatch.context() as m:
        m.setattr(sinks, "overwrite_folder", crash)
        with pytest.raises(RuntimeError):
            ingest_batch(messages(spark, range(5)), sites(spark), scratch, "old", 0)
    ingest_batch(messages(spark, range(3, 8)), sites(spark), scratch, "new", 0)
    ingest_batch(messages(spark, range(5)), sites(spark), scratch, "new", 1)
    assert stored(spark, scratch) == [f"0-{i}" for i in range(8)]
    # and the arrivals agree, also of the batch that crashed before they were counted
    ledger = spark.createDataFrame([("1_day", dt.datetime(2024, 1, 2), 8)], "stat_type string, stat_time timestamp_ntz, affected_records long")
    assert late_windows(spark, scratch, ledger, ONE_DAY).count() == 0


def test_reads_do_not_grow_with_the_number_of_batches(spark, scratch, monkeypatch):
    monkeypatch.setattr(batch_index, "FOLD", 4)
    monkeypatch.setattr(batch_index.BatchIndex.fold, "__defaults__", (4,))
    for b in range(12):
        ingest_batch(messages(spark, [2 * b, 2 * b + 1]), sites(spark), scratch, "run", b)
        for index in (positions(scratch), arrivals(scratch)):
            assert len(index.read(spark).inputFiles()) <= 6 + 1
    assert [tuple(r) for r in merge_ranges(positions(scratch).read(spark)).collect()] == [(0, 0, 23)]
    came = arrivals(scratch).read(spark).where("stat_type = '1_day'").agg(F.sum("hits")).first()[0]
    assert came == 24 == len(stored(spark, scratch))
    # a replay of the newest batch, and of everything under a new checkpoint
    ingest_batch(messages(spark, [22, 23]), sites(spark), scratch, "run", 11)
    ingest_batch(messages(spark, range(24)), sites(spark), scratch, "again", 0)
    assert len(stored(spark, scratch)) == 24 == arrivals(scratch).read(spark).where("stat_type = '1_day'").agg(F.sum("hits")).first()[0]


def test_a_crash_while_folding_changes_nothing(spark, scratch, monkeypatch):
    for b in range(4):
        ingest_batch(messages(spark, [b]), sites(spark), scratch, "run", b)
    rows = lambda: sorted(map(tuple, arrivals(scratch).merge(arrivals(scratch).read(spark)).collect()))
    want = rows()

    def crash(*_, **__):
        raise RuntimeError("crash")

    for name in ("commit_version", "remove_folders"):
        with monkeypatch.context() as m:
            m.setattr(sinks, name, crash)
            with pytest.raises(RuntimeError):
                arrivals(scratch).fold(spark, above=2)
        assert rows() == want
    arrivals(scratch).fold(spark, above=0)
    assert rows() == want


def test_late_windows_equal_the_rescan_and_read_no_logs(spark, scratch):
    root, store = scratch + "/in", StatsStore(scratch + "/stats")
    span = (dt.datetime(2024, 1, 1, 0, 5), dt.datetime(2024, 1, 1, 1))
    ingest_batch(messages(spark, range(6)), sites(spark), root, "run", 0)
    run_statistics(spark, stored_logs(spark, root), store, FIVE_MINUTES, *span)
    ingest_batch(messages(spark, range(3, 6), partition=1), sites(spark), root, "run", 1)  # late
    ledger = store.read(spark, "stats_reference")
    late = late_windows(spark, root, ledger, FIVE_MINUTES)
    want = job.stale_windows(spark, stored_logs(spark, root), store, FIVE_MINUTES, *span)
    assert sorted(map(tuple, late.collect())) == sorted(map(tuple, want.collect())) and late.count() == 3
    assert not any("/logs/" in f for f in late.inputFiles())
    job.repair(spark, stored_logs(spark, root), store, FIVE_MINUTES, *span)
    assert late_windows(spark, root, store.read(spark, "stats_reference"), FIVE_MINUTES).count() == 0
    assert ingest_stream.ARRIVAL_WINDOWS == (FIVE_MINUTES, ONE_DAY)
