import datetime as dt
from collections import Counter

import pytest
from pyspark.sql import functions as F

from hitlens import schemas
from hitlens.functions.windows import FIVE_MINUTES, ONE_DAY
from hitlens.operators import stats as st
from hitlens.plans import stats_job
from hitlens.plans.stats_job import StatsStore, run_statistics
from hitlens.sources import model, sinks

from .conftest import SF001, hits_frame, ts


def _rows():
    return [("s1", ts(2024, 1, 1, 0, 1), "/a", "1", "x"), ("s1", ts(2024, 1, 1, 0, 2), "/b", "2", "x"),
            ("s2", ts(2024, 1, 1, 0, 7), "/a", "1", "y"), ("s1", ts(2024, 1, 1, 0, 21), "/a", "1", "x")]


def _snapshot(spark, store):
    out = {}
    for t, schema in (("partial_stats_requests", schemas.PARTIAL_STATS_REQUESTS),
                      ("partial_stats_url", schemas.PARTIAL_STATS_URL),
                      ("partial_stats_ip", schemas.PARTIAL_STATS_IP),
                      ("partial_stats_browser", schemas.PARTIAL_STATS_BROWSER),
                      ("global_stats", schemas.GLOBAL_STATS),
                      ("global_stats_url", schemas.GLOBAL_STATS_URL),
                      ("stats_reference", schemas.STATS_REFERENCE)):
        df = schemas.conform(store.table(spark, t), schema)
        out[t] = sorted(tuple(str(v) for v in r) for r in df.collect())
    return out


def test_tick_backfill_and_rerun(spark, scratch):
    store = StatsStore(scratch)
    hits = hits_frame(spark, _rows())
    first, last = dt.datetime(2024, 1, 1, 0, 5), dt.datetime(2024, 1, 1, 0, 25)
    assert run_statistics(spark, hits, store, FIVE_MINUTES, first, last) == 5
    snap = _snapshot(spark, store)
    ledger = {(r[1], r[2]) for r in snap["stats_reference"]}
    assert {r[0] for r in snap["stats_reference"]} == {"5_minutes"}
    assert ledger == {("2024-01-01 00:05:00", "2"), ("2024-01-01 00:10:00", "1"),
                      ("2024-01-01 00:15:00", "0"), ("2024-01-01 00:20:00", "0"),
                      ("2024-01-01 00:25:00", "1")}
    totals = {r[0]: r[1] for r in snap["global_stats"]}
    assert totals == {"s1": "3", "s2": "1"}
    # everything is in the ledger: a second run does nothing and changes nothing
    assert run_statistics(spark, hits, store, FIVE_MINUTES, first, last) == 0
    assert _snapshot(spark, store) == snap


def test_crash_after_partials_then_rerun(spark, scratch):
    store = StatsStore(scratch)
    hits = hits_frame(spark, _rows())
    # partials written, ledger not (a crash between the two)
    levels = st.stats_all_levels(hits, FIVE_MINUTES)
    sinks.overwrite_partitions(st.long_form(levels, FIVE_MINUTES), store.path("stats_levels"))
    run_statistics(spark, hits, store, FIVE_MINUTES, dt.datetime(2024, 1, 1, 0, 5),
                   dt.datetime(2024, 1, 1, 0, 25))
    totals = {r.site_id: r.requests for r in store.table(spark, "global_stats").collect()}
    assert totals == {"s1": 3, "s2": 1}
    req = store.table(spark, "partial_stats_requests")
    assert req.agg(F.sum("requests")).first()[0] == 4


def test_two_schedules_do_not_double_totals(spark, scratch):
    store = StatsStore(scratch)
    hits = hits_frame(spark, _rows())
    run_statistics(spark, hits, store, FIVE_MINUTES, dt.datetime(2024, 1, 1, 0, 5),
                   dt.datetime(2024, 1, 1, 0, 25))
    run_statistics(spark, hits, store, ONE_DAY, dt.datetime(2024, 1, 2), dt.datetime(2024, 1, 2))
    totals = {r.site_id: r.requests for r in store.table(spark, "global_stats").collect()}
    assert totals == {"s1": 3, "s2": 1}
    ledger = store.table(spark, "stats_reference")
    assert ledger.where(F.col("stat_type") == "1_day").first().affected_records == 4


def test_job_on_driver_tables_equals_queries(spark, scratch):
    store = StatsStore(scratch)
    logs = model.logs(spark, SF001)
    b = logs.agg(F.min("log_time"), F.max("log_time")).first()
    first = dt.datetime(b[0].year, b[0].month, b[0].day) + dt.timedelta(days=1)
    last = dt.datetime(b[1].year, b[1].month, b[1].day) + dt.timedelta(days=1)
    run_statistics(spark, logs, store, ONE_DAY, first, last)
    written = store.table(spark, "partial_stats_url").select(
        "site_id", "year", "stat_time", "stat_type", "url", "requests")
    direct = st.partial_stats_url(logs, ONE_DAY)
    assert written.exceptAll(direct).count() == 0 and direct.exceptAll(written).count() == 0
    # the map table partitioned the same way, one row per site and day
    ps = store.table(spark, "partial_stats")
    assert ps.count() == st.partial_stats_requests(logs, ONE_DAY).count()


def test_totals_across_separate_days(spark, scratch):
    rows = _rows() + [("s2", ts(2024, 1, 2, 0, 1), "/a", "1", "y"), ("s3", ts(2024, 1, 2, 0, 3), "/c", "4", "z")]
    hits = hits_frame(spark, rows)
    store = StatsStore(scratch)
    run_statistics(spark, hits, store, FIVE_MINUTES, dt.datetime(2024, 1, 1, 0, 5), dt.datetime(2024, 1, 1, 0, 25))
    run_statistics(spark, hits, store, FIVE_MINUTES, dt.datetime(2024, 1, 2, 0, 5), dt.datetime(2024, 1, 2, 0, 5))
    totals = {r.site_id: r.requests for r in store.table(spark, "global_stats").collect()}
    assert totals == {"s1": 3, "s2": 2, "s3": 1}
    urls = {(r.site_id, r.url): r.requests for r in store.table(spark, "global_stats_url").collect()}
    assert urls[("s2", "/a")] == 2 and urls[("s3", "/c")] == 1


def test_empty_first_tick(spark, scratch):
    store, hits = StatsStore(scratch), hits_frame(spark, _rows())
    day = dt.datetime(2024, 3, 1)
    assert run_statistics(spark, hits, store, FIVE_MINUTES, day, day) == 1
    assert [(r.stat_time, r.affected_records) for r in store.table(spark, "stats_reference").collect()] == [(day, 0)]
    assert run_statistics(spark, hits, store, FIVE_MINUTES, dt.datetime(2024, 1, 1, 0, 5), dt.datetime(2024, 1, 1, 0, 5)) == 1
    assert {r.site_id: r.requests for r in store.table(spark, "global_stats").collect()} == {"s1": 2}


def test_range_off_the_grid_is_refused(spark, scratch):
    store, hits = StatsStore(scratch), hits_frame(spark, _rows())
    run_statistics(spark, hits, store, FIVE_MINUTES, dt.datetime(2024, 1, 1, 0, 5), dt.datetime(2024, 1, 1, 0, 5))
    before = _snapshot(spark, store)
    for ends in ((7, 12), (5, 12), (7, 10)):
        with pytest.raises(ValueError):
            run_statistics(spark, hits, store, FIVE_MINUTES, *(dt.datetime(2024, 1, 1, 0, m) for m in ends))
    assert _snapshot(spark, store) == before


def test_window_that_became_empty_is_cleared(spark, scratch):
    store, span = StatsStore(scratch), (dt.datetime(2024, 1, 1, 0, 5), dt.datetime(2024, 1, 1, 0, 25))
    run_statistics(spark, hits_frame(spark, _rows()), store, FIVE_MINUTES, *span)
    fewer = hits_frame(spark, _rows()[:2])
    assert stats_job.repair(spark, fewer, store, FIVE_MINUTES, *span) == 2
    fresh = StatsStore(scratch + "/fresh")
    run_statistics(spark, fewer, fresh, FIVE_MINUTES, *span)
    assert _snapshot(spark, store) == _snapshot(spark, fresh)
    assert store.table(spark, "partial_stats").count() == 1
    none = hits_frame(spark, [("s1", ts(2025, 1, 1), "/", "1", "x")])
    stats_job.repair(spark, none, store, FIVE_MINUTES, *span)
    assert store.table(spark, "global_stats").count() == 0 and store.table(spark, "partial_stats").count() == 0


def test_closed_days_equal_a_recount(spark, scratch):
    rows = [(f"s{i % 3}", ts(2024, 1, 1 + i % 5, 0, 1), f"/{i % 2}", "1", "x") for i in range(40)]
    store, hits = StatsStore(scratch), hits_frame(spark, rows)
    ends = [dt.datetime(2024, 1, 1 + d, 0, 5) for d in range(5)]
    totals = lambda: sorted(map(tuple, store.table(spark, "global_stats_url").collect()))
    for end in ends:
        run_statistics(spark, hits, store, FIVE_MINUTES, end, end)
        stats_job.close_days(spark, store, end.date())
    want = sorted((s, u, n) for (s, u), n in Counter((r[0], r[2]) for r in rows).items())
    assert totals() == want
    # a closed day changes: its closed version goes out of force
    more = hits_frame(spark, rows + [("s0", ts(2024, 1, 2, 0, 2), "/0", "1", "x")])
    assert stats_job.repair(spark, more, store, FIVE_MINUTES, ends[0], ends[-1]) >= 1  # and windows between the ticks
    assert dict(((s, u), n) for s, u, n in totals())["s0", "/0"] == dict(((s, u), n) for s, u, n in want)["s0", "/0"] + 1
    stats_job.close_days(spark, store, dt.date(2024, 1, 4))
    assert sum(n for *_, n in totals()) == 41


def test_hits_are_not_shuffled_before_they_are_counted(spark, scratch):
    from hitlens.functions.windows import StatDefinition
    from hitlens.plans.stats_job import hits_of

    logs = model.logs(spark, SF001)
    todo = spark.createDataFrame([(dt.datetime(2024, 1, d),) for d in (3, 5)], "stat_time timestamp_ntz")
    for n, last in ((2, dt.datetime(2024, 1, 5)), (3, dt.datetime(2024, 1, 5))):
        hits = hits_of(logs, todo, n, ONE_DAY, dt.datetime(2024, 1, 3), last)
        plan = st.stats_all_levels(hits, ONE_DAY)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1, plan
    assert isinstance(ONE_DAY, StatDefinition)


def test_a_tick_reads_its_own_day_and_leaves_no_staged_folder(spark, scratch):
    import glob
    import os

    store = StatsStore(scratch + "/store")
    rows = [("s1", ts(2024, 1, d, 0, 1), "/a", "1", "x") for d in range(1, 6)]
    run_statistics(spark, hits_frame(spark, rows), store, FIVE_MINUTES, dt.datetime(2024, 1, 1, 0, 5), dt.datetime(2024, 1, 5, 0, 5))
    day = store.read_days(spark, "stats_levels", "5_minutes", [dt.date(2024, 1, 3)])
    assert {f.split("stat_date=")[1][:10] for f in day.inputFiles()} == {"2024-01-03"}
    base = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    assert not glob.glob(os.path.join(base, "hitlens-stage-*"))
