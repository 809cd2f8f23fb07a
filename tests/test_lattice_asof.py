"""Longer windows from shorter ones and their edges; resolution by the hit's own time."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from hitlens.functions.windows import FIVE_MINUTES, ONE_DAY, ONE_HOUR, StatDefinition
from hitlens.operators import ingest as ing
from hitlens.operators import lattice
from hitlens.operators import stats as st
from hitlens.operators.asof import resolve_as_of
from hitlens.plans import stats_job as job
from hitlens.plans.catalog import QUERIES
from hitlens.plans.stats_job import StatsStore, run_from_finer, run_statistics

from .conftest import SF001, hits_frame, ts


def boundary_hits(spark, seed=1, n=400, days=2):
    """Hits in, right after and right before the milliseconds in which windows begin, and anywhere."""
    rng, rows = random.Random(seed), []
    for i in range(n):
        kind = rng.randrange(6)
        t = ts(2024, 1, 1 + rng.randrange(days), rng.choice([0, 0, 1, 23]), 5 * rng.randrange(12))
        t = t.replace(hour=0, minute=0) if kind == 0 else t.replace(minute=0) if kind == 1 else t
        t += dt.timedelta(microseconds=rng.choice([0, 500, 999, 1000, 1001]) if kind < 5 else rng.randrange(300_000_000))
        rows.append((f"s{rng.randrange(3)}", t, f"/{rng.randrange(2)}", f"ip{rng.randrange(3)}", f"a{rng.randrange(2)}"))
    return hits_frame(spark, rows)


def same(a, b):
    b = b.select(*a.columns)
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


@pytest.mark.parametrize("path", [(FIVE_MINUTES, ONE_DAY), (FIVE_MINUTES, ONE_HOUR, ONE_DAY), (FIVE_MINUTES, ONE_HOUR)])
def test_coarser_windows_equal_the_direct_ones(spark, path):
    hits = boundary_hits(spark)
    rows = lattice.levels_and_edges(hits, path[0])
    assert same(rows.where("NOT edge").drop("edge"), st.stats_all_levels(hits, path[0]))
    assert rows.where("edge").count() > 20
    for fine, coarse in zip(path, path[1:]):
        rows = lattice.coarsen(rows, fine, coarse)
    assert same(rows, lattice.levels_and_edges(hits, path[-1]))
    assert same(rows.where("NOT edge").drop("edge"), st.stats_all_levels(hits, path[-1]))


def test_no_multiple_is_refused(spark):
    with pytest.raises(ValueError):
        lattice.coarsen(lattice.levels_and_edges(boundary_hits(spark, n=3), FIVE_MINUTES), FIVE_MINUTES, StatDefinition("7_minutes", 420_000))


def test_days_from_the_stored_hours_read_no_hit(spark, scratch):
    hits, store = boundary_hits(spark, 2, 80), StatsStore(scratch + "/a")
    first, last = dt.datetime(2024, 1, 2), dt.datetime(2024, 1, 3)
    hour = dt.timedelta(hours=1)
    run = lambda a, b: run_statistics(spark, hits, store, ONE_HOUR, a, b, base_type="1_hour", edges=True)
    run(first - dt.timedelta(days=1) + hour, first)
    with pytest.raises(ValueError, match="24 windows"):
        run_from_finer(spark, store, ONE_HOUR, ONE_DAY, first, last, base_type="1_hour")
    run(first + hour, last)
    job.close_days(spark, store, dt.date(2024, 1, 2))  # from closed and open days alike
    assert run_from_finer(spark, store, ONE_HOUR, ONE_DAY, first, last, base_type="1_hour") == 2
    assert run_from_finer(spark, store, ONE_HOUR, ONE_DAY, first, last, base_type="1_hour") == 0
    direct = StatsStore(scratch + "/b")
    run_statistics(spark, hits, direct, ONE_DAY, first, last, base_type="1_hour")
    for table in ("partial_stats_requests", "partial_stats_url", "partial_stats_ip", "partial_stats_browser", "stats_reference"):
        assert same(direct.table(spark, table), store.table(spark, table).where("stat_type = '1_day'")), table
    totals = {r.site_id: r.requests for r in store.table(spark, "global_stats").collect()}
    assert totals == {r.site_id: r.requests for r in st.global_stats(st.partial_stats_requests(hits, ONE_HOUR), "1_hour").collect()}


IDS = [f"00000000-0000-4000-8000-00000000000{i}" for i in range(4)]


def intervals(spark, rows):
    return spark.createDataFrame(rows, "tracking_id string, site_id string, valid_from timestamp_ntz, valid_to timestamp_ntz")


def day(n, **more):
    return dt.datetime(2024, 1, n) + dt.timedelta(**more)


HISTORY = [(IDS[0], "a", day(1), None), (IDS[1], "b", day(1), day(5)), (IDS[2], "c", day(1), day(5)), (IDS[2], "d", day(5, minutes=30), day(9)), (IDS[2], "e", day(9), None),
           (None, "x", day(1), None), (IDS[3], "f", None, None)]


def test_resolution_by_the_hits_own_time(spark):
    asked = [(0, day(1)), (0, day(1, microseconds=-1)), (0, day(30)), (1, day(4)), (1, day(5, minutes=59)), (1, day(5, minutes=60)), (2, day(5, minutes=29)), (2, day(5, minutes=30)),
             (2, day(8)), (2, day(9)), (2, day(20)), (3, day(2)), (0, None)]
    hits = spark.createDataFrame([(i, IDS[k], t) for i, (k, t) in enumerate(asked)] + [(98, "bad", day(2)), (99, None, day(2))], "hit_id long, tracking_id string, log_time timestamp_ntz")
    want = ["a", None, "a", "b", "b", None, "c", "d", "d", "e", "e", None, None]
    for broadcast in (False, True):
        out = resolve_as_of(hits, intervals(spark, HISTORY * 2), broadcast=broadcast)
        got = {r.hit_id: (r.site_id, r.status) for r in out.collect()}
        assert out.columns == ["hit_id", "tracking_id", "log_time", "site_id", "status"]
        assert got == {i: (x, 202 if x else 404) for i, x in enumerate(want)} | {98: (None, 400), 99: (None, 400)}
    none = {r.hit_id: r.site_id for r in resolve_as_of(hits, intervals(spark, HISTORY), expiry=dt.timedelta(0)).collect()}
    assert none[4] is None and none[6] is None and none[3] == "b"


def test_a_replay_after_a_delete_gives_the_first_result(spark, scratch):
    """From the stored registry: the site is deleted between the runs, and its hits resolve as before."""
    from hitlens.functions.timeid import ntz_lit, time_uuid
    from hitlens.sources.registry_store import RegistryStore

    store = RegistryStore(spark, scratch, buckets=4)
    owner = IDS[3]
    new = spark.createDataFrame([(1, owner, "one.org"), (2, owner, "two.org")], "request_id long, user_id string, domain string")
    tracked = F.element_at(F.array(*map(F.lit, IDS)), F.col("request_id").cast("int"))
    store.create_sites(new, time_uuid(ntz_lit(day(1)), F.col("request_id")), tracked)
    body = '{"url":"/","ipAddress":"1","userAgent":"a"}'
    raw = spark.createDataFrame([(f"h{i}", IDS[i % 3], day(2 + i), body) for i in range(6)], "hit_id string, tracking_id string, log_time timestamp_ntz, body string")
    run = lambda: sorted((r.hit_id, r.outcome, r.site_id) for r in ing.ingest(raw, store.table("site_history"), expiry=dt.timedelta(minutes=60)).collect())
    before = run()
    assert [x[1] for x in before] == ["accepted", "accepted", "unknown_site"] * 2
    gone = store.table("sites_by_id").where("domain = 'one.org'").select("id")
    store.delete("sites_by_id", gone, when=day(20))
    assert run() == before and store.table("sites_by_tracking_id").count() == 1
    # the tracking id goes to another site, from its own time on
    store.create_sites(new.limit(1), time_uuid(ntz_lit(day(25)), F.lit(7)), tracked)
    assert run() == before
    late = raw.withColumn("log_time", ntz_lit(day(26)))
    assert {r.site_id for r in ing.ingest(late, store.table("site_history"), expiry=dt.timedelta(0)).where(F.col("tracking_id") == IDS[0]).collect()} == {
        r.id for r in store.table("sites_by_id").where("domain = 'one.org'").collect()}


def test_the_plan_has_one_equi_join(spark):
    plan = QUERIES["resolve_hits_as_of"](spark, SF001)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and plan.count("Join") == 1
