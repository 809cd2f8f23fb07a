"""Totals as a sum of three levels, days closed into one folder, fragments by size."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from hitlens import schemas
from hitlens.functions.windows import FIVE_MINUTES, ONE_DAY, StatDefinition
from hitlens.operators import stats as st
from hitlens.plans import stats_job as job
from hitlens.plans.stats_job import StatsStore, close_days, repair, run_statistics
from hitlens.sources import sinks

from .conftest import hits_frame, ts

HOURLY = StatDefinition("1_hour", 3_600_000)
TABLES = ("partial_stats_requests", "partial_stats_url", "partial_stats_ip", "partial_stats_browser", "global_stats", "global_stats_url", "stats_reference")


def snapshot(spark, store):
    out = {t: sorted(tuple(map(str, r)) for r in store.table(spark, t).select(*sorted(store.table(spark, t).columns)).collect()) for t in TABLES}
    whole = store.table(spark, "partial_stats")
    out["maps"] = sorted((r.site_id, str(r.stat_time), tuple(sorted(r.ip.items())), tuple(sorted(r.browser.items())), r.requests) for r in whole.collect())
    return out


def rows_of(seed, days=4, n=60):
    rng = random.Random(seed)
    return [(f"s{rng.randrange(3)}", ts(2024, 1, 1 + rng.randrange(days), rng.randrange(3), 1 + rng.randrange(58)), f"/{rng.randrange(3)}", f"ip{rng.randrange(5)}", f"a{rng.randrange(2)}") for _ in range(n)]


def fresh(spark, rows, path, last):
    store = StatsStore(path)
    run_statistics(spark, hits_frame(spark, rows), store, HOURLY, dt.datetime(2024, 1, 1, 1), last, base_type="1_hour")
    return snapshot(spark, store)


def test_reruns_repairs_and_closed_days_equal_a_recount(spark, scratch):
    rows, last = rows_of(1), dt.datetime(2024, 1, 5)
    store = StatsStore(scratch + "/store")
    run = lambda r, a, b: run_statistics(spark, hits_frame(spark, r), store, HOURLY, a, b, base_type="1_hour")
    run(rows[:40], dt.datetime(2024, 1, 1, 1), dt.datetime(2024, 1, 3))
    close_days(spark, store, dt.date(2024, 1, 2))  # one closed day, one open
    run(rows[:40], dt.datetime(2024, 1, 3, 1), last)
    want = fresh(spark, rows[:40], scratch + "/a", last)
    assert snapshot(spark, store) == want
    close_days(spark, store, dt.date(2024, 1, 4))
    assert snapshot(spark, store) == want
    # late hits in closed and open days, and hits that are gone
    repair(spark, hits_frame(spark, rows), store, HOURLY, dt.datetime(2024, 1, 1, 1), last, base_type="1_hour")
    changed = rows[5:]
    repair(spark, hits_frame(spark, changed), store, HOURLY, dt.datetime(2024, 1, 1, 1), last, base_type="1_hour")
    want = fresh(spark, changed, scratch + "/b", last)
    assert snapshot(spark, store) == want
    # the closed totals are out of force; the days carry them until the next close
    assert store.marks(store.manifest(spark))["through"] is None and len(store.total_levels(spark, "global_stats")) == 2
    close_days(spark, store, dt.date(2024, 1, 5))
    assert snapshot(spark, store) == want and len(store.total_levels(spark, "global_stats")) <= 2
    none = changed[:1]
    repair(spark, hits_frame(spark, none), store, HOURLY, dt.datetime(2024, 1, 1, 1), last, base_type="1_hour")
    assert snapshot(spark, store) == fresh(spark, none, scratch + "/c", last)


def test_crash_at_any_step_of_a_close(spark, scratch, monkeypatch):
    rows, last = rows_of(3, days=2, n=20), dt.datetime(2024, 1, 3)
    store = StatsStore(scratch + "/store")
    run_statistics(spark, hits_frame(spark, rows), store, HOURLY, dt.datetime(2024, 1, 1, 1), last, base_type="1_hour")
    want = snapshot(spark, store)

    def crash(*_, **__):
        raise RuntimeError("crash")

    for name in ("commit_version", "remove_folders"):  # before the version file, and right after it
        with monkeypatch.context() as m:
            m.setattr(sinks, name, crash)
            with pytest.raises(RuntimeError):
                close_days(spark, store, dt.date(2024, 1, 3))
        assert snapshot(spark, store) == want, name
    close_days(spark, store, dt.date(2024, 1, 4))
    assert snapshot(spark, store) == want


def test_a_tick_reads_no_stored_statistics(spark, scratch, monkeypatch):
    store, rows = StatsStore(scratch), rows_of(4, days=1)
    run_statistics(spark, hits_frame(spark, rows), store, HOURLY, dt.datetime(2024, 1, 1, 1), dt.datetime(2024, 1, 1, 1), base_type="1_hour")
    read, real = [], StatsStore._load

    def load(self, spark_, table, open_folders, closed_folders):
        read.append((table, [*open_folders], [*closed_folders]))
        return real(self, spark_, table, open_folders, closed_folders)

    monkeypatch.setattr(StatsStore, "_load", load)
    run_statistics(spark, hits_frame(spark, rows), store, HOURLY, dt.datetime(2024, 1, 1, 2), dt.datetime(2024, 1, 1, 2), base_type="1_hour")
    # nothing but the check for what an empty window had stored
    assert all(not closed for _, _, closed in read) and len(read) == 2
    assert os.listdir(scratch + "/stats_levels/stat_type=1_hour/stat_date=2024-01-01") != []


def test_a_closed_day_is_one_folder_a_table(spark, scratch):
    store, rows = StatsStore(scratch), rows_of(5, days=2, n=80)
    run_statistics(spark, hits_frame(spark, rows), store, HOURLY, dt.datetime(2024, 1, 1, 1), dt.datetime(2024, 1, 3), base_type="1_hour")
    run_statistics(spark, hits_frame(spark, rows), store, ONE_DAY, dt.datetime(2024, 1, 2), dt.datetime(2024, 1, 2), base_type="1_hour")
    windows = lambda: sum(f.startswith("stat_time=") for _, ds, _ in os.walk(scratch) for f in ds)
    assert windows() > 6
    close_days(spark, store, dt.date(2024, 1, 4))
    assert windows() == 0
    at = store.manifest(spark)
    assert len(at.parts) == 2 * 3 + 2 * 2 + 2  # windowed tables, day totals, closed totals
    assert set(store.closed_days(at, "stats_levels", "1_hour")) == {("1_hour", dt.date(2024, 1, d)) for d in (1, 2)}
    # a closed day is one or a few files, and its rows keep their columns
    assert store.read(spark, "stats_levels").columns == schemas.STATS_LEVELS.names


def test_another_base_type_is_refused(spark, scratch):
    store, rows = StatsStore(scratch), rows_of(6, days=1, n=5)
    end = dt.datetime(2024, 1, 1, 1)
    run_statistics(spark, hits_frame(spark, rows), store, HOURLY, end, end, base_type="1_hour")
    with pytest.raises(ValueError):
        run_statistics(spark, hits_frame(spark, rows), store, FIVE_MINUTES, end, end)


def test_fragments_follow_the_number_of_keys(spark):
    """A site with many ips is built by many groups, small sites have one row; sums and whole rows stay."""
    rows = [("big", ts(2024, 1, 1, 1, 1), "/", f"ip{i}", "a") for i in range(3000)] + [(f"s{i}", ts(2024, 1, 1, 1, 1), "/", f"ip{i % 7}", None if i % 5 == 0 else "a") for i in range(50)]
    levels = st.stats_all_levels(hits_frame(spark, rows), ONE_DAY)
    sized = st.partial_stats_sized(levels, ONE_DAY, keys_per_fragment=100)
    by_site = {}
    for r in sized.collect():
        by_site.setdefault(r.site_id, []).append(r)
    assert len(by_site["big"]) == 31 == by_site["big"][0].fragments and max(len(r.ip) for r in by_site["big"]) < 200
    assert all(len(x) == 1 and x[0].fragments == 1 for s, x in by_site.items() if s != "big")
    text = lambda df: sorted(map(tuple, st.whole_partial_stats(df).select("site_id", "requests", st.histogram_text("ip"), st.histogram_text("browser")).collect()))
    assert text(sized) == text(st.partial_stats(levels, ONE_DAY)) and sum(r.requests for x in by_site.values() for r in x) == len(rows)
    assert sized.agg(F.sum("requests")).first()[0] == len(rows)
