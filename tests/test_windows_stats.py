import re

import datetime as dt

from pyspark.sql import functions as F

from hitlens.functions.windows import FIVE_MINUTES, ONE_DAY, StatDefinition, in_window_range, with_window
from hitlens.operators import stats as st

from .conftest import hits_frame, ts

T = dt.datetime(2024, 1, 1, 0, 10)
R = FIVE_MINUTES


def _boundary_rows():
    lo = T - dt.timedelta(minutes=5)
    times = [lo, lo + dt.timedelta(microseconds=500), lo + dt.timedelta(milliseconds=1),
             T - dt.timedelta(microseconds=1), T, T + dt.timedelta(milliseconds=1)]
    return [("s1", t, "/a", "1.1.1.1", "ua") for t in times]


def test_open_open_window(spark):
    df = with_window(hits_frame(spark, _boundary_rows()), "log_time", R)
    got = sorted((r.log_id, r.stat_time) for r in df.collect())
    # ids 0,1 sit in the boundary ms of T-R, id 4 in the boundary ms of T
    assert got == [("2", T), ("3", T), ("5", T + dt.timedelta(minutes=5))]


def test_closed_left_window(spark):
    df = with_window(hits_frame(spark, _boundary_rows()), "log_time", R, closed_left=True)
    ends = sorted(r.stat_time for r in df.collect())
    assert ends == [T - dt.timedelta(minutes=5) + dt.timedelta(minutes=5)] * 4 + [T + dt.timedelta(minutes=5)] * 2


def test_range_predicate_equals_window_and_pushes_down(spark):
    hits = hits_frame(spark, _boundary_rows())
    by_range = sorted(r.log_id for r in hits.where(in_window_range("log_time", T, R)).collect())
    by_key = sorted(r.log_id for r in with_window(hits, "log_time", R).where(F.col("stat_time") == T).collect())
    assert by_range == by_key == ["2", "3"]


def test_pushdown_on_parquet(spark, scratch):
    hits_frame(spark, _boundary_rows()).write.parquet(scratch + "/logs")
    df = spark.read.parquet(scratch + "/logs").where(in_window_range("log_time", T, R)).select("site_id")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(log_time), GreaterThanOrEqual(log_time" in plan
    assert "ReadSchema: struct<site_id:string,log_time:timestamp_ntz>" in plan


def test_new_year_stamp(spark):
    rows = [("s1", ts(2024, 12, 31, 23, 59, 30), "/", "ip", "ua")]
    out = st.partial_stats_requests(hits_frame(spark, rows), FIVE_MINUTES).first()
    assert out.stat_time == dt.datetime(2025, 1, 1) and out.year == 2025


def _one_site(spark):
    rows = []
    for i, (u, ip, a) in enumerate([("/a", "1", "x"), ("/a", "2", "x"), ("/b", "3", "y"),
                                     ("/a", "1", "y"), ("/b", "1", "x")]):
        rows.append(("s1", ts(2024, 1, 1, 0, 1, i), u, ip, a))
    rows.append(("s2", ts(2024, 1, 1, 0, 2), "/c", "9", "z"))
    return hits_frame(spark, rows)


def test_levels_and_maps(spark):
    hits = _one_site(spark)
    levels = st.stats_all_levels(hits, FIVE_MINUTES)
    got = {(r.level, r.site_id, r.key): r.requests for r in levels.collect()}
    assert got[("site", "s1", None)] == 5
    assert got[("url", "s1", "/a")] == 3 and got[("url", "s1", "/b")] == 2
    assert got[("ip", "s1", "1")] == 3
    assert got[("browser", "s1", "x")] == 3
    ps = {r.site_id: r for r in st.whole_partial_stats(st.partial_stats(levels, FIVE_MINUTES)).collect()}
    assert ps["s1"].requests == 5
    assert ps["s1"].ip == {"1": 3, "2": 1, "3": 1}
    assert ps["s1"].browser == {"x": 3, "y": 2}
    assert ps["s2"].ip == {"9": 1}


def test_levels_sum_to_requests(spark):
    from hitlens.sources import model
    from .conftest import SF001
    levels = st.stats_all_levels(model.logs(spark, SF001), ONE_DAY)
    sums = {r.level: r.n for r in levels.groupBy("level").agg(F.sum("requests").alias("n")).collect()}
    n_hits = st.windowed(model.logs(spark, SF001), ONE_DAY).count()
    assert sums == {"site": n_hits, "url": n_hits, "ip": n_hits, "browser": n_hits}


def test_all_levels_single_exchange(spark):
    from hitlens.sources import model
    from .conftest import SF001
    levels = st.stats_all_levels(model.logs(spark, SF001), ONE_DAY)
    plan = levels._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert "Expand" in plan and plan.count("FileScan parquet") == 1


def test_map_fragments_union_to_whole(spark):
    rows = [("hot", ts(2024, 1, 1, 0, 1, i % 60, us=i), "/u%d" % (i % 3), "ip%d" % i, "ua%d" % (i % 7))
            for i in range(50)]
    levels = st.stats_all_levels(hits_frame(spark, rows), FIVE_MINUTES)
    stored = st.partial_stats(levels, FIVE_MINUTES, fragments=8)
    frags = stored.collect()
    assert len(frags) == 8 and all(len(r.ip) <= 20 for r in frags)
    assert {r.fragment: r.requests for r in frags} == {0: 50, **dict.fromkeys(range(1, 8), 0)}
    whole = st.whole_partial_stats(stored).collect()
    assert len(whole) == 1 and whole[0].requests == 50 and len(whole[0].ip) == 50
    # the fragments are groups of their own: one exchange of them, no join
    plan = stored._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and re.search(r"hashpartitioning\(site_id#\d+, stat_time#\d+, fragment#\d+", plan)
    merged_ip, merged_ua = {}, {}
    for r in frags:
        merged_ip.update(r.ip)
        for k, v in r.browser.items():
            assert k not in merged_ua
            merged_ua[k] = v
    assert len(merged_ip) == 50 and sum(merged_ua.values()) == 50


def test_two_ranges_totals_counted_once(spark):
    hits = _one_site(spark)
    p5 = st.partial_stats_requests(hits, FIVE_MINUTES)
    p1d = st.partial_stats_requests(hits, ONE_DAY)
    totals = {r.site_id: r.requests for r in st.global_stats(p5.unionByName(p1d)).collect()}
    assert totals == {"s1": 5, "s2": 1}


def test_empty_window_in_ledger(spark):
    rows = [("s1", ts(2024, 1, 1, 0, 1), "/", "i", "a"), ("s1", ts(2024, 1, 1, 0, 16), "/", "i", "a")]
    ref = st.stats_reference(hits_frame(spark, rows), FIVE_MINUTES)
    got = sorted((r.stat_time.minute, r.affected_records) for r in ref.collect())
    assert got == [(5, 1), (10, 0), (15, 0), (20, 1)]


def test_pending_windows(spark):
    rows = [("s1", ts(2024, 1, 1, 0, 1), "/", "i", "a"), ("s1", ts(2024, 1, 1, 0, 16), "/", "i", "a")]
    hits = hits_frame(spark, rows)
    due = st.due_windows(hits, FIVE_MINUTES)
    ledger = st.stats_reference(hits, FIVE_MINUTES).where(F.minute("stat_time") == 10)
    got = sorted(r.stat_time.minute for r in st.pending_windows(due, ledger).collect())
    assert got == [5, 15, 20]


def test_custom_definition(spark):
    hourly = StatDefinition("1_hour", 3_600_000)
    out = st.partial_stats_requests(_one_site(spark), hourly).collect()
    assert {r.stat_type for r in out} == {"1_hour"}
    assert sum(r.requests for r in out) == 6


def test_totals_count_the_hits_of_windows(spark):
    from hitlens.sources import model
    from .conftest import SF001
    logs = model.logs(spark, SF001)
    direct = st.windowed(logs, FIVE_MINUTES).groupBy("site_id", "url").count().withColumnRenamed("count", "requests")
    via = st.global_stats_url(st.partial_stats_url(logs, FIVE_MINUTES))
    assert direct.exceptAll(via).count() == 0 and via.exceptAll(direct).count() == 0
