import datetime as dt

from hitlens.operators import loadstats as ls

SCHEMA = "ts timestamp_ntz, status int, outcome string, elapsed_ms long"
T = dt.datetime(2024, 1, 1)


def _df(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_no_rows(spark):
    tot = ls.load_stats_total(ls.load_stats_partial(_df(spark, []))).first()
    assert (tot.enqueued, tot.dropped, tot.failed, tot.total, tot.avg_ms, tot.min_ms) == (0, 0, 0, 0, 0, None)


def test_only_failures(spark):
    rows = [(T, None, "failed", 10), (T + dt.timedelta(seconds=1), None, "failed", 30)]
    p = ls.load_stats_partial(_df(spark, rows)).first()
    assert (p.enqueued, p.failed, p.responses, p.min_ms, p.max_ms, p.sum_ms, p.avg_ms, p.total) == \
        (2, 2, 0, 10, 30, 40, 20, 2)


def test_windows_and_totals(spark):
    rows = [(T, 200, "ok", 5), (T + dt.timedelta(seconds=1), 500, "ok", 7),
            (T + dt.timedelta(seconds=6), None, "dropped", None), (T + dt.timedelta(seconds=7), 200, "ok", 1)]
    part = ls.load_stats_partial(_df(spark, rows))
    by_end = {r.window_end: r for r in part.collect()}
    assert sorted(by_end) == [T + dt.timedelta(seconds=5), T + dt.timedelta(seconds=10)]
    w2 = by_end[T + dt.timedelta(seconds=10)]
    assert (w2.enqueued, w2.dropped, w2.total, w2.min_ms) == (1, 1, 2, 1)
    tot = ls.load_stats_total(part).first()
    assert (tot.enqueued, tot.dropped, tot.total, tot.min_ms, tot.max_ms, tot.sum_ms, tot.avg_ms) == \
        (3, 1, 4, 1, 7, 13, 4)
    merged = {r.status: r.responses for r in ls.merge_histograms(ls.status_histograms(_df(spark, rows))).collect()}
    assert merged == {200: 2, 500: 1}
