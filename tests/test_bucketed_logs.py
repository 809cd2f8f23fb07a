"""Hits bucketed by site: counted where they lie, a hot site by many tasks."""

import pytest
from pyspark.sql import functions as F

from hitlens.functions.windows import FIVE_MINUTES, ONE_DAY, StatDefinition
from hitlens.operators import stats as st
from hitlens.sources import model
from hitlens.sources.bucketed_logs import BucketedLogs

from .conftest import SF001, hits_frame, ts


def _hits(spark):
    """One site with a third of all hits, some null sites and keys, two days."""
    rows = [("hot" if i % 3 == 0 else None if i % 50 == 1 else f"s{i % 97}", ts(2024, 1, 1 + i % 2, i % 24, i % 60, 1), None if i % 11 == 0 else f"/{i % 7}", f"ip{i % 13}", f"a{i % 3}") for i in range(3000)]
    return hits_frame(spark, rows)


def _same(a, b):
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


@pytest.mark.parametrize("stat", [FIVE_MINUTES, ONE_DAY])
def test_equals_the_shuffled_form_with_a_hot_site(spark, scratch, stat):
    table = BucketedLogs.open(spark, scratch + "/logs", 8)
    table.write(_hits(spark))
    assert _same(st.stats_of_buckets(table.read(), stat), st.stats_all_levels(_hits(spark), stat))
    assert _same(st.stats_of_buckets(table.read(), stat, levels=("ip",)), st.stats_all_levels(_hits(spark), stat, levels=("ip",)))
    salts = {(r.site_id, r.salt): r["count"] for r in table.read().groupBy("site_id", "salt").count().collect()}
    hot = [n for (site, _), n in salts.items() if site == "hot"]
    assert len(hot) >= 3 and max(hot) < 600 and {s for (site, s) in salts if site != "hot"} == {-1}


def test_no_exchange_below_the_counting_aggregate(spark, scratch):
    table = BucketedLogs.open(spark, scratch + "/logs", 8)
    table.write(_hits(spark))
    plan = st.stats_of_buckets(table.read(), ONE_DAY)._jdf.queryExecution().executedPlan().toString()
    cold, hot = plan[: plan.index("Exchange")], plan[plan.index("Exchange") :]
    # the cold branch has none; the hot one has one, above its counting aggregate
    assert plan.count("Exchange") == 1 and cold.count("FileScan") == 1 and "count(1)" in cold
    assert hot.index("count(1)") < hot.index("FileScan") and plan.count("Bucketed: true") == 2 and "Expand" not in plan


def test_a_day_is_replaced_and_the_folder_can_be_opened_again(spark, scratch):
    path = scratch + "/logs"
    table = BucketedLogs.open(spark, path, 4)
    table.write(_hits(spark))
    second = _hits(spark).where(F.to_date("log_time") == F.lit("2024-01-02").cast("date")).limit(40)
    table.write(second)
    again = BucketedLogs.open(spark, path, 4)
    counts = {str(r.log_date): r["count"] for r in again.read().groupBy("log_date").count().collect()}
    assert counts == {"2024-01-01": 1500, "2024-01-02": 40}
    assert "Bucketed: true" in st.stats_of_buckets(again.read(), ONE_DAY)._jdf.queryExecution().executedPlan().toString()
    # one file a bucket and day
    assert len(again.read().inputFiles()) <= 2 * 4
    with pytest.raises(ValueError):
        st.stats_of_buckets(again.read(), StatDefinition("7_hours", 7 * 3_600_000))


def test_driver_table(spark, scratch):
    table = BucketedLogs.open(spark, scratch + "/logs", 8)
    logs = model.logs(spark, SF001)
    table.write(logs)
    assert table.read().count() == logs.count() and _same(st.stats_of_buckets(table.read(), FIVE_MINUTES), st.stats_all_levels(logs, FIVE_MINUTES))
    assert BucketedLogs.open(spark, scratch + "/none", 8).read().count() == 0
