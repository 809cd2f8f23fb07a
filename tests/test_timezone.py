"""Results must not depend on the session time zone: rerun the time-bearing
queries against their SQL twins under a zone with daylight-saving time."""

import pytest

import __spark_entry__ as entry

from .conftest import SF01
from .oracle_check import compare, duck

NAMES = ["logs_in_window", "partial_stats_requests", "partial_stats_url", "stats_reference",
         "stats_due_windows", "date_text", "timeuuid_time", "find_site", "find_user",
         "user_create_accepted", "load_stats_partial", "list_sites_by_user"]


@pytest.fixture(scope="module")
def con():
    return duck(SF01)


@pytest.fixture
def new_york(spark):
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    yield spark
    spark.conf.set("spark.sql.session.timeZone", old)


@pytest.mark.parametrize("name", NAMES)
def test_query_in_other_zone(new_york, con, name):
    n, problems = compare(new_york, con, name, entry.queries()[name], entry.oracle_sql()[name], SF01)
    assert not problems, problems
