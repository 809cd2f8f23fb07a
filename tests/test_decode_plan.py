"""A hit's body is parsed twice, whatever is read from it; single levels need no Expand."""

import pytest

from hitlens.functions.windows import ONE_DAY
from hitlens.operators import stats as st
from hitlens.plans.catalog import QUERIES
from hitlens.sources import model

from .conftest import SF001


@pytest.mark.parametrize("name", ["ingest_decode", "ingest_quarantine", "resolve_hits", "unresolved_hits", "ingest_outcomes"])
def test_a_body_is_parsed_twice(spark, name):
    plan = QUERIES[name](spark, SF001)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parse_json") + plan.count("parseJson") == 2, plan


@pytest.mark.parametrize("name", ["partial_stats_requests", "partial_stats_ip", "partial_stats_browser", "partial_stats_url"])
def test_one_level_is_one_aggregate_without_expand(spark, name):
    plan = QUERIES[name](spark, SF001)._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan and plan.count("Exchange") == 1


@pytest.mark.parametrize("levels", [("site",), ("url", "site"), ("ip", "browser"), ("browser", "site", "url"), st.LEVELS])
def test_levels_by_request(spark, levels):
    logs = model.logs(spark, SF001)
    want = st.stats_all_levels(logs, ONE_DAY).where(st.F.col("level").isin(*levels))
    got = st.stats_all_levels(logs, ONE_DAY, levels=levels)
    assert got.columns == want.columns and sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
