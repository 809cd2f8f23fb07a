"""Every registered query: name -> fn(spark, sf_dir) -> DataFrame.

Each reads the driver's tables whole (through ``hitlens.sources.model``) and
returns aliased columns that match ``hitlens.plans.oracle``.
"""

from __future__ import annotations

import datetime as dt
import uuid
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.windows import FIVE_MINUTES, ONE_DAY, ONE_HOUR, in_window_range
from ..operators import lattice
from ..operators import stats as st
from ..session import checkpoint_dir
from ..sources import model
from ..sources.bucketed_logs import BucketedLogs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Fixed value: end of the single window of ``logs_in_window``.
WINDOW_END = dt.datetime(2024, 1, 10)


def query(name: str):
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn
    return register


# ---------------------------------------------------------------- scans, windows

@query("logs_scan")
def q_logs_scan(spark, sf_dir):
    return model.logs(spark, sf_dir)


@query("logs_in_window")
def q_logs_in_window(spark, sf_dir):
    return model.logs(spark, sf_dir).where(in_window_range("log_time", WINDOW_END, ONE_DAY))


# ---------------------------------------------------------------- statistics

def _stored_level(spark, sf_dir, stat, level):
    """A level's table as the job stores it, through the long form of that level alone."""
    return st.level_table(st.long_form(st.stats_all_levels(model.logs(spark, sf_dir), stat, levels=(level,)), stat), level)


@query("partial_stats_requests")
def q_partial_stats_requests(spark, sf_dir):
    return _stored_level(spark, sf_dir, FIVE_MINUTES, "site")


@query("partial_stats_requests_1d")
def q_partial_stats_requests_1d(spark, sf_dir):
    return st.partial_stats_requests(model.logs(spark, sf_dir), ONE_DAY)


@query("partial_stats_ip")
def q_partial_stats_ip(spark, sf_dir):
    return _stored_level(spark, sf_dir, ONE_DAY, "ip")


@query("partial_stats_browser")
def q_partial_stats_browser(spark, sf_dir):
    return _stored_level(spark, sf_dir, ONE_DAY, "browser")


@query("partial_stats_url")
def q_partial_stats_url(spark, sf_dir):
    return _stored_level(spark, sf_dir, ONE_DAY, "url")


@query("partial_stats_url_5m")
def q_partial_stats_url_5m(spark, sf_dir):
    return st.partial_stats_url(model.logs(spark, sf_dir), FIVE_MINUTES)


def _partial_stats(spark, sf_dir, fragments):
    return st.partial_stats(st.stats_all_levels(model.logs(spark, sf_dir), ONE_DAY), ONE_DAY, fragments)


def _maps_as_text(ps, *more):
    return ps.select("site_id", "year", "stat_time", "stat_type", *more, "requests",
                     st.histogram_text("ip").alias("ip"), st.histogram_text("browser").alias("browser"))


@query("partial_stats")
def q_partial_stats(spark, sf_dir):
    return _maps_as_text(_partial_stats(spark, sf_dir, st.FRAGMENTS), "fragment")


@query("partial_stats_4")
def q_partial_stats_4(spark, sf_dir):
    return _maps_as_text(_partial_stats(spark, sf_dir, 4), "fragment")


@query("partial_stats_whole")
def q_partial_stats_whole(spark, sf_dir):
    return _maps_as_text(st.whole_partial_stats(_partial_stats(spark, sf_dir, st.FRAGMENTS)))


@query("stats_all_levels")
def q_stats_all_levels(spark, sf_dir):
    return st.stats_all_levels(model.logs(spark, sf_dir), ONE_DAY)


@query("stats_all_levels_bucketed")
def q_stats_all_levels_bucketed(spark, sf_dir):
    """All levels from a stored, bucketed copy of the hits, counted without a shuffle of hits."""
    folder = f"{checkpoint_dir(spark).rstrip('/')}/bucketed-{uuid.uuid4().hex}"
    stored = BucketedLogs.open(spark, folder, buckets=max(8, spark.sparkContext.defaultParallelism))
    stored.write(model.logs(spark, sf_dir))
    return st.stats_of_buckets(stored.read(), ONE_DAY)


@query("stats_days_from_minutes")
def q_stats_days_from_minutes(spark, sf_dir):
    """Days out of hours out of five minutes, with hits on window boundaries."""
    rows = lattice.levels_and_edges(model.boundary_logs(spark, sf_dir), FIVE_MINUTES)
    hours = lattice.coarsen(rows, FIVE_MINUTES, ONE_HOUR)
    return lattice.coarsen(hours, ONE_HOUR, ONE_DAY).where("NOT edge").drop("edge")


@query("global_stats")
def q_global_stats(spark, sf_dir):
    return st.global_stats(st.partial_stats_requests(model.logs(spark, sf_dir), FIVE_MINUTES))


@query("global_stats_url")
def q_global_stats_url(spark, sf_dir):
    return st.global_stats_url(st.partial_stats_url(model.logs(spark, sf_dir), FIVE_MINUTES))


def _three_levels(partial, keys):
    """Partials of five minutes as closed totals, day totals and windows, by
    the day of the window; then their sum."""
    day = F.dayofmonth("stat_time")
    closed = st.sum_levels([partial.where(day <= 10)], keys)
    days = st.sum_levels([partial.where(day.between(11, 20)).withColumn("stat_date", F.to_date("stat_time"))], [*keys, "stat_date"])
    return st.sum_levels([closed, days, partial.where(day > 20)], keys)


@query("global_stats_levels")
def q_global_stats_levels(spark, sf_dir):
    return _three_levels(st.partial_stats_requests(model.logs(spark, sf_dir), FIVE_MINUTES), ["site_id"])


@query("global_stats_url_levels")
def q_global_stats_url_levels(spark, sf_dir):
    return _three_levels(st.partial_stats_url(model.logs(spark, sf_dir), FIVE_MINUTES), ["site_id", "url"])


@query("partial_stats_sized")
def q_partial_stats_sized(spark, sf_dir):
    """Fragments by the number of a site's keys, here of four keys each, so that sites of one and of several occur."""
    levels = st.stats_all_levels(model.logs(spark, sf_dir), ONE_DAY, levels=("site", "ip", "browser"))
    return _maps_as_text(st.partial_stats_sized(levels, ONE_DAY, keys_per_fragment=4), "fragment", "fragments")


@query("stats_reference")
def q_stats_reference(spark, sf_dir):
    return st.stats_reference(model.logs(spark, sf_dir), FIVE_MINUTES)


@query("stats_reference_1d")
def q_stats_reference_1d(spark, sf_dir):
    return st.stats_reference(model.logs(spark, sf_dir), ONE_DAY)


@query("stats_due_windows")
def q_stats_due_windows(spark, sf_dir):
    """Windows still to compute when the ledger holds the even days."""
    logs = model.logs(spark, sf_dir)
    due = st.due_windows(logs, ONE_DAY)
    ledger = st.stats_reference(logs, ONE_DAY, due).where(F.dayofmonth("stat_time") % 2 == 0)
    return st.pending_windows(due, ledger)


# ---------------------------------------------------------------- ingestion

from ..functions import status as _status  # noqa: E402
from ..functions.dates import date_text, parse_date_text  # noqa: E402
from ..functions.timeid import is_uuid, time_of_uuid, time_uuid  # noqa: E402
from ..operators import ingest as ing  # noqa: E402
from ..operators import loadstats as ls  # noqa: E402
from ..operators import registry as reg  # noqa: E402
from ..operators.asof import resolve_as_of  # noqa: E402


@query("ingest_decode")
def q_ingest_decode(spark, sf_dir):
    return ing.good_hits(ing.decode_hits(model.raw_hits(spark, sf_dir)))


@query("ingest_quarantine")
def q_ingest_quarantine(spark, sf_dir):
    q = ing.quarantine(ing.decode_hits(model.raw_hits(spark, sf_dir)))
    return q.select("hit_id", "tracking_id", "reason", "status")


@query("ingest_outcomes")
def q_ingest_outcomes(spark, sf_dir):
    out = ing.ingest(model.raw_hits(spark, sf_dir), model.sites_by_tracking(spark, sf_dir))
    return ing.outcome_counts(out)


def _resolved(spark, sf_dir):
    hits = ing.good_hits(ing.decode_hits(model.raw_hits(spark, sf_dir)))
    return ing.resolve_hits(hits, model.sites_by_tracking(spark, sf_dir))


@query("resolve_hits")
def q_resolve_hits(spark, sf_dir):
    r = _resolved(spark, sf_dir)
    return r.where(F.col("status") == _status.ACCEPTED).select(
        "hit_id", "site_id", "log_time", "url", "ip_address", "user_agent", "status")


@query("unresolved_hits")
def q_unresolved_hits(spark, sf_dir):
    r = _resolved(spark, sf_dir)
    return r.where(F.col("status") != _status.ACCEPTED).select("hit_id", "tracking_id", "status")


@query("resolve_hits_as_of")
def q_resolve_hits_as_of(spark, sf_dir):
    """Every decodable hit by the registry of its own time."""
    hits = ing.good_hits(ing.decode_hits(model.raw_hits(spark, sf_dir)))
    return resolve_as_of(hits, model.site_intervals(spark, sf_dir)).select("hit_id", "tracking_id", "log_time", "site_id", "status")


@query("dedupe_hits")
def q_dedupe_hits(spark, sf_dir):
    return ing.dedupe(model.redelivered_logs(spark, sf_dir), ["log_id"])


# ---------------------------------------------------------------- ids, dates

@query("uuid_check")
def q_uuid_check(spark, sf_dir):
    ids = model.id_checks(spark, sf_dir)
    valid = is_uuid(F.col("id"))
    return ids.select("request_id", "id", valid.alias("valid"),
                      F.when(valid, F.lit(_status.OK)).otherwise(F.lit(_status.BAD_REQUEST))
                      .alias("status"))


@query("timeuuid_time")
def q_timeuuid_time(spark, sf_dir):
    lg = model.logs(spark, sf_dir)
    tid = time_uuid(F.col("log_time"), F.col("log_id").cast("bigint"))
    return lg.select("log_id", tid.alias("time_id")).withColumn(
        "created_at", time_of_uuid(F.col("time_id")))


@query("date_text")
def q_date_text(spark, sf_dir):
    lg = model.logs(spark, sf_dir)
    return lg.select("log_id", date_text(F.col("log_time")).alias("date_text")).withColumn(
        "parsed", parse_date_text(F.col("date_text")))


# ---------------------------------------------------------------- registry

@query("validate_users")
def q_validate_users(spark, sf_dir):
    return reg.validate_users(model.user_requests(spark, sf_dir))


def _created_users(spark, sf_dir):
    registry = reg.users_by_credentials(model.users(spark, sf_dir))
    return reg.create_users(model.user_requests(spark, sf_dir), registry, model.new_user_id())


@query("user_create_accepted")
def q_user_create_accepted(spark, sf_dir):
    return _created_users(spark, sf_dir)[0]


@query("user_create_rejected")
def q_user_create_rejected(spark, sf_dir):
    return _created_users(spark, sf_dir)[1]


@query("user_update")
def q_user_update(spark, sf_dir):
    after, _ = reg.apply_updates(model.users(spark, sf_dir), model.user_updates(spark, sf_dir),
                                 ["full_name"])
    return after


@query("user_update_outcomes")
def q_user_update_outcomes(spark, sf_dir):
    _, outcomes = reg.apply_updates(model.users(spark, sf_dir), model.user_updates(spark, sf_dir),
                                    ["full_name"])
    return outcomes.select("id", "seq", "full_name", "status")


@query("site_update")
def q_site_update(spark, sf_dir):
    after, _ = reg.apply_updates(model.sites(spark, sf_dir), model.site_updates(spark, sf_dir),
                                 ["domain"])
    return after


@query("site_update_outcomes")
def q_site_update_outcomes(spark, sf_dir):
    _, outcomes = reg.apply_updates(model.sites(spark, sf_dir), model.site_updates(spark, sf_dir),
                                    ["domain"])
    return outcomes.select("id", "seq", "domain", "status")


@query("site_delete")
def q_site_delete(spark, sf_dir):
    after, _ = reg.apply_deletes(model.sites(spark, sf_dir), model.site_deletes(spark, sf_dir))
    return after


@query("site_delete_outcomes")
def q_site_delete_outcomes(spark, sf_dir):
    _, outcomes = reg.apply_deletes(model.sites(spark, sf_dir), model.site_deletes(spark, sf_dir))
    return outcomes.select("id", "user_id", "status")


@query("site_create")
def q_site_create(spark, sf_dir):
    return reg.new_sites(model.site_requests(spark, sf_dir), F.col("new_id"), F.col("new_tracking"))


@query("site_create_outcomes")
def q_site_create_outcomes(spark, sf_dir):
    return reg.site_create_outcomes(model.site_requests(spark, sf_dir), F.col("new_id"), F.col("new_tracking"))


@query("user_registry_after_sign_up")
def q_user_registry_after_sign_up(spark, sf_dir):
    """The e-mail registry that the accepted sign-ups leave."""
    users = model.users(spark, sf_dir)
    accepted = _created_users(spark, sf_dir)[0]
    new = accepted.select(F.col("user_id").alias("id"), "email", "full_name")
    return reg.users_by_credentials(users.unionByName(new))


@query("site_registry_by_tracking")
def q_site_registry_by_tracking(spark, sf_dir):
    return reg.sites_by_tracking_id(model.sites(spark, sf_dir))


@query("site_registry_by_user")
def q_site_registry_by_user(spark, sf_dir):
    return reg.sites_by_users(model.sites(spark, sf_dir))


@query("user_registry_by_email")
def q_user_registry_by_email(spark, sf_dir):
    return reg.users_by_credentials(model.users(spark, sf_dir))


@query("find_site")
def q_find_site(spark, sf_dir):
    return reg.find_by_id(model.site_lookups(spark, sf_dir), model.sites(spark, sf_dir))


@query("find_user")
def q_find_user(spark, sf_dir):
    return reg.find_by_id(model.user_lookups(spark, sf_dir), model.users(spark, sf_dir))


@query("list_sites_by_user")
def q_list_sites_by_user(spark, sf_dir):
    return reg.list_sites(model.site_list_requests(spark, sf_dir),
                          reg.sites_by_users(model.sites(spark, sf_dir)))


@query("list_sites_outcomes")
def q_list_sites_outcomes(spark, sf_dir):
    return reg.list_sites_outcomes(model.site_list_requests(spark, sf_dir),
                                   reg.sites_by_users(model.sites(spark, sf_dir)))


# ---------------------------------------------------------------- load statistics

@query("load_stats_partial")
def q_load_stats_partial(spark, sf_dir):
    return ls.load_stats_partial(model.request_outcomes(spark, sf_dir))


@query("load_stats_total")
def q_load_stats_total(spark, sf_dir):
    return ls.load_stats_total(ls.load_stats_partial(model.request_outcomes(spark, sf_dir)))


@query("merge_histograms")
def q_merge_histograms(spark, sf_dir):
    return ls.merge_histograms(ls.status_histograms(model.request_outcomes(spark, sf_dir)))
