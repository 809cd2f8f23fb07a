"""The driver's tables mapped onto the web-traffic model.

Every frame here is a projection (plus, where a rule says so, a filter or a
union) of one driver table, so its size grows with the data. The same rules
are written as SQL in ``hitlens.plans.oracle``.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.timeid import ntz_lit, time_uuid, time_uuid_millis, uuid_from_text
from .tables import read_table

# Fixed values of the fixture rules.
USER_EPOCH = dt.datetime(2020, 1, 1)   # user n registered at USER_EPOCH + n minutes
REQUEST_EPOCH = dt.datetime(2024, 2, 1)  # sign-up request n sent at REQUEST_EPOCH + n seconds
HISTORY_EPOCH = dt.datetime(2024, 1, 1)  # the first tracking ids are registered
UNKNOWN_NODE_OFFSET = 1_000_000_000    # node offset that yields ids nobody owns


_USER_EPOCH_MS = int((USER_EPOCH - dt.datetime(1970, 1, 1)).total_seconds()) * 1000


def _user_id(custkey: Column) -> Column:
    """Time id of user n, registered at USER_EPOCH + n minutes."""
    return time_uuid_millis(F.lit(_USER_EPOCH_MS) + custkey.cast("bigint") * 60_000, custkey)


def _site_id(orderkey: Column, orderdate: Column) -> Column:
    return time_uuid(orderdate, orderkey)


# ---------------------------------------------------------------- hits

def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``logs`` from ``events``: one hit per event."""
    ev = read_table(spark, sf_dir, "events")
    return ev.select(
        F.col("user_id").cast("string").alias("site_id"),
        F.col("event_id").cast("string").alias("log_id"),
        F.col("ts").alias("log_time"),
        F.concat(F.lit("/"), F.col("event_type")).alias("url"),
        F.concat(F.lit("10.0.0."), F.regexp_extract("props", r"(\d+)", 1)).alias("ip_address"),
        F.concat(F.lit("agent-"), (F.col("event_id") % 5).cast("string")).alias("user_agent"),
    )


def raw_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits as posted: (hit_id, tracking_id, log_time, body). Every 50th body
    lacks ``userAgent``; every 97th is not JSON; some have a number for the
    url (89th), text or a second object after the object (83rd, 79th) or
    single quotes (73rd); every 41st tracking id is malformed."""
    lg = logs(spark, sf_dir)
    ev_id = F.col("log_id").cast("bigint")
    q = F.lit('"')
    whole = F.concat(F.lit('{"url":"'), F.col("url"), F.lit('","ipAddress":"'), F.col("ip_address"),
                     F.lit('","userAgent":"'), F.col("user_agent"), F.lit('"}'))
    body = (F.when(ev_id % 97 == 0, F.concat(F.lit("<html>"), F.col("log_id")))
            .when(ev_id % 89 == 0, F.concat(F.lit('{"url":'), F.col("log_id"),
                                            F.lit(',"ipAddress":"1.2.3.4","userAgent":"a"}')))
            .when(ev_id % 83 == 0, F.concat(whole, F.lit(" and more")))
            .when(ev_id % 79 == 0, F.concat(whole, whole))
            .when(ev_id % 73 == 0, F.translate(whole, '"', "'"))
            .when(ev_id % 50 == 0,
                  F.concat(F.lit('{"url":"'), F.col("url"), F.lit('","ipAddress":"'),
                           F.col("ip_address"), q, F.lit("}")))
            .otherwise(whole))
    tracking = F.when(ev_id % 41 == 0, F.lit("not-an-id")).otherwise(
        uuid_from_text(F.col("site_id")))
    return lg.select(F.col("log_id").alias("hit_id"), tracking.alias("tracking_id"),
                     "log_time", body.alias("body"))


def redelivered_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``logs`` plus a second delivery of every 10th hit."""
    lg = logs(spark, sf_dir)
    return lg.unionByName(lg.where(F.col("log_id").cast("bigint") % 10 == 0))


def sites_by_tracking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracking registry from ``supplier``: tracking id of site n is
    ``uuid_from_text(n)``; hits of sites without a supplier are unknown."""
    sp = read_table(spark, sf_dir, "supplier")
    return sp.select(uuid_from_text(F.col("s_suppkey").cast("string")).alias("tracking_id"),
                     F.col("s_suppkey").cast("string").alias("site_id"))


def site_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Validity intervals from ``supplier``: the tracking id of site n is
    registered n % 10 days into 2024; every 3rd is removed 10 days later, and
    every 6th of all belongs to a new site from 5 days after that on."""
    sp = read_table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")

    def day(n: Column) -> Column:
        return ntz_lit(HISTORY_EPOCH) + F.make_dt_interval(n.cast("int"))

    first = sp.select(uuid_from_text(k.cast("string")).alias("tracking_id"), k.cast("string").alias("site_id"),
                      day(k % 10).alias("valid_from"), F.when(k % 3 == 0, day(k % 10 + 10)).alias("valid_to"))
    again = sp.where(k % 6 == 0).select(uuid_from_text(k.cast("string")).alias("tracking_id"), F.concat(F.lit("new-"), k.cast("string")).alias("site_id"),
                                        day(k % 10 + 15).alias("valid_from"), F.lit(None).cast("timestamp_ntz").alias("valid_to"))
    return first.unionByName(again)


def boundary_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``logs`` with every 20th hit moved to the beginning of its five minutes
    and every 60th to the beginning of its day."""
    k, t = F.col("log_id").cast("bigint"), F.col("log_time")
    moved = F.when(k % 60 == 0, F.date_trunc("day", t).cast("timestamp_ntz")).when(k % 20 == 0, F.window(t, "5 minutes")["start"]).otherwise(t)
    return logs(spark, sf_dir).withColumn("log_time", moved)


# ---------------------------------------------------------------- users

def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``users_by_id`` from ``customer`` (id, email, full_name)."""
    c = read_table(spark, sf_dir, "customer")
    return c.select(_user_id(F.col("c_custkey")).alias("id"),
                    F.concat(F.lower("c_name"), F.lit("@example.com")).alias("email"),
                    F.col("c_name").alias("full_name"))


def user_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch of sign-ups, one per customer, in key order: every 10th has an
    invalid e-mail, every other 5th reuses a registered e-mail, every 7th of
    the rest shares one of three e-mails inside the batch; passwords of keys
    under 1,000 are too short."""
    c = read_table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    email = (F.when(k % 10 == 0, F.lit("no-at-sign"))
             .when(k % 5 == 0, F.concat(F.lower("c_name"), F.lit("@example.com")))
             .when(k % 7 == 0, F.concat(F.lit("shared"), (k % 3).cast("string"),
                                        F.lit("@example.com")))
             .otherwise(F.concat(F.lit("new"), k.cast("string"), F.lit("@example.com"))))
    sent = ntz_lit(REQUEST_EPOCH) + F.make_dt_interval(
        F.lit(0), F.lit(0), F.lit(0), k.cast("decimal(18,6)"))
    return c.select(k.alias("request_id"), k.alias("arrival"), email.alias("email"),
                    F.concat(F.lit("pw"), k.cast("string")).alias("password"),
                    F.col("c_name").alias("full_name"), sent.alias("requested_at"))


def new_user_id() -> Column:
    """Id of an accepted sign-up: a time id of its request time."""
    return time_uuid(F.col("requested_at"), F.col("request_id"))


def user_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full-name updates for every 11th customer (two for every 22nd, the
    later one wins) plus updates of ids nobody owns."""
    c = read_table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    first = c.where(k % 11 == 0).select(_user_id(k).alias("id"), F.lit(1).alias("seq"),
                                        F.concat(F.lit("Earlier Name "), k.cast("string")).alias("full_name"))
    second = c.where(k % 22 == 0).select(_user_id(k).alias("id"), F.lit(2).alias("seq"),
                                         F.concat(F.lit("Later Name "), k.cast("string")).alias("full_name"))
    unknown = c.where(k % 11 == 0).select(_user_id(k + UNKNOWN_NODE_OFFSET).alias("id"),
                                          F.lit(1).alias("seq"), F.lit("nobody").alias("full_name"))
    return first.unionByName(second).unionByName(unknown)


def user_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One look-up per customer: malformed id for keys ending in 0, an id
    nobody owns for keys ending in 1, the customer's id otherwise."""
    c = read_table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    rid = (F.when(k % 10 == 0, F.lit("not-an-id"))
           .when(k % 10 == 1, _user_id(k + UNKNOWN_NODE_OFFSET))
           .otherwise(_user_id(k)))
    return c.select(k.alias("request_id"), rid.alias("id"))


# ---------------------------------------------------------------- sites

def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``sites_by_id`` from ``orders``: a site per order, owned by its
    customer, created at the order date."""
    o = read_table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    return o.select(_site_id(k, F.col("o_orderdate")).alias("id"),
                    F.concat(F.lit("site"), k.cast("string"), F.lit(".example.com")).alias("domain"),
                    _user_id(F.col("o_custkey")).alias("user_id"),
                    uuid_from_text(k.cast("string")).alias("tracking_id"))


def site_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A site creation per order; every 10th names a malformed user id."""
    o = read_table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    owner = F.when(k % 10 == 0, F.lit("not-an-id")).otherwise(_user_id(F.col("o_custkey")))
    return o.select(k.alias("request_id"), owner.alias("user_id"),
                    F.concat(F.lit("site"), k.cast("string"), F.lit(".example.com")).alias("domain"),
                    _site_id(k, F.col("o_orderdate")).alias("new_id"),
                    uuid_from_text(k.cast("string")).alias("new_tracking"))


def site_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders")
    k, d = F.col("o_orderkey"), F.col("o_orderdate")
    dom = lambda p: F.concat(F.lit(p), k.cast("string"), F.lit(".example.com"))
    first = o.where(k % 11 == 0).select(_site_id(k, d).alias("id"), F.lit(1).alias("seq"),
                                        dom("earlier").alias("domain"))
    second = o.where(k % 22 == 0).select(_site_id(k, d).alias("id"), F.lit(2).alias("seq"),
                                         dom("later").alias("domain"))
    unknown = o.where(k % 11 == 0).select(_site_id(k + UNKNOWN_NODE_OFFSET, d).alias("id"),
                                          F.lit(1).alias("seq"), dom("nobody").alias("domain"))
    return first.unionByName(second).unionByName(unknown)


def site_deletes(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders")
    k, d = F.col("o_orderkey"), F.col("o_orderdate")
    known = o.where(k % 13 == 0).select(_site_id(k, d).alias("id"),
                                        _user_id(F.col("o_custkey")).alias("user_id"))
    unknown = o.where(k % 13 == 0).select(_site_id(k + UNKNOWN_NODE_OFFSET, d).alias("id"),
                                          _user_id(F.col("o_custkey")).alias("user_id"))
    return known.unionByName(unknown)


def site_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders")
    k, d = F.col("o_orderkey"), F.col("o_orderdate")
    rid = (F.when(k % 10 == 0, F.lit("not-an-id"))
           .when(k % 10 == 1, _site_id(k + UNKNOWN_NODE_OFFSET, d))
           .otherwise(_site_id(k, d)))
    return o.select(k.alias("request_id"), rid.alias("id"))


def site_list_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer asks for its site list; so does an unknown user per
    customer, and every 10th asks with a malformed id."""
    c = read_table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    known = c.select(k.alias("request_id"),
                     F.when(k % 10 == 0, F.lit("not-an-id")).otherwise(_user_id(k)).alias("user_id"))
    unknown = c.select((-k - 1).alias("request_id"), _user_id(k + UNKNOWN_NODE_OFFSET).alias("user_id"))
    return known.unionByName(unknown)


def id_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    return o.select(k.alias("request_id"),
                    F.when(k % 10 == 0, F.lit("not-an-id"))
                    .otherwise(uuid_from_text(k.cast("string"))).alias("id"))


# ---------------------------------------------------------------- load tests

def request_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per request of a load test: ``dropped`` (queue full, never
    sent), ``failed`` (sent, no response) or ``ok`` with a status; elapsed
    time for every sent request."""
    ev = read_table(spark, sf_dir, "events")
    eid = F.col("event_id")
    outcome = (F.when(eid % 20 == 0, F.lit("dropped")).when(eid % 33 == 0, F.lit("failed"))
               .otherwise(F.lit("ok")))
    status = F.when(outcome == "ok", F.when(F.col("event_type") == "error", F.lit(500))
                    .otherwise(F.lit(200)))
    elapsed = F.when(outcome != "dropped", F.floor("value").cast("bigint"))
    return ev.select(F.col("ts"), status.cast("int").alias("status"), outcome.alias("outcome"),
                     elapsed.alias("elapsed_ms"))
