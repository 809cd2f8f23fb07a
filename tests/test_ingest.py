import datetime as dt

from pyspark.sql import functions as F

from hitlens.functions.timeid import uuid_from_text
from hitlens.operators import ingest as ing
from hitlens.sources import model

from .conftest import SF001

T = dt.datetime(2024, 1, 1)


def _raw(spark, bodies, tracking="123e4567-e89b-12d3-a456-426614174000"):
    rows = [(str(i), tracking, T, b) for i, b in enumerate(bodies)]
    return spark.createDataFrame(rows, "hit_id string, tracking_id string, log_time timestamp_ntz, body string")


def test_bad_hits(spark):
    bodies = ['{"url":"/","ipAddress":"1","userAgent":"x"}',
              '{"url":"/","ipAddress":"1"}',
              '{"url":"/","ipAddress":"1","userAgent":"x","extra":true}',
              "<html>", "", '[1,2]', None,
              '{"url":1,"ipAddress":{"a":1},"userAgent":[1,2]}', '{"url":"/","ipAddress":"1","userAgent":"x"} tail',
              '{"url":"/","ipAddress":"1","userAgent":"x"}{"url":"/"}', "{'url':'/','ipAddress':'1','userAgent':'x'}",
              '{"url":true,"ipAddress":"1","userAgent":"x"}', '{"url":null,"ipAddress":"1","userAgent":"x"}', '{}',
              '{"url":"/","ipAddress":"1","userAgent":"x"},{}', '{"url":"/","ipAddress":"1","userAgent":"x"}],[{}']
    dec = ing.decode_hits(_raw(spark, bodies))
    got = {r.hit_id: r.reason for r in dec.collect()}
    assert got == {"0": None, "1": "missing_field", "2": None, "3": "malformed", "4": "malformed",
                   "5": "malformed", "6": "malformed", "7": "wrong_type", "8": "malformed", "9": "malformed",
                   "10": "malformed", "11": "wrong_type", "12": "missing_field", "13": "missing_field",
                   "14": "malformed", "15": "malformed"}
    good = ing.good_hits(dec)
    assert good.columns == ["hit_id", "tracking_id", "log_time", "url", "ip_address", "user_agent"]
    q = ing.quarantine(dec)
    assert {r.status for r in q.collect()} == {400}


def test_resolve_statuses(spark):
    reg = spark.createDataFrame([("123e4567-e89b-12d3-a456-426614174000", "site-1")],
                                "tracking_id string, site_id string")
    hits = spark.createDataFrame(
        [("a", "123e4567-e89b-12d3-a456-426614174000"), ("b", "00000000-0000-0000-0000-000000000000"),
         ("c", "not-an-id")], "hit_id string, tracking_id string")
    got = {r.hit_id: (r.site_id, r.status) for r in ing.resolve_hits(hits, reg).collect()}
    assert got == {"a": ("site-1", 202), "b": (None, 404), "c": (None, 400)}


def test_resolved_hits_carry_site_id(spark):
    out = ing.ingest(model.raw_hits(spark, SF001), model.sites_by_tracking(spark, SF001))
    total = out.count()
    assert total == model.raw_hits(spark, SF001).count()
    acc = out.where(F.col("outcome") == "accepted")
    # the queued message carries the site id, not the tracking id
    check = acc.where(uuid_from_text(F.col("site_id")) != F.col("tracking_id"))
    assert check.count() == 0


def test_dedupe_redelivery(spark):
    lg = model.redelivered_logs(spark, SF001)
    once = ing.dedupe(lg, ["log_id"])
    assert lg.count() > once.count() == model.logs(spark, SF001).count()
