import datetime as dt
import uuid

from pyspark.sql import functions as F

from hitlens.functions import dates, timeid
from hitlens.functions.validation import email_rule, errors_text, min_length_rule, validate


def test_time_uuid_roundtrip_and_layout(spark):
    t = dt.datetime(2024, 3, 10, 2, 30, 0, 123456)
    df = spark.createDataFrame([(t, 7)], "ts timestamp_ntz, node long")
    row = df.select(timeid.time_uuid("ts", F.col("node")).alias("u")).withColumn(
        "back", timeid.time_of_uuid("u")).first()
    u = uuid.UUID(row.u)
    assert u.version == 1
    # uuid1 time field: 100 ns since 1582-10-15
    expected_ticks = int((t.replace(microsecond=123000) - dt.datetime(1970, 1, 1)).total_seconds()
                         * 1000) * 10000 + 0x01B21DD213814000
    assert u.time == expected_ticks
    assert u.node == 7
    assert row.back == dt.datetime(2024, 3, 10, 2, 30, 0, 123000)


def test_time_of_python_uuid1(spark):
    u = uuid.uuid1()
    ms = (u.time - 0x01B21DD213814000) // 10000
    expected = dt.datetime(1970, 1, 1) + dt.timedelta(milliseconds=ms)
    got = spark.createDataFrame([(str(u),)], "u string").select(timeid.time_of_uuid("u")).first()[0]
    assert got == expected


def test_epoch_is_zone_free(spark):
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        df = spark.createDataFrame([(dt.datetime(2024, 3, 10, 2, 30),)], "ts timestamp_ntz")
        us = df.select(timeid.epoch_micros("ts")).first()[0]
        assert us == 1710037800000000
        txt = df.select(dates.date_text("ts")).first()[0]
        assert txt == "10:03:24:02:30:00.000"
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_is_uuid(spark):
    rows = [("123e4567-e89b-12d3-a456-426614174000", True), ("not-an-id", False),
            ("", False), (None, False), ("123e4567e89b12d3a456426614174000", False),
            ("123e4567-e89b-12d3-a456-42661417400g", False)]
    df = spark.createDataFrame(rows, "id string, expected boolean")
    got = df.select(timeid.is_uuid("id").alias("v"), "expected").collect()
    assert all(r.v == r.expected for r in got)


def test_date_text_roundtrip(spark):
    t = dt.datetime(2024, 1, 2, 3, 4, 5, 678000)
    df = spark.createDataFrame([(t,)], "ts timestamp_ntz")
    r = df.select(dates.date_text("ts").alias("t")).withColumn("p", dates.parse_date_text("t")).first()
    assert r.t == "02:01:24:03:04:05.678"
    assert r.p == t


def test_validation_rules(spark):
    rows = [("valid@example.com", "foobar"), ("no-at-sign", "foobar"), ("valid@example.com", "foo"),
            ("   ", "fo"), ("a.b+c@sub.example.org", "123456")]
    df = spark.createDataFrame(rows, "email string, password string")
    v = validate(df, [email_rule("email"), min_length_rule("password", 6)])
    got = [r.t for r in v.select(errors_text().alias("t")).collect()]
    assert got == ["", "email: field email is not a valid email",
                   "password: password length must be greater than 6",
                   "email: field email is not a valid email; password: password length must be greater than 6",
                   ""]


def test_validation_unknown_field_raises(spark):
    import pytest
    df = spark.createDataFrame([("a",)], "email string")
    with pytest.raises(ValueError, match="No such field"):
        validate(df, [min_length_rule("password", 6)])
