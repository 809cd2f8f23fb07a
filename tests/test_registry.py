import datetime as dt

from pyspark.sql import functions as F

from hitlens.functions.timeid import time_uuid
from hitlens.operators import registry as reg


def _users(spark):
    return spark.createDataFrame(
        [("11111111-1111-1111-8000-000000000001", "a@example.com", "Earlier Name")],
        "id string, email string, full_name string")


def _requests(spark, rows):
    t = dt.datetime(2024, 1, 1)
    return spark.createDataFrame([(i, i, e, p, n, t) for i, (e, p, n) in enumerate(rows)],
                                 "request_id long, arrival long, email string, password string, "
                                 "full_name string, requested_at timestamp_ntz")


def _new_id():
    return time_uuid(F.col("requested_at"), F.col("request_id"))


def test_create_users(spark):
    reqs = _requests(spark, [("valid@example.com", "foobar", "testUser"),
                             ("no-at-sign", "foobar", "x"),
                             ("other@example.com", "foo", "y"),
                             ("a@example.com", "foobar", "dup"),
                             ("valid@example.com", "foobar", "second")])
    acc, rej = reg.create_users(reqs, reg.users_by_credentials(_users(spark)), _new_id())
    accepted = {r.request_id: r for r in acc.collect()}
    assert list(accepted) == [0] and accepted[0].status == 200
    rejected = {r.request_id: r.message for r in rej.collect()}
    assert rejected == {1: "email: field email is not a valid email",
                        2: "password: password length must be greater than 6",
                        3: "There is another user with the same email",
                        4: "There is another user with the same email"}


def test_hot_email_first_wins(spark):
    rows = [("hot@example.com", "foobar", str(i)) for i in range(200)]
    acc, rej = reg.create_users(_requests(spark, rows), reg.users_by_credentials(_users(spark)), _new_id())
    assert [r.request_id for r in acc.collect()] == [0]
    assert rej.count() == 199


def test_find_update_delete(spark):
    sid = "11111111-1111-1111-8000-00000000000a"
    sites = spark.createDataFrame([(sid, "earlier.com", "u1", "t1"),
                                   ("22222222-1111-1111-8000-00000000000b", "bad-site.com", "u1", "t2")],
                                  "id string, domain string, user_id string, tracking_id string")
    upd = spark.createDataFrame([(sid, 1, "later.com"),
                                 ("33333333-1111-1111-8000-00000000000c", 1, "x.com")],
                                "id string, seq int, domain string")
    after, outcomes = reg.apply_updates(sites, upd, ["domain"])
    assert {r.id: r.domain for r in after.collect()}[sid] == "later.com"
    assert sorted(r.status for r in outcomes.collect()) == [200, 404]
    dels = spark.createDataFrame([("22222222-1111-1111-8000-00000000000b", "u1")], "id string, user_id string")
    after2, _ = reg.apply_deletes(after, dels)
    look = spark.createDataFrame([(1, "22222222-1111-1111-8000-00000000000b"), (2, sid), (3, "not-an-id")],
                                 "request_id int, id string")
    found = {r.request_id: r.status for r in reg.find_by_id(look, after2).collect()}
    assert found == {1: 404, 2: 200, 3: 400}
    # access tables are projections: the deleted site is gone from all of them
    assert reg.sites_by_tracking_id(after2).where(F.col("tracking_id") == "t2").count() == 0
    assert reg.sites_by_users(after2).count() == 1


def test_list_shows_ids_and_dates(spark):
    t = dt.datetime(2024, 5, 6, 7, 8, 9, 10000)
    sites = spark.createDataFrame([(t, 5, "u1")], "ts timestamp_ntz, node long, user_id string") \
        .select(time_uuid(F.col("ts"), F.col("node")).alias("site_id"), "user_id")
    req = spark.createDataFrame([(1, "u1"), (2, "00000000-0000-0000-0000-000000000000")],
                                "request_id int, user_id string")
    # user ids of this frame are not uuids: use real-shaped ones
    sites = sites.withColumn("user_id", F.lit("00000000-0000-0000-0000-000000000001"))
    req = spark.createDataFrame([(1, "00000000-0000-0000-0000-000000000001"),
                                 (2, "00000000-0000-0000-0000-000000000000")], "request_id int, user_id string")
    rows = reg.list_sites(req, sites).collect()
    assert [(r.request_id, r.created_date) for r in rows] == [(1, dt.datetime(2024, 5, 6, 7, 8, 9, 10000))]
    assert rows[0].site_id.split("-")[2].startswith("1")
