import datetime as dt

import pytest
from pyspark.sql import functions as F

from hitlens.functions.timeid import ntz_lit, time_uuid, uuid_from_text
from hitlens.operators import registry as reg
from hitlens.sources import model
from hitlens.sources.registry_store import RegistryStore

from .conftest import SF001

def new_id():
    return time_uuid(ntz_lit(dt.datetime(2024, 1, 1)), F.col("request_id"))


def _requests(spark, rows):
    return spark.createDataFrame(rows, "request_id long, arrival long, email string, password string, full_name string")


def test_create_find_update_delete(spark, scratch):
    store = RegistryStore(spark, scratch)
    assert store.table("users_by_id").count() == 0
    out = store.create_users(_requests(spark, [(1, 1, "a@x.org", "secret1", "A"), (2, 2, "a@x.org", "secret2", "B"), (3, 3, "b", "secret3", "C")]), new_id())
    assert {r.request_id: r.status for r in out.collect()} == {1: 200, 2: 400, 3: 400}
    # a later batch meets what is stored
    again = store.create_users(_requests(spark, [(4, 1, "a@x.org", "secret4", "D"), (5, 2, "c@x.org", "secret5", "E")]), new_id())
    assert {r.request_id: r.status for r in again.collect()} == {4: 400, 5: 200}
    users = {r.email: r.user_id for r in store.table("users_by_credentials").collect()}
    assert set(users) == {"a@x.org", "c@x.org"}
    sites = spark.createDataFrame([(1, users["a@x.org"], "one.org"), (2, users["a@x.org"], "two.org"), (3, "bad", "no.org")], "request_id long, user_id string, domain string")
    store.create_sites(sites, new_id(), uuid_from_text(F.col("request_id")))
    ids = {r.domain: r.id for r in store.table("sites_by_id").collect()}
    assert set(ids) == {"one.org", "two.org"}
    store.update("sites_by_id", spark.createDataFrame([(ids["one.org"], 1, "uno.org")], "id string, seq int, domain string"), ["domain"])
    find = lambda i: reg.find_by_id(spark.createDataFrame([(1, i)], "request_id long, id string"), store.table("sites_by_id")).first()
    assert find(ids["one.org"]).domain == "uno.org"
    store.delete("sites_by_id", spark.createDataFrame([(ids["one.org"],)], "id string"))
    gone = find(ids["one.org"])
    assert (gone.status, gone.domain, gone.message) == (404, None, None)
    assert find("nonsense").message == "The id that has been searched is not a valid UUID"
    assert store.table("sites_by_tracking_id").count() == store.table("sites_by_users").count() == 1


def _many(spark, n, first=0):
    """n sign-ups with distinct e-mails."""
    k = F.col("id") + first
    return spark.range(n).select(k.alias("request_id"), k.alias("arrival"), F.concat(F.md5(k.cast("string")), F.lit("@x.org")).alias("email"),
                                 F.lit("secret1").alias("password"), F.concat(F.lit("name "), k.cast("string")).alias("full_name"))


def _folders(store, name):
    return {k.split("/")[1]: f for k, f in store._manifest().parts.items() if k.startswith(name + "/")}


def test_a_batch_rewrites_its_buckets_alone(spark, scratch):
    store = RegistryStore(spark, scratch, buckets=16)
    store.create_users(_many(spark, 400), new_id())
    before = {n: _folders(store, n) for n in ("users_by_id", "users_by_credentials")}
    assert all(len(x) == 16 for x in before.values())
    ids = [r.id for r in store.table("users_by_id").limit(3).collect()]
    out = store.update("users_by_id", spark.createDataFrame([(i, 1, "new name") for i in [*ids, "bad", "00000000-0000-1000-8000-000000000000"]], "id string, seq int, full_name string"), ["full_name"])
    assert sorted(r.status for r in out.collect()) == [200] * 3 + [400, 404]
    after = _folders(store, "users_by_id")
    changed = {b for b in after if after[b] != before["users_by_id"][b]}
    assert 1 <= len(changed) <= 3 and _folders(store, "users_by_credentials") == before["users_by_credentials"]
    rows = {r.id: r.full_name for r in store.table("users_by_id").collect()}
    assert len(rows) == 400 and all(rows[i] == "new name" for i in ids) and sum(v == "new name" for v in rows.values()) == 3
    store.delete("users_by_id", spark.createDataFrame([(ids[0],)], "id string"))
    assert store.table("users_by_id").count() == store.table("users_by_credentials").count() == 399
    with pytest.raises(ValueError):
        store.update("users_by_id", spark.createDataFrame([], "id string, seq int, email string"), ["email"])
    with pytest.raises(ValueError):
        RegistryStore(spark, scratch, buckets=8).table("users_by_id")


def test_two_writers_at_once_are_both_kept(spark, scratch, monkeypatch):
    """The second writer reads the version that the first then replaces; it applies its batch to the new one."""
    from hitlens.sources import sinks

    store, real, entered = RegistryStore(spark, scratch, buckets=4), sinks.commit_version, []
    other = _requests(spark, [(1, 1, "same@x.org", "secret1", "A"), (2, 2, "first@x.org", "secret1", "B")])

    def commit(*args, **kwargs):
        if not entered:
            entered.append(1)
            assert {r.status for r in RegistryStore(spark, scratch, buckets=4).create_users(other, new_id()).collect()} == {200}
        return real(*args, **kwargs)

    monkeypatch.setattr(sinks, "commit_version", commit)
    out = store.create_users(_requests(spark, [(3, 1, "same@x.org", "secret1", "C"), (4, 2, "second@x.org", "secret1", "D")]), new_id())
    assert {r.request_id: r.status for r in out.collect()} == {3: 400, 4: 200}
    assert sorted(r.email for r in store.table("users_by_credentials").collect()) == ["first@x.org", "same@x.org", "second@x.org"]


def test_outcomes_stay_readable_and_name_what_was_stored(spark, scratch):
    store = RegistryStore(spark, scratch, buckets=2)
    random_id = lambda: F.concat(F.substring(new_id(), 1, 24), F.substring(F.md5(F.expr("uuid()")), 1, 12))
    outs = [store.create_users(_requests(spark, [(i, 1, f"u{i}@x.org", "secret1", "A")]), random_id()) for i in range(4)]
    bad = store.create_sites(spark.createDataFrame([(9, "bad", "no.org")], "request_id long, user_id string, domain string"), new_id(), uuid_from_text(F.col("request_id")))
    stored = {r.id for r in store.table("users_by_id").collect()}
    assert {o.first().user_id for o in outs} == stored and len(stored) == 4
    assert outs[0].first().registered_date == dt.datetime(2024, 1, 1)
    assert (bad.first().status, bad.first().message, bad.first().id) == (400, "The id that has been searched is not a valid UUID", None)


def test_a_look_up_reads_few_row_groups(spark, scratch):
    store = RegistryStore(spark, scratch, buckets=4, row_group=16 << 10)
    store.create_users(_many(spark, 40_000), new_id())
    emails = [r.email for r in _many(spark, 20, 100).select("email").collect()] + ["nobody@x.org"]
    asked = spark.createDataFrame([(e,) for e in emails], "email string")
    rows = store.rows_of("users_by_credentials", asked)
    frame = rows._jdf.queryExecution()
    found = frame.executedPlan().executeCollectPublic()
    scans = frame.executedPlan().collectLeaves()
    read = sum(scans.apply(i).metrics().apply("numOutputRows").value() for i in range(scans.size()))
    assert len(found) == 20 and read < 12_000, read
    whole = store.table("users_by_credentials").where(F.col("user_id") != "x")._jdf.queryExecution()
    whole.executedPlan().executeCollectPublic()
    leaves = whole.executedPlan().collectLeaves()
    assert sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size())) == 40_000
    ids = [(1, r.id) for r in store.table("users_by_id").limit(2).collect()]
    assert {r.status for r in store.find("users_by_id", spark.createDataFrame([*ids, (2, "bad")], "request_id long, id string")).collect()} == {200, 400}


def test_results_do_not_depend_on_the_plan(spark):
    sites, updates, deletes = model.sites(spark, SF001), model.site_updates(spark, SF001), model.site_deletes(spark, SF001)
    pairs = [reg.apply_updates(sites, updates, ["domain"], broadcast=b) + reg.apply_deletes(sites, deletes, broadcast=b)
             + (reg.find_by_id(model.site_lookups(spark, SF001), sites, broadcast=b),
                reg.list_sites_outcomes(model.site_list_requests(spark, SF001), reg.sites_by_users(sites), broadcast=b),
                reg.sign_up_outcomes(model.user_requests(spark, SF001), reg.users_by_credentials(model.users(spark, SF001)), model.new_user_id(), b))
             for b in (False, True)]
    for a, b in zip(*pairs):
        assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_a_broadcast_batch_leaves_the_table_where_it_is(spark):
    sites, deletes = model.sites(spark, SF001), model.site_deletes(spark, SF001)
    plan = reg.apply_deletes(sites, deletes, broadcast=True)[0]._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan


def test_building_a_query_adds_no_job(spark, monkeypatch):
    from pyspark.sql import DataFrame

    from hitlens.plans.catalog import QUERIES

    def refuse(*_):
        raise AssertionError("an action while a query is built")

    for action in ("collect", "count", "first", "toPandas", "isEmpty"):
        monkeypatch.setattr(type(spark.range(1)), action, refuse)
    for name in ("find_site", "find_user", "list_sites_by_user", "user_create_accepted", "user_create_rejected", "user_update",
                 "user_update_outcomes", "site_update", "site_update_outcomes", "site_delete", "site_delete_outcomes",
                 "resolve_hits", "unresolved_hits", "ingest_outcomes"):
        frame = QUERIES[name](spark, SF001)
        assert isinstance(frame, DataFrame) and "SinglePartition" not in frame._jdf.queryExecution().executedPlan().toString(), name
