"""The user and site registry as tables.

``sites_by_id`` and ``users_by_id`` are the base tables; the access tables
(by tracking id, by user, by e-mail) are projections of them, so an update or
delete of the base can never leave an orphan behind. Batches of requests are
applied with joins; every request gets a status.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import status
from ..functions.timeid import is_uuid, time_of_uuid
from ..functions.validation import MIN_PASSWORD_LENGTH, email_rule, errors_text, min_length_rule, validate

USER_RULES = [email_rule("email"), min_length_rule("password", MIN_PASSWORD_LENGTH)]


# ---------------------------------------------------------------- access tables

def sites_by_tracking_id(sites: DataFrame) -> DataFrame:
    return sites.select("tracking_id", F.col("id").alias("site_id"))


def sites_by_users(sites: DataFrame) -> DataFrame:
    return sites.select("user_id", F.col("id").alias("site_id"))


def users_by_credentials(users: DataFrame) -> DataFrame:
    return users.select("email", F.col("id").alias("user_id"))


def asked_for(table: DataFrame, requests: DataFrame, keys: list[str], broadcast: bool) -> DataFrame:
    """The table's rows that a batch asks for. A caller that knows its batch
    to be small asks for a broadcast of the batch's keys: the table is then
    scanned but not shuffled. Otherwise the table itself, and AQE plans the
    join that follows on measured sizes. Either way the same results."""
    if not broadcast:
        return table
    wanted = requests.select(*keys).dropna().distinct()
    return table.join(F.broadcast(wanted), keys, "left_semi")


# ---------------------------------------------------------------- look-ups

def find_by_id(requests: DataFrame, table: DataFrame, created: str = "created_date",
               broadcast: bool = False) -> DataFrame:
    """Requests (request_id, id) against a table keyed by ``id``: the row (or
    nulls) plus 200 / 404 / 400, the text of the 400 and the creation time of
    the id."""
    valid = is_uuid(F.col("id"))
    keyed = requests.withColumn("_key", F.when(valid, F.col("id")))
    rows = asked_for(table.withColumnRenamed("id", "_key"), keyed, ["_key"], broadcast)
    joined = keyed.join(rows.withColumn("_found", F.lit(True)), "_key", "left")
    st = (F.when(F.col("_key").isNull(), F.lit(status.BAD_REQUEST))
          .when(F.col("_found").isNull(), F.lit(status.NOT_FOUND))
          .otherwise(F.lit(status.OK)))
    return (joined.withColumn("status", st).withColumn("message", bad_id_message("status"))
            .withColumn(created, F.when(F.col("status") == status.OK, time_of_uuid(F.col("id"))))
            .drop("_key", "_found"))


def bad_id_message(st: str):
    return F.when(F.col(st) == status.BAD_REQUEST, F.lit(status.BAD_UUID))


def list_sites(requests: DataFrame, by_user: DataFrame, broadcast: bool = False) -> DataFrame:
    """Site ids and creation dates of each requested user. An unknown user
    has an empty list, a malformed id is refused: neither has rows here (see
    ``list_sites_outcomes``)."""
    ok = requests.where(is_uuid(F.col("user_id")))
    return (ok.join(asked_for(by_user, ok, ["user_id"], broadcast), "user_id", "inner")
            .select("request_id", "user_id", "site_id",
                    time_of_uuid(F.col("site_id")).alias("created_date")))


def list_sites_outcomes(requests: DataFrame, by_user: DataFrame, broadcast: bool = False) -> DataFrame:
    """Every listing request once: 200 and the number of sites (0 for an
    unknown user), or 400 and its text for a malformed id."""
    valid = is_uuid(F.col("user_id"))
    owned = (asked_for(by_user, requests, ["user_id"], broadcast)
             .groupBy(F.col("user_id").alias("_key")).agg(F.count(F.lit(1)).alias("n_sites")))
    joined = requests.withColumn("_key", F.when(valid, F.col("user_id"))).join(owned, "_key", "left")
    st = F.when(F.col("_key").isNull(), F.lit(status.BAD_REQUEST)).otherwise(F.lit(status.OK))
    return (joined.withColumn("status", st).withColumn("message", bad_id_message("status"))
            .withColumn("n_sites", F.when(F.col("status") == status.OK, F.coalesce("n_sites", F.lit(0))))
            .select("request_id", "user_id", "n_sites", "status", "message"))


# ---------------------------------------------------------------- creation

def validate_users(requests: DataFrame) -> DataFrame:
    v = validate(requests, USER_RULES)
    return v.select("request_id", F.size("errors").alias("n_errors"),
                    errors_text("errors").alias("errors"))


def create_users(requests: DataFrame, by_email: DataFrame, new_id,
                 broadcast: bool = False) -> tuple[DataFrame, DataFrame]:
    """Apply a batch of sign-ups (request_id, arrival, email, password,
    full_name, ...) in arrival order against the e-mail registry.

    Returns (accepted, rejected), two filters of ``sign_up_outcomes``.
    """
    out = sign_up_outcomes(requests, by_email, new_id, broadcast)
    accepted = (out.where(F.col("status") == status.OK)
                .select("request_id", "user_id", "email", "full_name", "status"))
    rejected = (out.where(F.col("status") != status.OK)
                .select("request_id", "email", "status", "message"))
    return accepted, rejected


def sign_up_outcomes(requests: DataFrame, by_email: DataFrame, new_id,
                     broadcast: bool = False) -> DataFrame:
    """Every request once, with status 200 (and the new user id) or 400 and
    the message.

    A request is accepted when its fields pass the rules, its e-mail is not
    registered and no earlier request of the batch took it. The first valid
    request per e-mail is aggregated before any join, so one e-mail holding a
    third of the batch costs one row per task; only those first requests meet
    the registry, and the outcome joins back on the unique request id. The
    password is checked, never kept.
    """
    v = validate(requests, USER_RULES)
    first = (v.where(F.size("errors") == 0).groupBy("email")
             .agg(F.min(F.struct("arrival", "request_id")).alias("_first"))
             .select("email", F.col("_first.request_id").alias("request_id")))
    taken = asked_for(by_email.select("email"), requests, ["email"], broadcast)
    winners = (first.join(taken, "email", "left_anti")
               .select("request_id", F.lit(True).alias("_winner")))
    out = v.join(winners, "request_id", "left")
    st = F.when(F.col("_winner"), F.lit(status.OK)).otherwise(F.lit(status.BAD_REQUEST))
    message = (F.when(F.col("_winner"), F.lit(None).cast("string"))
               .when(F.size("errors") > 0, errors_text("errors"))
               .otherwise(F.lit(status.EMAIL_ALREADY_EXISTS)))
    return (out.withColumn("status", st).withColumn("message", message)
            .withColumn("user_id", F.when(F.col("_winner"), new_id))
            .drop("_winner", "errors"))


def site_create_outcomes(requests: DataFrame, new_id, new_tracking) -> DataFrame:
    """Every creation request once: 200 and the created site (id, domain,
    tracking id, creation time), or 400 and the text for a malformed user id."""
    ok = is_uuid(F.col("user_id"))
    st = F.when(ok, F.lit(status.OK)).otherwise(F.lit(status.BAD_REQUEST))
    out = requests.select("request_id", "user_id", "domain", F.when(ok, new_id).alias("id"),
                          F.when(ok, new_tracking).alias("tracking_id"), st.alias("status"))
    return (out.withColumn("message", bad_id_message("status"))
            .withColumn("created_date", F.when(F.col("id").isNotNull(), time_of_uuid(F.col("id")))))


def new_sites(requests: DataFrame, new_id, new_tracking) -> DataFrame:
    """Site creation: one base row per request (user id checked); the access
    tables follow by projection."""
    ok = requests.where(is_uuid(F.col("user_id")))
    return ok.select(new_id.alias("id"), "domain", "user_id", new_tracking.alias("tracking_id"))


# ---------------------------------------------------------------- update / delete

def apply_updates(table: DataFrame, updates: DataFrame, values: list[str], key: str = "id",
                  order: str = "seq", broadcast: bool = False) -> tuple[DataFrame, DataFrame]:
    """Update-if-present. The last update per key wins: max over (order,
    values), combined map-side. Returns (table after, outcomes)."""
    last = (updates.groupBy(key)
            .agg(F.max(F.struct(order, *values)).alias("_u"))
            .select(key, *[F.col(f"_u.{v}").alias(f"_new_{v}") for v in values]))
    after = table.join(F.broadcast(last) if broadcast else last, key, "left")
    for v in values:
        after = after.withColumn(v, F.coalesce(F.col(f"_new_{v}"), F.col(v))).drop(f"_new_{v}")
    after = after.select(*table.columns)
    return after, _presence(updates, table, key, broadcast)


def apply_deletes(table: DataFrame, deletes: DataFrame, key: str = "id",
                  broadcast: bool = False) -> tuple[DataFrame, DataFrame]:
    """Delete-if-present from the base table; returns (table after, outcomes)."""
    gone = deletes.select(key).distinct()
    after = table.join(F.broadcast(gone) if broadcast else gone, key, "left_anti")
    return after, _presence(deletes, table, key, broadcast)


def _presence(requests: DataFrame, table: DataFrame, key: str, broadcast: bool = False) -> DataFrame:
    present = asked_for(table.select(key), requests, [key], broadcast).distinct().withColumn("_present", F.lit(True))
    joined = requests.join(present, key, "left")
    st = (F.when(~is_uuid(F.col(key)), F.lit(status.BAD_REQUEST))
          .when(F.col("_present").isNull(), F.lit(status.NOT_FOUND))
          .otherwise(F.lit(status.OK)))
    return joined.withColumn("status", st).drop("_present")
