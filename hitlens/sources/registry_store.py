"""The stored registry: base tables and access tables, dealt by a hash of
their key into buckets (S10, S11).

A batch of creations, updates or deletes reads and rewrites only the buckets
that its keys fall into. All tables share one manifest (bucket -> folder), so
a batch's changes of the base and of its access tables come into force
together, by the creation of one small version file: there is never an
orphan. Of two writers one publishes first; the other finds the version taken
and applies its batch again to the new one.

Files are sorted by the table's key and carry its bloom filter, so a look-up
of some keys opens their buckets and reads the row groups that may hold them.

Every request of a batch has an outcome row. Outcomes are staged first; what
is stored and what is returned come from that one copy, which stays in
``outcomes`` (a folder per batch).
"""

from __future__ import annotations

import datetime as dt
import uuid
from dataclasses import dataclass
from typing import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import status
from ..functions.timeid import is_uuid, ntz_from_ltz, ntz_lit, time_of_uuid
from ..operators import registry as reg
from ..session import staging
from . import sinks

# table -> (schema, key)
TABLES = {"users_by_id": (schemas.USERS_BY_ID, "id"),
          "users_by_credentials": (schemas.USERS_BY_CREDENTIALS, "email"),
          "sites_by_id": (schemas.SITES_BY_ID, "id"),
          "sites_by_tracking_id": (schemas.SITES_BY_TRACKING_ID, "tracking_id"),
          "sites_by_users": (schemas.SITES_BY_USERS, "user_id"),
          "site_history": (schemas.SITE_HISTORY, "tracking_id")}
# base table -> its access tables, as projections
ACCESS = {"users_by_id": {"users_by_credentials": reg.users_by_credentials},
          "sites_by_id": {"sites_by_tracking_id": reg.sites_by_tracking_id, "sites_by_users": reg.sites_by_users}}
# Keys of a look-up up to this number are pushed into the scan as literals.
MAX_PUSHED_KEYS = 1_000
ATTEMPTS = 20


@dataclass(frozen=True)
class RegistryStore:
    """``buckets`` is fixed when the store is first written. ``row_group`` is
    the Parquet row group size in bytes."""
    spark: SparkSession
    root: str
    buckets: int = 256
    row_group: int = 8 << 20

    # ------------------------------------------------------------ reading

    def _manifest(self) -> sinks.Manifest:
        at = sinks.read_manifest(self.spark, self.root.rstrip("/"), "registry")
        if at.seq and int(at.mark) != self.buckets:
            raise ValueError(f"the registry has {at.mark} buckets, not {self.buckets}")
        return at

    def bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def _read(self, at: sinks.Manifest, name: str, buckets=None) -> DataFrame:
        wanted = range(self.buckets) if buckets is None else sorted(buckets)
        folders = [at.parts[f"{name}/{b}"] for b in wanted if f"{name}/{b}" in at.parts]
        schema = TABLES[name][0]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def table(self, name: str) -> DataFrame:
        """A base or access table of the version in force (empty before the first)."""
        return self._read(self._manifest(), name)

    def _touched(self, keys: DataFrame, key: str) -> set[int]:
        """The buckets of a batch's keys: at most one number a bucket."""
        return {r.b for r in keys.select(self.bucket(F.col(key)).alias("b")).where(F.col(key).isNotNull()).distinct().collect()}

    def rows_of(self, name: str, keys: DataFrame, key: str | None = None, at: sinks.Manifest | None = None) -> DataFrame:
        """The stored rows that may have the keys (a column ``key`` of
        ``keys``): of their buckets alone, and of few keys those rows alone."""
        own = TABLES[name][1]
        key = key or own
        few = keys.select(key).where(F.col(key).isNotNull()).distinct().limit(MAX_PUSHED_KEYS + 1)
        rows = self._read(at or self._manifest(), name, self._touched(keys, key))
        literals = [r[0] for r in few.collect()]
        if len(literals) > MAX_PUSHED_KEYS:
            return rows
        return rows.where(F.col(own).isin(literals)) if literals else rows.limit(0)

    def find(self, name: str, requests: DataFrame) -> DataFrame:
        """Look-up by id in a base table: one outcome a request (F3)."""
        return reg.find_by_id(requests, self.rows_of(name, requests.where(is_uuid(F.col("id")))))

    def list_sites(self, requests: DataFrame) -> DataFrame:
        """The sites of each asked user (F4)."""
        return reg.list_sites(requests, self.rows_of("sites_by_users", requests.where(is_uuid(F.col("user_id")))))

    # ------------------------------------------------------------ writing

    def _apply(self, change: Callable) -> DataFrame:
        """Run a batch against the version in force and publish the next one,
        again from the start when another writer was first.

        ``change(at, stage, keep)`` returns the batch's outcomes as ``keep``
        stored them, and per table (rows that go, rows that come)."""
        for _ in range(ATTEMPTS):
            at, batch = self._manifest(), uuid.uuid4().hex
            folder = f"{self.root.rstrip('/')}/outcomes/{batch}"

            def keep(df: DataFrame) -> DataFrame:
                df.write.parquet(folder)
                return self.spark.read.schema(df.schema).parquet(folder)

            with staging(self.spark) as stage:
                outcomes, changes = change(at, stage, keep)
                parts, written = dict(at.parts), []
                for name, (gone, new) in changes.items():
                    parts |= self._rewrite(at, stage, name, gone, new, batch, written)
                try:
                    sinks.commit_version(self.spark, self.root.rstrip("/"), "registry", at, {k: f for k, f in parts.items() if f}, str(self.buckets))
                    return outcomes
                except sinks.VersionConflict:
                    for path in [folder, *written]:
                        sinks.remove(self.spark, path)
        raise sinks.VersionConflict("the registry is written by too many at once")

    def _rewrite(self, at, stage, name: str, gone: DataFrame | None, new: DataFrame | None, batch: str, written: list) -> dict[str, str | None]:
        """Writes the touched buckets of a table; their new folders (None: no row is left)."""
        schema, key = TABLES[name]
        changed = [schemas.conform(x, schema) for x in (gone, new) if x is not None]
        touched = set().union(*(self._touched(x, key) for x in changed))
        if not touched:
            return {}
        rows = self._read(at, name, touched)
        if gone is not None:
            same = [F.col(f"n.{c}").eqNullSafe(F.col(f"g.{c}")) for c in schema.names]
            rows = rows.alias("n").join(schemas.conform(gone, schema).distinct().alias("g"), same, "left_anti")
        if new is not None:
            rows = rows.unionByName(schemas.conform(new, schema))
        folder = f"{self.root.rstrip('/')}/{name}/{batch}"
        (rows.withColumn("bucket", self.bucket(F.col(key))).hint("rebalance", "bucket").sortWithinPartitions("bucket", key)
             .write.option(f"parquet.bloom.filter.enabled#{key}", "true").option("parquet.block.size", str(self.row_group))
             .partitionBy("bucket").parquet(folder))
        written.append(folder)
        return {f"{name}/{b}": path if sinks.exists(self.spark, path := f"{folder}/bucket={b}") else None for b in touched}

    def _with_access(self, name: str, gone: DataFrame | None, new: DataFrame | None) -> dict:
        """A base table's change, and what follows from it for its access tables."""
        out = {name: (gone, new)}
        for access, project in ACCESS[name].items():
            out[access] = (None if gone is None else project(gone), None if new is None else project(new))
        return out

    def create_users(self, requests: DataFrame, new_id, broadcast: bool = False) -> DataFrame:
        """Store the accepted sign-ups; returns every request's outcome, with
        the created user's id and registration time."""
        def change(at, stage, keep):
            taken = self.rows_of("users_by_credentials", requests, "email", at)
            out = keep(reg.sign_up_outcomes(requests, taken, new_id, broadcast)
                       .select("request_id", "user_id", "email", "full_name", "status", "message")
                       .withColumn("registered_date", F.when(F.col("user_id").isNotNull(), time_of_uuid(F.col("user_id")))))
            new = out.where(F.col("status") == status.OK).select(F.col("user_id").alias("id"), "email", "full_name")
            return out, self._with_access("users_by_id", None, new)

        return self._apply(change)

    def create_sites(self, requests: DataFrame, new_id, new_tracking) -> DataFrame:
        """Store a site for every request with a well-formed user id; returns
        every request's outcome, with the created site."""
        def change(at, stage, keep):
            out = keep(reg.site_create_outcomes(requests, new_id, new_tracking))
            new = out.where(F.col("status") == status.OK)
            begun = new.select("tracking_id", F.col("id").alias("site_id"), F.col("created_date").alias("valid_from"), F.lit(None).cast("timestamp_ntz").alias("valid_to"))
            return out, self._with_access("sites_by_id", None, new.select(*schemas.SITES_BY_ID.names)) | {"site_history": (None, begun)}

        return self._apply(change)

    def update(self, name: str, updates: DataFrame, values: list[str], broadcast: bool = False) -> DataFrame:
        """Update-if-present of columns that are no keys; returns every
        update's outcome (200, 404 or 400)."""
        keys = {TABLES[x][1] for x in (name, *ACCESS[name])}
        if keys & set(values):
            raise ValueError(f"{sorted(keys & set(values))} are keys of tables")

        def change(at, stage, keep):
            rows = stage(self.rows_of(name, updates.where(is_uuid(F.col("id"))), at=at), "rows")
            after, outcomes = reg.apply_updates(rows, updates, values, broadcast=broadcast)
            return keep(outcomes), {name: (rows.join(updates.select("id").distinct(), "id", "left_semi"), after.join(updates.select("id").distinct(), "id", "left_semi"))}

        return self._apply(change)

    def delete(self, name: str, deletes: DataFrame, broadcast: bool = False, when: dt.datetime | None = None) -> DataFrame:
        """Delete-if-present from the base and its access tables; returns
        every request's outcome. A deleted site's tracking id was valid until
        ``when`` (UTC, now by default): ``site_history`` keeps that."""
        ended = ntz_lit(when) if when else ntz_from_ltz(F.current_timestamp())

        def change(at, stage, keep):
            rows = stage(self.rows_of(name, deletes.where(is_uuid(F.col("id"))), at=at), "rows")
            _, outcomes = reg.apply_deletes(rows, deletes, broadcast=broadcast)
            gone = stage(rows.join(deletes.select("id").distinct(), "id", "left_semi"), "gone")
            changes = self._with_access(name, gone, None)
            if name == "sites_by_id":
                valid = self.rows_of("site_history", gone, "tracking_id", at).where("valid_to IS NULL")
                valid = stage(valid.join(gone.select("tracking_id", F.col("id").alias("site_id")), ["tracking_id", "site_id"], "left_semi"), "valid")
                changes["site_history"] = (valid, valid.withColumn("valid_to", ended))
            return keep(outcomes), changes

        return self._apply(change)
