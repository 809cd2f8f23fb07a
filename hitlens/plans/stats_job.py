"""The statistics job: one tick, or a backfill of many windows.

Order of work for a run over the windows ``[first, last]`` (window ends):

1. due windows (calendar) minus those already in the ledger (skip done work);
2. hits of the pending windows: a plain ``log_time`` range (pushed to the
   Parquet scan, prunes ``log_date`` partitions). Pending windows without
   gaps need no more; with gaps their small list is broadcast. The hits
   themselves are never shuffled before they are aggregated;
3. all four statistics levels in one pass, staged as Parquet in the shared
   checkpoint folder (``spark.checkpoint.dir``) so the writes below reuse one
   scan and survive the loss of executors; the staged folder goes at the end;
4. the partial tables, each replacing its windows: the four long forms as one
   table (``stats_levels``; the reference's per-level tables are its
   projections), then the map rows. What an earlier run stored for a window
   that now has no hits is removed;
5. the ledger rows of the pending windows, last - including windows without
   hits (0). A crash before leaves the windows pending, and the rerun
   replaces the same windows.

Days are open or closed. An open day has a folder per window, so a tick
writes its own windows and reads nothing. ``close_days`` puts each day into
one folder per table, its totals beside it, and the totals of all closed days
into one table; one small version file (``sinks.commit_version``) brings all
of it into force at once. A window of a closed day is replaced by rewriting
its day, under the same file.

The running totals are read as a sum of three levels: the closed totals, the
day totals of days closed since, and the windows of open days. No level is
ever added to in place, so reruns and repairs count nothing twice.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions.timeid import ntz_lit
from ..functions.windows import FIVE_MINUTES, StatDefinition
from ..operators import stats as st
from ..operators.lattice import coarsen, edges_of
from ..session import staging
from ..sources import sinks

# A list of pending windows up to this length is broadcast (16 bytes each).
MAX_BROADCAST_WINDOWS = 100_000
ATTEMPTS = 20
_STORED = {"stats_levels": schemas.STATS_LEVELS, "partial_stats": schemas.PARTIAL_STATS_STORED,
           "stats_reference": schemas.LEDGER_STORED}
# Tables that have a folder per window on open days and one per closed day.
_WINDOWED = ("stats_levels", "partial_stats")
# total -> (level of its partials, keys, schema)
_TOTALS = {"global_stats": ("site", ["site_id"], schemas.GLOBAL_STATS),
           "global_stats_url": ("url", ["site_id", "url"], schemas.GLOBAL_STATS_URL)}


def days_between(first: dt.datetime, last: dt.datetime) -> list[dt.date]:
    return [first.date() + dt.timedelta(days=i) for i in range((last.date() - first.date()).days + 1)]


def _sums(levels: list[DataFrame], name: str, *more: str) -> DataFrame:
    return st.sum_levels(levels, [*_TOTALS[name][1], *more])


@dataclass(frozen=True)
class StatsStore:
    """Folder layout of the statistics tables.

    Parts of the version file: ``table/stat_type/day`` for a closed day of a
    windowed table, ``total/daily/day`` for its totals, ``total`` for
    the closed totals; its mark names the base type and the day that the
    closed totals end before."""
    root: str

    def path(self, table: str) -> str:
        return f"{self.root.rstrip('/')}/{table}"

    def manifest(self, spark: SparkSession) -> sinks.Manifest:
        return sinks.read_manifest(spark, self.root.rstrip("/"), "statistics")

    def commit(self, spark: SparkSession, before: sinks.Manifest, parts: dict, **mark) -> None:
        whole = {**self.marks(before), **mark}
        sinks.commit_version(spark, self.root.rstrip("/"), "statistics", before, parts, json.dumps(whole))

    @staticmethod
    def marks(at: sinks.Manifest) -> dict:
        return json.loads(at.mark) if at.mark else {"base": None, "through": None}

    def record_base(self, spark: SparkSession, base_type: str) -> None:
        """The stat type that totals are made of: the same for a store's life."""
        for _ in range(ATTEMPTS):
            at = self.manifest(spark)
            known = self.marks(at)["base"]
            if known == base_type:
                return
            if known is not None:
                raise ValueError(f"totals are made of {known} windows, not of {base_type}")
            try:
                return self.commit(spark, at, at.parts, base=base_type)
            except sinks.VersionConflict:
                continue

    @staticmethod
    def closed_days(at: sinks.Manifest, table: str, stat_type: str | None = None) -> dict[tuple[str, dt.date], str]:
        keyed = {tuple(k.split("/")): f for k, f in at.parts.items() if k.startswith(f"{table}/")}
        return {(x, dt.date.fromisoformat(d)): f for (_, x, d), f in keyed.items() if stat_type in (None, x)}

    def open_days(self, spark: SparkSession, at: sinks.Manifest, table: str, stat_type: str | None = None) -> dict[tuple[str, dt.date], str]:
        """The folders of open days. A closed day's old folder, left by a crash, is none."""
        closed, out = self.closed_days(at, table), {}
        for kind in sinks.children(spark, self.path(table), "stat_type="):
            if stat_type in (None, kind):
                for day in sinks.children(spark, f"{self.path(table)}/stat_type={kind}", "stat_date="):
                    key = (kind, dt.date.fromisoformat(day))
                    if key not in closed:
                        out[key] = f"{self.path(table)}/stat_type={kind}/stat_date={day}"
        return out

    def _load(self, spark: SparkSession, table: str, open_folders, closed_folders) -> DataFrame | None:
        schema, frames = _STORED[table], []
        if open_folders:
            frames.append(spark.read.option("basePath", self.path(table)).schema(schema).parquet(*open_folders))
        if closed_folders:
            frames.append(spark.read.schema(schema).parquet(*closed_folders))
        if not frames:
            return None
        return frames[0] if len(frames) == 1 else frames[0].unionByName(frames[1])

    def read(self, spark: SparkSession, table: str) -> DataFrame | None:
        """A stored table, or None when it was never written."""
        if table not in _WINDOWED:
            return sinks.read_or_none(spark, self.path(table), _STORED[table])
        at = self.manifest(spark)
        found = self._load(spark, table, self.open_days(spark, at, table).values(), self.closed_days(at, table).values())
        if found is None and at.seq:
            return spark.createDataFrame([], _STORED[table])
        return found

    def read_days(self, spark: SparkSession, table: str, stat_type: str, days) -> DataFrame | None:
        """Some days of one stat type; only their folders are listed."""
        if table not in _WINDOWED:
            return sinks.read_days(spark, self.path(table), _STORED[table], stat_type, days)
        closed = self.closed_days(self.manifest(spark), table, stat_type)
        open_ = [f"{self.path(table)}/stat_type={stat_type}/stat_date={d.isoformat()}" for d in days if (stat_type, d) not in closed]
        return self._load(spark, table, [f for f in open_ if sinks.exists(spark, f)], [f for (_, d), f in closed.items() if d in set(days)])

    def table(self, spark: SparkSession, name: str) -> DataFrame | None:
        """A table by its reference name: the per-level tables are
        projections of ``stats_levels``, the totals are sums of three levels,
        ``partial_stats`` is one row per site and window."""
        for level, (table, _) in st.LEVEL_TABLES.items():
            if name == table:
                long = self.read(spark, "stats_levels")
                return None if long is None else st.level_table(long, level)
        if name in _TOTALS:
            return self.totals(spark, name)
        stored = self.read(spark, name)
        if stored is None:
            return None
        if name == "partial_stats":
            return st.whole_partial_stats(stored)
        return stored.where("affected_records IS NOT NULL").drop("stat_date")

    def total_levels(self, spark: SparkSession, name: str, at: sinks.Manifest | None = None, through: dt.date | None = None) -> list[DataFrame]:
        """The three levels a running total is the sum of, up to the day
        ``through``: closed totals, day totals, windows of open days."""
        at = at or self.manifest(spark)
        base, mark = (self.marks(at)[x] for x in ("base", "through"))
        level, keys, schema = _TOTALS[name]
        last = through or dt.date.max
        out = [spark.read.schema(schema).parquet(at.parts[name])] if name in at.parts else []
        days = [f for (_, d), f in self.closed_days(at, name, "daily").items() if d <= last and (mark is None or d.isoformat() >= mark)]
        if days:
            out.append(spark.read.schema(schema).parquet(*days))
        windows = [f for (_, d), f in self.open_days(spark, at, "stats_levels", base).items() if d <= last] if base else []
        if windows:
            out.append(st.level_table(self._load(spark, "stats_levels", windows, []), level).select(*keys, F.col("requests").cast("bigint").alias("requests")))
        return out

    def totals(self, spark: SparkSession, name: str, through: dt.date | None = None) -> DataFrame | None:
        """Running totals of the base type, up to the day ``through``."""
        at = self.manifest(spark)
        levels = self.total_levels(spark, name, at, through)
        if not levels:
            return spark.createDataFrame([], _TOTALS[name][2]) if at.seq else None
        return _sums(levels, name)


def _write_days(rows: DataFrame, folder: str) -> dict[tuple[str, dt.date], str]:
    """Rows of several days, a folder each (in no other column's way); the folders written."""
    spark = rows.sparkSession
    dealt = rows.withColumn("type", F.col("stat_type")).withColumn("day", F.col("stat_date")).hint("rebalance", "type", "day")
    order = [c for c in ("type", "day", "stat_time", "level") if c in dealt.columns]
    dealt.sortWithinPartitions(*order).write.partitionBy("type", "day").parquet(folder)
    out = {}
    for kind in sinks.children(spark, folder, "type="):
        for day in sinks.children(spark, f"{folder}/type={kind}", "day="):
            out[(kind, dt.date.fromisoformat(day))] = f"{folder}/type={kind}/day={day}"
    return out


def _write_day_totals(levels: DataFrame, name: str, folder: str) -> dict[str, str]:
    """The totals of each day out of its level rows; the parts written."""
    level = _TOTALS[name][0]
    rows = st.level_table(levels, level).withColumn("day", F.to_date("stat_time"))
    _sums([rows], name, "day").hint("rebalance", "day").write.partitionBy("day").parquet(folder)
    return {f"{name}/daily/{day}": f"{folder}/day={day}" for day in sinks.children(levels.sparkSession, folder, "day=")}


def _retried(spark: SparkSession, store: StatsStore, change) -> None:
    """``change(at, folder)`` writes below ``folder`` and returns (parts,
    marks); once more from the version in force when another writer came first."""
    for _ in range(ATTEMPTS):
        at, folder = store.manifest(spark), store.path(f"days/{uuid.uuid4().hex}")
        parts, marks = change(at, folder)
        if parts is None:
            return
        try:
            return store.commit(spark, at, parts, **marks)
        except sinks.VersionConflict:
            sinks.remove(spark, folder)
    raise sinks.VersionConflict("the statistics are written by too many at once")


def close_days(spark: SparkSession, store: StatsStore, before: dt.date) -> None:
    """Close all days before ``before``: one folder a day and table, its
    totals beside it, and the totals of all closed days; then the windows'
    folders go."""
    gone: list[str] = []

    def change(at, folder):
        del gone[:]
        parts, base, frames = dict(at.parts), store.marks(at)["base"], {}
        for table in _WINDOWED:
            folders = [f for (_, d), f in store.open_days(spark, at, table).items() if d < before]
            gone.extend(folders)
            if folders:
                days = _write_days(store._load(spark, table, folders, []), f"{folder}/{table}")
                parts |= {f"{table}/{kind}/{d}": f for (kind, d), f in days.items()}
                frames[table] = [f for (kind, _), f in days.items() if kind == base]
        new = frames.get("stats_levels")
        for name in _TOTALS if base else ():
            if new:
                parts |= _write_day_totals(spark.read.schema(schemas.STATS_LEVELS).parquet(*new), name, f"{folder}/{name}-daily")
            # the days just closed are no open ones of these parts
            closed = store.total_levels(spark, name, sinks.Manifest(at.seq, parts, at.mark), before - dt.timedelta(days=1))
            if closed:
                _sums(closed, name).write.parquet(f"{folder}/{name}")
                parts[name] = f"{folder}/{name}"
        later = [x for x in (store.marks(at)["through"], before.isoformat()) if x]
        return parts, {"through": max(later)} if base else {}

    _retried(spark, store, change)
    sinks.remove_folders(spark, gone)


def write_windows(spark: SparkSession, levels: DataFrame, windows: DataFrame, stat: StatDefinition, store: StatsStore, days,
                  fragments: int | None = None, tables=_WINDOWED) -> None:
    """Replace the partial statistics of finished ``windows`` (stat_type,
    stat_time, affected_records): their folders on open days, their rows
    within closed days."""
    days = {r.d for r in windows.select(F.to_date("stat_time").alias("d")).distinct().collect()} & set(days)  # at most one row a day
    maps = (st.partial_stats(levels, stat, fragments).withColumn("fragments", F.lit(fragments)) if fragments
            else st.partial_stats_sized(levels, stat))
    rows = {"stats_levels": st.long_form(levels, stat),
            "partial_stats": maps.withColumn("stat_date", F.to_date("stat_time")).select(*schemas.PARTIAL_STATS_STORED.names)}
    rows = {table: rows[table] for table in tables}
    closed = {d for _, d in store.closed_days(store.manifest(spark), "stats_levels", stat.stat_type)} & set(days)
    open_ = ~F.col("stat_date").isin(sorted(closed)) if closed else F.lit(True)
    for table, frame in rows.items():
        sinks.overwrite_partitions(frame.where(open_), store.path(table))
    empty = windows.where("affected_records = 0").select("stat_time")
    clear_empty(spark, store, stat, empty, [d for d in days if d not in closed])

    def change(at, folder):
        touched = {d for _, d in store.closed_days(at, "stats_levels", stat.stat_type)} & set(days)
        if not touched:
            return None, {}
        parts, base = dict(at.parts), store.marks(at)["base"]
        here = F.col("stat_date").isin(sorted(touched))
        for table, frame in rows.items():
            old = store._load(spark, table, [], [f for (_, d), f in store.closed_days(at, table, stat.stat_type).items() if d in touched])
            new = frame.where(here)
            if old is not None:
                new = new.select(*old.columns).unionByName(old.join(windows.select("stat_time"), "stat_time", "left_anti"))
            for d in touched:
                parts.pop(f"{table}/{stat.stat_type}/{d}", None)
            written = _write_days(new, f"{folder}/{table}")
            # a day that has no hits any more stays closed, with an empty folder
            empty_day = f"{folder}/{table}-empty"
            if len(written) < len(touched):
                spark.createDataFrame([], _STORED[table]).write.parquet(empty_day)
            parts |= {f"{table}/{stat.stat_type}/{d}": written.get((stat.stat_type, d), empty_day) for d in touched}
        if base != stat.stat_type:
            return parts, {}
        levels_now = spark.read.schema(schemas.STATS_LEVELS).parquet(*(parts[f"stats_levels/{stat.stat_type}/{d}"] for d in sorted(touched)))
        for name in _TOTALS:
            for d in touched:
                parts.pop(f"{name}/daily/{d}", None)
            parts |= _write_day_totals(levels_now, name, f"{folder}/{name}-daily")
        through = store.marks(at)["through"]
        if through and min(touched).isoformat() < through:  # the closed totals hold the day as it was
            parts = {k: f for k, f in parts.items() if k not in _TOTALS}
            return parts, {"through": None}
        return parts, {}

    # also when a day was closed while its windows were written
    _retried(spark, store, change)


def clear_empty(spark: SparkSession, store: StatsStore, stat: StatDefinition, empty: DataFrame, days) -> None:
    """Remove what an earlier run stored for windows of open days that now have no hits."""
    for table in _WINDOWED:
        folders = [f"{store.path(table)}/stat_type={stat.stat_type}/stat_date={d.isoformat()}" for d in days]
        stored = store._load(spark, table, [f for f in folders if sinks.exists(spark, f)], [])
        if stored is not None:
            rows = sinks.with_file(stored, "stat_time")
            gone = rows.join(empty, "stat_time", "left_semi").select("file_path").distinct().collect()
            sinks.remove_folders(spark, {sinks.folder_of(r.file_path) for r in gone})


def write_ledger(spark: SparkSession, store: StatsStore, stat: StatDefinition, rows: DataFrame, days) -> None:
    """Ledger rows (stat_type, stat_time, affected_records): their days'
    partitions are rewritten with the rows merged in (one small file a day)."""
    new = rows.withColumn("stat_date", F.to_date("stat_time"))
    old = store.read_days(spark, "stats_reference", stat.stat_type, days)
    with staging(spark) as stage:
        if old is not None:
            touched = old.join(new.select("stat_date").distinct(), "stat_date", "left_semi")
            new = new.unionByName(touched.join(rows.select("stat_time"), "stat_time", "left_anti"))
        sinks.overwrite_partitions(stage(new, "ledger"), store.path("stats_reference"), sinks.DAY_PARTITIONS)


def _calendar(spark: SparkSession, stat: StatDefinition, first: dt.datetime,
              last: dt.datetime) -> DataFrame:
    bounds = spark.range(1).select(ntz_lit(first).alias("first"),
                                   ntz_lit(last).alias("last"))
    return st.calendar(bounds, stat)


def done_windows(spark: SparkSession, store: StatsStore, stat: StatDefinition, days) -> DataFrame | None:
    ledger = store.read_days(spark, "stats_reference", stat.stat_type, days)
    return None if ledger is None else ledger.where("affected_records IS NOT NULL")


def newest_window(spark: SparkSession, store: StatsStore, stat: StatDefinition, before: dt.datetime) -> dt.datetime | None:
    """The last ledger window before one: the newest days alone are read."""
    days = [dt.date.fromisoformat(x) for x in sinks.children(spark, f"{store.path('stats_reference')}/stat_type={stat.stat_type}", "stat_date=")]
    for day in reversed([d for d in days if d <= before.date()]):
        rows = store.read_days(spark, "stats_reference", stat.stat_type, [day])
        newest = rows.where(F.col("stat_time") < ntz_lit(before)).agg(F.max("stat_time")).first()[0]
        if newest is not None:
            return newest
    return None


def pending(spark: SparkSession, store: StatsStore, stat: StatDefinition,
            first: dt.datetime, last: dt.datetime) -> DataFrame:
    due = _calendar(spark, stat, first, last)
    ledger = done_windows(spark, store, stat, days_between(first, last))
    return due if ledger is None else st.pending_windows(due, ledger)


def check_aligned(stat: StatDefinition, *ends: dt.datetime) -> None:
    for end in ends:
        ms = (end - dt.datetime(1970, 1, 1)) / dt.timedelta(milliseconds=1)
        if ms % stat.range_ms:
            raise ValueError(f"{end} is not the end of a {stat.stat_type} window")


def hits_of(logs: DataFrame, todo: DataFrame, n_windows: int, stat: StatDefinition,
            first: dt.datetime, last: dt.datetime, edges: bool = False) -> DataFrame:
    """The hits of the pending windows (and of their edges), without a shuffle of hits."""
    lo = first - dt.timedelta(milliseconds=stat.range_ms)
    hits = logs.where((F.col("log_time") >= ntz_lit(lo)) & (F.col("log_time") < ntz_lit(last)))
    if "log_date" in logs.columns:  # a stored logs table: prune its day partitions
        hits = hits.where(F.col("log_date").between(F.lit(lo.date()), F.lit(last.date())))
    if n_windows == (last - first) / dt.timedelta(milliseconds=stat.range_ms) + 1:
        return hits
    windows = todo.select("stat_time")
    if n_windows <= MAX_BROADCAST_WINDOWS:
        windows = F.broadcast(windows)
    return st.windowed(hits, stat, closed_left=edges).join(windows, "stat_time", "left_semi").drop("stat_time")


def run_statistics(spark: SparkSession, logs: DataFrame, store: StatsStore,
                   stat: StatDefinition, first: dt.datetime, last: dt.datetime,
                   base_type: str = FIVE_MINUTES.stat_type, fragments: int | None = None, edges: bool = False) -> int:
    """Compute and write every window ending in ``[first, last]`` that the
    ledger does not hold yet. Returns the number of windows written. With
    ``edges`` the hits that lie on window boundaries are stored beside, for
    longer windows (``run_from_finer``)."""
    check_aligned(stat, first, last)
    days = days_between(first, last)
    store.record_base(spark, base_type)
    with staging(spark) as stage:
        todo = stage(pending(spark, store, stat, first, last), "pending")
        n_windows = todo.count()
        if n_windows == 0:
            return 0
        hits = hits_of(logs, todo, n_windows, stat, first, last, edges)
        levels = stage(st.stats_all_levels(hits, stat, edges=edges), "levels")
        _write_run(spark, store, stat, levels, todo, days, fragments, stage)
        return n_windows


def _write_run(spark: SparkSession, store: StatsStore, stat: StatDefinition, levels: DataFrame, todo: DataFrame, days, fragments, stage) -> None:
    """Partials of the windows ``todo``, their edges where the levels have any, ledger last."""
    def counted(rows: DataFrame, name: str) -> DataFrame:
        counts = rows.where(F.col("level") == "site").groupBy("stat_time").agg(F.sum("requests").alias("n"))
        return stage(todo.join(counts, "stat_time", "left")
                     .select("stat_type", "stat_time", F.coalesce("n", F.lit(0)).cast("bigint").alias("affected_records")), name)

    if "edge" in levels.columns:
        edges, levels = levels.where("edge").drop("edge"), levels.where("NOT edge").drop("edge")
        write_windows(spark, edges, counted(edges, "edge_counts"), edges_of(stat), store, days, fragments, tables=("stats_levels",))
    ledger = counted(levels, "counts")
    write_windows(spark, levels, ledger, stat, store, days, fragments)
    write_ledger(spark, store, stat, ledger, days)


def run_from_finer(spark: SparkSession, store: StatsStore, fine: StatDefinition, stat: StatDefinition, first: dt.datetime, last: dt.datetime,
                   base_type: str = FIVE_MINUTES.stat_type, fragments: int | None = None) -> int:
    """``run_statistics`` of longer windows out of stored shorter ones and
    their edges, without reading a hit. All the short windows must be in the ledger."""
    check_aligned(stat, first, last)
    store.record_base(spark, base_type)
    begin = first - dt.timedelta(milliseconds=stat.range_ms)
    days, fine_days = days_between(first, last), days_between(begin, last)
    with staging(spark) as stage:
        todo = stage(pending(spark, store, stat, first, last), "pending")
        n_windows = todo.count()
        if n_windows == 0:
            return 0
        missing = pending(spark, store, fine, begin + dt.timedelta(milliseconds=fine.range_ms), last).count()
        if missing:
            raise ValueError(f"{missing} windows of {fine.stat_type} are not computed yet")
        frames = []
        for kind, edge in ((fine, False), (edges_of(fine), True)):
            stored = store.read_days(spark, "stats_levels", kind.stat_type, fine_days)
            if stored is not None:
                inside = stored.where((F.col("stat_time") > ntz_lit(begin)) & (F.col("stat_time") <= ntz_lit(last)))
                frames.append(inside.select("level", "site_id", "stat_time", "key", "requests", F.lit(edge).alias("edge")))
        empty = spark.createDataFrame([], "level string, site_id string, stat_time timestamp_ntz, key string, requests long, edge boolean")
        for x in frames:
            empty = empty.unionByName(x)
        rows = coarsen(empty, fine, stat).join(F.broadcast(todo.select("stat_time")) if n_windows <= MAX_BROADCAST_WINDOWS else todo.select("stat_time"), "stat_time", "left_semi")
        _write_run(spark, store, stat, stage(rows, "levels"), todo, days, fragments, stage)
        return n_windows


def stale_windows(spark: SparkSession, logs: DataFrame, store: StatsStore, stat: StatDefinition,
                  first: dt.datetime, last: dt.datetime) -> DataFrame:
    """The account of late hits: windows whose hits in ``logs`` are not what
    the ledger has (stat_type, stat_time, affected_records, hits)."""
    check_aligned(stat, first, last)
    done = done_windows(spark, store, stat, days_between(first, last))
    if done is None:
        return spark.createDataFrame([], "stat_type string, stat_time timestamp_ntz, affected_records long, hits long")
    lo = first - dt.timedelta(milliseconds=stat.range_ms)
    hits = logs.where((F.col("log_time") >= ntz_lit(lo)) & (F.col("log_time") < ntz_lit(last)))
    counts = st.windowed(hits, stat).groupBy("stat_time").agg(F.count(F.lit(1)).alias("hits"))
    done = done.where(F.col("stat_time").between(ntz_lit(first), ntz_lit(last)))
    return (done.join(counts, "stat_time", "left").withColumn("hits", F.coalesce("hits", F.lit(0)))
            .where("hits <> affected_records").select("stat_type", "stat_time", "affected_records", "hits"))


def repair(spark: SparkSession, logs: DataFrame, store: StatsStore, stat: StatDefinition,
           first: dt.datetime, last: dt.datetime, base_type: str = FIVE_MINUTES.stat_type) -> int:
    """Reopen the windows that late hits belong to, and compute them again."""
    with staging(spark) as stage:
        reopened = stage(stale_windows(spark, logs, store, stat, first, last), "stale").select(
            "stat_type", "stat_time", F.lit(None).cast("bigint").alias("affected_records"))
        if reopened.isEmpty():
            return 0
        write_ledger(spark, store, stat, reopened, days_between(first, last))
    return run_statistics(spark, logs, store, stat, first, last, base_type)
