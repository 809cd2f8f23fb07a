"""Per-site statistics over tumbling windows.

One scan of ``logs`` feeds every output: ``stats_all_levels`` groups with
grouping sets (Expand + one partial/final hash aggregate, one exchange), and
the requests / url / ip / browser tables are cuts of it. No group is ever
materialised: counting is map-side combined, so a site holding a third of all
hits costs one partial row per task, not a list of its hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.windows import FIVE_MINUTES, StatDefinition, with_window

# Level names of the long-form output, and the columns their keys come from.
LEVELS = ("site", "url", "ip", "browser")
KEY_OF_LEVEL = {"url": "url", "ip": "ip_address", "browser": "user_agent"}
# Rows that the histogram keys of a site and window are spread over.
FRAGMENTS = 16


def windowed(logs: DataFrame, stat: StatDefinition, closed_left: bool = False) -> DataFrame:
    """Hits with the end of their window as ``stat_time`` (boundary-ms hits dropped)."""
    return with_window(logs, "log_time", stat, closed_left=closed_left)


def stamp(df: DataFrame, stat: StatDefinition) -> DataFrame:
    """Year (of the window, UTC) and stat type on each result row."""
    return (df.withColumn("year", F.year("stat_time"))
              .withColumn("stat_type", F.lit(stat.stat_type)))


def partial_stats_requests(logs: DataFrame, stat: StatDefinition) -> DataFrame:
    agg = (windowed(logs, stat).groupBy("site_id", "stat_time")
           .agg(F.count(F.lit(1)).alias("requests")))
    return stamp(agg, stat).select("site_id", "year", "stat_time", "stat_type", "requests")


def partial_stats_keyed(logs: DataFrame, stat: StatDefinition, key: str, name: str) -> DataFrame:
    """Requests per site, window and one key (url, ip, user agent); INT counts
    as in the reference's tables."""
    agg = (windowed(logs, stat).groupBy("site_id", "stat_time", F.col(key).alias(name))
           .agg(F.count(F.lit(1)).cast("int").alias("requests")))
    return stamp(agg, stat).select("site_id", "year", "stat_time", "stat_type", name, "requests")


def partial_stats_url(logs: DataFrame, stat: StatDefinition) -> DataFrame:
    return partial_stats_keyed(logs, stat, "url", "url")


def partial_stats_ip(logs: DataFrame, stat: StatDefinition) -> DataFrame:
    return partial_stats_keyed(logs, stat, "ip_address", "ip")


def partial_stats_browser(logs: DataFrame, stat: StatDefinition) -> DataFrame:
    return partial_stats_keyed(logs, stat, "user_agent", "browser")


def stats_all_levels(logs: DataFrame, stat: StatDefinition, closed_left: bool = False,
                     levels: tuple[str, ...] = LEVELS, edges: bool = False) -> DataFrame:
    """The statistics levels asked for (all four) in one pass:
    (level, site_id, stat_time, key, requests), key null on the site level.
    With ``edges`` also the hits of each window's first millisecond, as rows
    of their own (``edge`` true)."""
    w = windowed(logs, stat, closed_left or edges)
    base = ["site_id", "stat_time"]
    if edges:
        begin = F.col("stat_time") - F.expr(f"INTERVAL {stat.range_ms} MILLISECONDS")
        w, base = w.withColumn("edge", F.col("log_time") < begin + F.expr("INTERVAL 1 MILLISECOND")), [*base, "edge"]
    out = ["level", "site_id", "stat_time", "key", "requests", *base[2:]]
    if len(levels) == 1:  # one level needs no grouping sets
        key = KEY_OF_LEVEL.get(levels[0])
        keyed = w.select(*base, (F.col(key) if key else F.lit(None).cast("string")).alias("key"))
        agg = keyed.groupBy(*base, "key").agg(F.count(F.lit(1)).alias("requests"))
        return agg.withColumn("level", F.lit(levels[0])).select(*out)
    columns = [KEY_OF_LEVEL[x] for x in levels if x in KEY_OF_LEVEL]
    keys = [*base, *columns]
    sets = [[F.col(c) for c in (*base, KEY_OF_LEVEL.get(x)) if c] for x in levels]
    agg = w.select(*keys).groupingSets(sets, *keys).agg(
        F.count(F.lit(1)).alias("requests"), F.grouping_id().alias("_gid"))
    # grouping_id() has a bit for each key that a set leaves out, the last key lowest
    whole = (1 << len(columns)) - 1
    level = F.lit(None).cast("string")
    for x in levels:
        own = KEY_OF_LEVEL.get(x)
        gid = whole - (1 << (len(columns) - 1 - columns.index(own)) if own else 0)
        level = F.when(F.col("_gid") == gid, F.lit(x)).otherwise(level)
    return agg.withColumn("level", level).withColumn("key", F.coalesce(*columns)).select(*out)


def stats_of_buckets(logs: DataFrame, stat: StatDefinition, closed_left: bool = False,
                     levels: tuple[str, ...] = LEVELS) -> DataFrame:
    """The rows of ``stats_all_levels`` from hits bucketed by (site, salt):
    they are counted where they lie, without a shuffle.

    Levels are exploded, which keeps the bucketing (an Expand would not). A
    cold site's counts are final; only the counts of salted sites, at
    most one a key and salt, are shuffled and added up. Windows must not span the
    table's days, as a site may be salted on one day and not on another.
    """
    if 86_400_000 % stat.range_ms:
        raise ValueError(f"windows of {stat.stat_type} span days")
    rows = F.array(*[F.struct(F.lit(x).alias("level"), (F.col(KEY_OF_LEVEL[x]) if x in KEY_OF_LEVEL else F.lit(None).cast("string")).alias("key"))
                     for x in levels])
    counted = (windowed(logs, stat, closed_left).select("site_id", "salt", "stat_time", F.explode(rows).alias("lv"))
               .select("site_id", "salt", "stat_time", "lv.level", "lv.key")
               .groupBy("site_id", "salt", "stat_time", "level", "key").agg(F.count(F.lit(1)).alias("requests")))
    columns = ["level", "site_id", "stat_time", "key", "requests"]
    hot = (counted.where("salt >= 0").groupBy("level", "site_id", "stat_time", "key")
           .agg(F.sum("requests").cast("bigint").alias("requests")))
    return counted.where("salt < 0").select(*columns).unionByName(hot.select(*columns))


def long_form(levels: DataFrame, stat: StatDefinition) -> DataFrame:
    """``stats_all_levels`` stamped for storage as one table (see
    ``schemas.STATS_LEVELS``)."""
    return stamp(levels, stat).select("site_id", "year", "key", "requests", "level", "stat_type",
                                      F.to_date("stat_time").alias("stat_date"), "stat_time")


# level -> (table, name of its key column)
LEVEL_TABLES = {"site": ("partial_stats_requests", None), "url": ("partial_stats_url", "url"),
                "ip": ("partial_stats_ip", "ip"), "browser": ("partial_stats_browser", "browser")}


def level_table(long: DataFrame, level: str) -> DataFrame:
    """One of the reference-shaped tables out of the long form (filter on
    ``level``: partition pruning when read from storage)."""
    rows = long.where(F.col("level") == level)
    if level == "site":
        return rows.select("site_id", "year", "stat_time", "stat_type", "requests")
    name = LEVEL_TABLES[level][1]
    return rows.select("site_id", "year", "stat_time", "stat_type", F.col("key").alias(name),
                       F.col("requests").cast("int").alias("requests"))


def _fragment(key: Column, fragments: Column) -> Column:
    """Map fragment of a histogram key: md5 bucket, so every engine agrees."""
    bucket = F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint")
    return F.pmod(bucket, fragments).cast("int")


def partial_stats(levels: DataFrame, stat: StatDefinition, fragments: int = FRAGMENTS) -> DataFrame:
    """The reference's ``partial_stats`` (request count, ip and browser
    histograms as maps) built from the long form, in one aggregate.

    A map holds distinct keys, not hits. The keys of every site and window
    are spread over ``fragments`` rows by a fixed hash, and each row is a
    group of its own, so a hot site is built by many tasks. The request count
    stands on fragment 0 alone (0 elsewhere), so sums over rows are right;
    ``whole_partial_stats`` reads one row per site and window.
    """
    rows = levels.where(F.col("level").isin("ip", "browser", "site"))
    return _maps(rows, stat, F.lit(fragments))


def _maps(rows: DataFrame, stat: StatDefinition, fragments: Column, *more: str) -> DataFrame:
    """Map rows of (site, window, fragment) out of level rows."""
    is_entry = F.col("level").isin("ip", "browser")
    rows = rows.withColumn("fragment", F.when(is_entry, _fragment(F.coalesce("key", F.lit("")), fragments)).otherwise(F.lit(0)))

    def hist(level: str) -> Column:
        entry = F.struct(F.col("key"), F.col("requests").cast("int"))
        return F.map_from_entries(F.collect_list(F.when((F.col("level") == level) & F.col("key").isNotNull(), entry)))

    out = (rows.groupBy("site_id", "stat_time", "fragment", *more)
           .agg(F.coalesce(F.sum(F.when(F.col("level") == "site", F.col("requests"))), F.lit(0))
                .cast("bigint").alias("requests"),
                hist("ip").alias("ip"), hist("browser").alias("browser")))
    return stamp(out, stat).select("site_id", "year", "stat_time", "stat_type", "fragment", *more,
                                   "ip", "browser", "requests")


# Histogram keys of a site and window that one fragment holds.
KEYS_PER_FRAGMENT = 10_000


def partial_stats_sized(levels: DataFrame, stat: StatDefinition, keys_per_fragment: int = KEYS_PER_FRAGMENT) -> DataFrame:
    """``partial_stats`` with as many fragments as a site and window needs:
    one row for nearly all, many for a site with many keys, so its maps are
    built by many tasks and none outgrows a row. ``fragments`` is stored in
    the row; sums over rows and ``whole_partial_stats`` stay as they are.

    The keys are the level rows themselves, so their counts are exact and
    cost one aggregate. Only sites of more than one fragment are joined back: at most
    one for every ``keys_per_fragment`` level rows.
    """
    is_entry = F.col("level").isin("ip", "browser")
    counts = levels.where(is_entry).groupBy("site_id", "stat_time").agg(F.count(F.lit(1)).alias("_n"))
    wide = counts.where(F.col("_n") > keys_per_fragment).select(
        F.col("site_id").alias("_site"), F.col("stat_time").alias("_time"), F.ceil(F.col("_n") / keys_per_fragment).cast("int").alias("_wide"))
    rows = levels.where(is_entry | (F.col("level") == "site")).join(
        wide, F.col("site_id").eqNullSafe(F.col("_site")) & (F.col("stat_time") == F.col("_time")), "left")
    return _maps(rows.withColumn("fragments", F.coalesce("_wide", F.lit(1))), stat, F.col("fragments"), "fragments")


def whole_partial_stats(partial: DataFrame) -> DataFrame:
    """One row per site and window out of the fragments: the reference's row.
    For sites whose histograms fit one row."""
    def union(column: str) -> Column:
        return F.map_from_entries(F.flatten(F.collect_list(F.map_entries(column)))).alias(column)

    return (partial.groupBy("site_id", "year", "stat_time", "stat_type")
            .agg(union("ip"), union("browser"), F.sum("requests").cast("bigint").alias("requests")))


def histogram_text(m) -> Column:
    """'k=v,k=v' in key order, for comparing map columns as values."""
    m = F.col(m) if isinstance(m, str) else m
    return F.array_join(F.transform(F.array_sort(F.map_entries(m)),
                                    lambda e: F.concat(e.key, F.lit("="), e.value.cast("string"))),
                        ",")


def global_stats(partial_requests: DataFrame, base_type: str = FIVE_MINUTES.stat_type) -> DataFrame:
    """Running total per site: sum of the partials of one base stat type, so a
    second schedule or a rerun never counts a hit twice."""
    return (partial_requests.where(F.col("stat_type") == base_type)
            .groupBy("site_id").agg(F.sum("requests").cast("bigint").alias("requests")))


def global_stats_url(partial_url: DataFrame, base_type: str = FIVE_MINUTES.stat_type) -> DataFrame:
    return (partial_url.where(F.col("stat_type") == base_type)
            .groupBy("site_id", "url").agg(F.sum("requests").cast("bigint").alias("requests")))


def sum_levels(levels: list[DataFrame], keys: list[str]) -> DataFrame:
    """Totals as the sum of levels that share no hit: closed totals, day
    totals, windows of open days. Each level is replaced as a whole when its hits
    change, and none is added to in place."""
    rows = levels[0].select(*keys, "requests")
    for more in levels[1:]:
        rows = rows.unionByName(more.select(*keys, "requests"))
    return rows.groupBy(*keys).agg(F.sum("requests").cast("bigint").alias("requests"))


# Windows per calendar block: the calendar is generated as blocks first,
# then the windows of each block in parallel.
CALENDAR_BLOCK = 1024


def window_calendar(first: Column, last: Column, stat: StatDefinition) -> Column:
    """Explode every window end in ``[first, last]`` (one row in, many out)."""
    step = F.expr(f"INTERVAL {stat.range_ms} MILLISECONDS")
    return F.explode(F.sequence(first, last, step))


def calendar(bounds: DataFrame, stat: StatDefinition, first: str = "first",
             last: str = "last") -> DataFrame:
    """(stat_type, stat_time) for every window between the bounds of a
    one-row frame. Blocks of ``CALENDAR_BLOCK`` windows are exploded first
    and spread over tasks, so a long span is not generated by one task."""
    block = stat.range_ms * CALENDAR_BLOCK
    block_step = F.expr(f"INTERVAL {block} MILLISECONDS")
    starts = bounds.select(F.explode(F.sequence(F.col(first), F.col(last), block_step)).alias("b"),
                           F.col(last).alias("_last"))
    starts = starts.repartition("b")
    block_end = F.least(F.col("b") + F.expr(f"INTERVAL {block - stat.range_ms} MILLISECONDS"),
                        F.col("_last"))
    return starts.select(F.lit(stat.stat_type).alias("stat_type"),
                         window_calendar(F.col("b"), block_end, stat).alias("stat_time"))


def due_windows(logs: DataFrame, stat: StatDefinition) -> DataFrame:
    """Every window from the one holding the first hit to the one holding the
    last (stat_type, stat_time): what a scheduler ticking every range would
    have asked for. Size is span / range, independent of the hit count."""
    bounds = windowed(logs, stat, closed_left=True).agg(
        F.min("stat_time").alias("first"), F.max("stat_time").alias("last"))
    return calendar(bounds, stat)


def pending_windows(due: DataFrame, ledger: DataFrame) -> DataFrame:
    """Due windows the ledger does not hold yet (backfill / skip done work)."""
    return due.join(ledger.select("stat_type", "stat_time"), ["stat_type", "stat_time"], "left_anti")


def stats_reference(logs: DataFrame, stat: StatDefinition, due: DataFrame | None = None) -> DataFrame:
    """Ledger rows: hits per due window, 0 for a window without hits."""
    if due is None:
        due = due_windows(logs, stat)
    counts = windowed(logs, stat).groupBy("stat_time").agg(F.count(F.lit(1)).alias("n"))
    return (due.join(counts, ["stat_time"], "left")
            .select("stat_type", "stat_time",
                    F.coalesce(F.col("n"), F.lit(0)).cast("bigint").alias("affected_records")))
