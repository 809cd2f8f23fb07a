"""Resolution of hits as of their own time (J1).

The registry of validity intervals has a row per time that a tracking id
belonged to a site: (tracking_id, site_id, valid_from, valid_to), ``valid_to``
null while it does. A hit resolves to the site of the newest interval begun
at or before it, if that still holds, or ended less than ``expiry`` before
the hit (the time a look-up cache keeps what it found). So a replay after a
delete gives what the first run gave.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import status
from ..functions.timeid import is_uuid

# Fixed value: how long a look-up is kept.
EXPIRY = dt.timedelta(minutes=60)


def histories(intervals: DataFrame) -> DataFrame:
    """One row per tracking id, its intervals in order of their start. An id
    has as many as it was registered times, independent of the hits."""
    entry = F.struct("valid_from", "valid_to", "site_id")
    return (intervals.where("tracking_id IS NOT NULL AND valid_from IS NOT NULL")
            .groupBy("tracking_id").agg(F.sort_array(F.collect_set(entry)).alias("intervals")))


def resolve_as_of(hits: DataFrame, intervals: DataFrame, tracking: str = "tracking_id", time: str = "log_time",
                  expiry: dt.timedelta = EXPIRY, eligible: Column | None = None, broadcast: bool = False) -> DataFrame:
    """Like ``resolve_hits`` (202 / 404 / 400), by the hit's time.

    One left equi-join on the id: each hit meets its id's whole history once,
    so a hot id's hits are split over tasks like those of any skewed join and
    are never multiplied by the number of intervals. A hit without a time is
    unknown (404)."""
    ok = is_uuid(F.col(tracking))
    if eligible is not None:
        ok = ok & eligible
    keyed = hits.withColumn("_key", F.when(ok, F.col(tracking)))
    known = histories(intervals).withColumnRenamed("tracking_id", "_key")
    joined = keyed.join(F.broadcast(known) if broadcast else known, "_key", "left")
    begun = F.try_element_at(F.filter("intervals", lambda x: x["valid_from"] <= F.col(time)), F.lit(-1))
    grace = F.make_dt_interval(secs=F.lit(expiry.total_seconds()).cast("decimal(18,6)"))
    joined = joined.withColumn("_at", begun)
    holds = F.col("_at.valid_to").isNull() | (F.col(time) < F.col("_at.valid_to") + grace)
    joined = joined.withColumn("site_id", F.when(holds, F.col("_at.site_id")))
    st = (F.when(F.col("_key").isNull(), F.lit(status.BAD_REQUEST))
          .when(F.col("site_id").isNull(), F.lit(status.NOT_FOUND))
          .otherwise(F.lit(status.ACCEPTED)))
    return joined.withColumn("status", st).drop("_key", "_at", "intervals")
