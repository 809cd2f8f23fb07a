"""Table schemas (the reference's eleven tables, in creation order) plus the
long-form statistics tables this package writes. Table and column names of
the eleven are fixed values.

Ids are kept as text: time-based ids (v1) for users, sites and hits, random
ids (v4) for tracking ids. Times are ``timestamp_ntz`` holding UTC wall-clock
time, so no result depends on the session time zone.
"""

from pyspark.sql.types import (DateType, IntegerType, LongType, MapType, StringType,
                               StructField, StructType, TimestampNTZType, TimestampType)


def _s(*fields):
    return StructType([StructField(n, t, True) for n, t in fields])


TEXT, INT, BIGINT, TS = StringType(), IntegerType(), LongType(), TimestampNTZType()
HISTOGRAM = MapType(StringType(), IntegerType())

USERS_BY_ID = _s(("id", TEXT), ("email", TEXT), ("full_name", TEXT))
USERS_BY_CREDENTIALS = _s(("email", TEXT), ("user_id", TEXT))  # password never stored
SITES_BY_ID = _s(("id", TEXT), ("domain", TEXT), ("user_id", TEXT), ("tracking_id", TEXT))
SITES_BY_TRACKING_ID = _s(("tracking_id", TEXT), ("site_id", TEXT))
SITES_BY_USERS = _s(("user_id", TEXT), ("site_id", TEXT))
# The times that a tracking id belonged to a site; valid_to is null while it does.
SITE_HISTORY = _s(("tracking_id", TEXT), ("site_id", TEXT), ("valid_from", TS), ("valid_to", TS))
LOGS = _s(("site_id", TEXT), ("log_id", TEXT), ("log_time", TS), ("url", TEXT),
          ("ip_address", TEXT), ("user_agent", TEXT))
PARTIAL_STATS = _s(("site_id", TEXT), ("year", INT), ("stat_time", TS), ("stat_type", TEXT),
                   ("fragment", INT), ("fragments", INT), ("ip", HISTOGRAM), ("browser", HISTOGRAM),
                   ("requests", BIGINT))
PARTIAL_STATS_URL = _s(("site_id", TEXT), ("year", INT), ("stat_time", TS), ("stat_type", TEXT),
                       ("url", TEXT), ("requests", INT))
GLOBAL_STATS = _s(("site_id", TEXT), ("requests", BIGINT))
GLOBAL_STATS_URL = _s(("site_id", TEXT), ("url", TEXT), ("requests", BIGINT))
STATS_REFERENCE = _s(("stat_type", TEXT), ("stat_time", TS), ("affected_records", BIGINT))

# Long forms: one row per (site, window, key). They are the primary statistics
# tables; the map-typed PARTIAL_STATS is built from them.
PARTIAL_STATS_REQUESTS = _s(("site_id", TEXT), ("year", INT), ("stat_time", TS),
                            ("stat_type", TEXT), ("requests", BIGINT))
PARTIAL_STATS_IP = _s(("site_id", TEXT), ("year", INT), ("stat_time", TS), ("stat_type", TEXT),
                      ("ip", TEXT), ("requests", INT))
PARTIAL_STATS_BROWSER = _s(("site_id", TEXT), ("year", INT), ("stat_time", TS),
                           ("stat_type", TEXT), ("browser", TEXT), ("requests", INT))

# All four long forms in one table, partitioned by (stat_type, stat_date,
# stat_time); ``key`` is null on the site level. The tables above are its
# projections.
STATS_LEVELS = _s(("site_id", TEXT), ("year", INT), ("key", TEXT), ("requests", BIGINT),
                  ("level", TEXT), ("stat_type", TEXT), ("stat_date", DateType()), ("stat_time", TS))
PARTIAL_STATS_STORED = StructType(PARTIAL_STATS.fields + [StructField("stat_date", DateType(), True)])
LEDGER_STORED = StructType(STATS_REFERENCE.fields + [StructField("stat_date", DateType(), True)])
# Raw hit as posted: JSON body with three required fields.
HIT_BODY = _s(("url", TEXT), ("ipAddress", TEXT), ("userAgent", TEXT))
# A message stream as any broker source delivers it.
MESSAGES = _s(("key", TEXT), ("value", TEXT), ("partition", INT), ("offset", BIGINT),
              ("timestamp", TimestampType()))
# Load-test request outcomes (one row per request the load generator made).
REQUEST_OUTCOMES = _s(("ts", TS), ("status", INT), ("outcome", TEXT), ("elapsed_ms", BIGINT))

# Creation order of the reference's tables.
TABLES = [
    ("users_by_id", USERS_BY_ID),
    ("users_by_credentials", USERS_BY_CREDENTIALS),
    ("sites_by_id", SITES_BY_ID),
    ("sites_by_tracking_id", SITES_BY_TRACKING_ID),
    ("sites_by_users", SITES_BY_USERS),
    ("logs", LOGS),
    ("partial_stats", PARTIAL_STATS),
    ("partial_stats_url", PARTIAL_STATS_URL),
    ("global_stats", GLOBAL_STATS),
    ("global_stats_url", GLOBAL_STATS_URL),
    ("stats_reference", STATS_REFERENCE),
]


def conform(df, schema: StructType):
    """Select the schema's columns in order, cast to its types."""
    from pyspark.sql import functions as F
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])
