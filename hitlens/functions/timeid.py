"""Epoch arithmetic on ``timestamp_ntz`` and time-based (v1) ids.

Epoch values are taken through day-time interval arithmetic, which does not
consult the session time zone (casting ``timestamp_ntz`` to ``timestamp``
does, and shifts wall-clock times that fall into a daylight-saving gap).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the v1 id layout.
# 100-ns intervals between 1582-10-15 (id epoch) and 1970-01-01 (Unix epoch).
UUID_EPOCH_OFFSET_100NS = 0x01B21DD213814000
# Canonical text form: 8-4-4-4-12 hex digits.
UUID_PATTERN = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"

_EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def epoch_micros(ts) -> Column:
    """Microseconds since 1970-01-01 of a ``timestamp_ntz`` column."""
    delta = (_c(ts) - F.expr(_EPOCH)).cast("interval second")
    return (delta.cast("decimal(20,6)") * 1_000_000).cast("bigint")


def floor_div(x, n: int) -> Column:
    """Exact integer floor division (no detour through double, which cannot
    hold 100-ns tick counts exactly)."""
    x = _c(x).cast("bigint")
    exact = (x - F.pmod(x, F.lit(n))).cast("decimal(20,0)") / F.lit(n)
    return exact.cast("bigint")


def epoch_millis(ts) -> Column:
    return floor_div(epoch_micros(ts), 1000)


def ntz_from_millis(ms) -> Column:
    """``timestamp_ntz`` from epoch milliseconds."""
    secs = _c(ms).cast("decimal(20,3)") / 1000
    return F.expr(_EPOCH) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), secs)


def time_uuid(ts, node) -> Column:
    """A version-1 id whose time field is ``ts`` (ms precision).

    ``node`` (an integer column) fills clock sequence and node, so distinct
    nodes give distinct ids for the same millisecond.
    """
    return time_uuid_millis(epoch_millis(ts), node)


def time_uuid_millis(ms, node) -> Column:
    """``time_uuid`` from epoch milliseconds."""
    ticks = _c(ms).cast("bigint") * 10000 + F.lit(UUID_EPOCH_OFFSET_100NS)
    h = F.lpad(F.lower(F.hex(ticks)), 15, "0")
    node_hex = F.lpad(F.lower(F.hex(_c(node).cast("bigint"))), 12, "0")
    return F.concat_ws("-", F.substring(h, 8, 8), F.substring(h, 4, 4),
                       F.concat(F.lit("1"), F.substring(h, 1, 3)), F.lit("8000"), node_hex)


def time_of_uuid(uuid) -> Column:
    """Creation time (``timestamp_ntz``, ms) of a version-1 id."""
    u = _c(uuid)
    hex_ticks = F.concat(F.substring(u, 16, 3), F.substring(u, 10, 4), F.substring(u, 1, 8))
    ticks = F.conv(hex_ticks, 16, 10).cast("bigint")
    ms = floor_div(ticks - F.lit(UUID_EPOCH_OFFSET_100NS), 10000)
    return ntz_from_millis(ms)


def is_uuid(col) -> Column:
    """True when the text is an id in canonical 8-4-4-4-12 hex form
    (null counts as malformed)."""
    return F.coalesce(_c(col).rlike(UUID_PATTERN), F.lit(False))


def uuid_from_text(col) -> Column:
    """A stable random-looking id (8-4-4-4-12) made from md5 of a value."""
    m = F.md5(_c(col).cast("string"))
    return F.concat_ws("-", F.substring(m, 1, 8), F.substring(m, 9, 4), F.substring(m, 13, 4),
                       F.substring(m, 17, 4), F.substring(m, 21, 12))


def ntz_from_micros(us) -> Column:
    secs = (_c(us).cast("decimal(26,0)") / 1_000_000).cast("decimal(18,6)")
    return F.expr(_EPOCH) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), secs)


def ltz_from_ntz(ts) -> Column:
    """The instant whose UTC wall-clock time is ``ts`` (for watermarks, which
    need ``timestamp``), without consulting the session zone."""
    return F.timestamp_micros(epoch_micros(ts))


def ntz_from_ltz(ts) -> Column:
    """UTC wall-clock time of an instant, without consulting the session zone."""
    return ntz_from_micros(F.unix_micros(_c(ts)))


def ntz_lit(value) -> Column:
    """A ``timestamp_ntz`` literal from a naive datetime, built from its text.
    (``F.lit(datetime)`` would make a ``timestamp`` in the Python process's
    zone, and casting that to ``timestamp_ntz`` uses the session zone.)"""
    return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")
