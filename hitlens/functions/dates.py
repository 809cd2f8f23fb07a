"""Date text in the reference's wire format, both ways, built from date fields
so the session time zone plays no part."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the date format of the reference's JSON bodies.
DATE_PATTERN = "dd:MM:yy:HH:mm:ss.SSS"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def date_text(ts) -> Column:
    t = _c(ts)
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    millis = F.floor(F.date_part(F.lit("SECOND"), t) * 1000) % 1000
    return F.concat(two(F.dayofmonth(t)), F.lit(":"), two(F.month(t)), F.lit(":"),
                    two(F.year(t) % 100), F.lit(":"), two(F.hour(t)), F.lit(":"),
                    two(F.minute(t)), F.lit(":"), two(F.second(t)), F.lit("."),
                    F.lpad(millis.cast("string"), 3, "0"))


def parse_date_text(text) -> Column:
    return F.to_timestamp_ntz(_c(text), F.lit(DATE_PATTERN))
