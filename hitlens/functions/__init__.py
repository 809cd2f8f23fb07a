"""Column expressions (all JVM-side built-ins, no Python UDFs)."""

from .timeid import (epoch_micros, epoch_millis, is_uuid, ntz_from_millis,
                     time_of_uuid, time_uuid, uuid_from_text)
from .windows import (FIVE_MINUTES, ONE_DAY, StatDefinition, in_window_range,
                      with_window)
from .validation import (Rule, email_rule, min_length_rule, validate)
from .dates import DATE_PATTERN, date_text, parse_date_text
from . import status

__all__ = [
    "epoch_micros", "epoch_millis", "is_uuid", "ntz_from_millis", "time_of_uuid",
    "time_uuid", "uuid_from_text", "FIVE_MINUTES", "ONE_DAY", "StatDefinition",
    "in_window_range", "with_window", "Rule", "email_rule",
    "min_length_rule", "validate", "DATE_PATTERN", "date_text", "parse_date_text",
    "status",
]
