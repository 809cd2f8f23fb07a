"""Field rules for request rows: each failing rule yields (field, error); all
failures of a row are collected into one array column."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The e-mail pattern and the messages of the reference's rules.
EMAIL_PATTERN = (r"^[a-zA-Z0-9\.!#$%&'*+/=?^_`{|}~-]+@[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?"
                 r"(?:\.[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?)*$")
EMAIL_MESSAGE = "field {field} is not a valid email"
LENGTH_MESSAGE = "{field} length must be greater than {n}"
MIN_PASSWORD_LENGTH = 6


@dataclass(frozen=True)
class Rule:
    field: str
    is_invalid: Callable[[Column], Column]
    message: str


def email_rule(field: str) -> Rule:
    def bad(c: Column) -> Column:
        ok = (F.trim(c) != "") & c.rlike(EMAIL_PATTERN)
        return ~F.coalesce(ok, F.lit(False))
    return Rule(field, bad, EMAIL_MESSAGE.format(field=field))


def min_length_rule(field: str, n: int) -> Rule:
    return Rule(field, lambda c: F.coalesce(F.length(c) < n, F.lit(True)),
                LENGTH_MESSAGE.format(field=field, n=n))


def validate(df: DataFrame, rules: list[Rule], out: str = "errors") -> DataFrame:
    """Add ``out``: array<struct<field, error>> of failed rules, sorted by
    field. A rule on a missing column is an error of the rule list itself and
    raises here, before any data is read."""
    missing = [r.field for r in rules if r.field not in df.columns]
    if missing:
        raise ValueError(f"No such field for validation: {', '.join(missing)}")
    checks = [F.when(r.is_invalid(F.col(r.field)),
                     F.struct(F.lit(r.field).alias("field"), F.lit(r.message).alias("error")))
              for r in rules]
    return df.withColumn(out, F.array_sort(F.array_distinct(F.array_compact(F.array(*checks)))))


def errors_text(col: str = "errors") -> Column:
    """'field: error; field: error' in field order ('' when valid)."""
    return F.array_join(F.transform(F.col(col), lambda e: F.concat(e.field, F.lit(": "), e.error)),
                        "; ")
