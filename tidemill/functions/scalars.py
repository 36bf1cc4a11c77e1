"""Column expressions shared by the operators."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMERIC = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"
#: Fixed value: keeps the symmetric error defined where actual and prediction are both zero.
SMAPE_EPSILON = 1e-9


def coerce_numeric(c: Column) -> Column:
    """Text to a finite DOUBLE; anything unreadable or not finite is null."""
    text = F.trim(c)
    number = F.when(text.rlike(NUMERIC), text.try_cast("double"))
    return F.when(F.abs(number) < F.lit(float("inf")), number)


def epoch_to_timestamp(seconds: Column) -> Column:
    """Seconds since 1970 to a timestamp, rounded to microseconds; null where it does not fit."""
    return F.timestamp_micros(F.when(F.abs(seconds) < 9e12, F.round(seconds * 1e6).cast("bigint")))


def is_missing(c: Column, text: bool = True) -> Column:
    """Null, or for text columns blank."""
    return c.isNull() | (F.trim(c) == "") if text else c.isNull()


def label_or_missing(c: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit("<MISSING>"))


def category_key(c: Column) -> Column:
    """Spelling-free key of a category: lower-case letters and digits only."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def parse_bool_strict(c: Column) -> Column:
    """true, false, 1 and 0 in any case; null stays null, anything else raises."""
    text = F.lower(F.trim(c))
    return F.when(c.isNull(), F.lit(None).cast("boolean")).when(text.isin("true", "1"), F.lit(True)).when(text.isin("false", "0"), F.lit(False)).otherwise(F.raise_error(F.concat(F.lit("not a boolean: "), c)).cast("boolean"))


def parse_bool_lenient(c: Column) -> Column:
    """true, 1 or yes in any case; everything else, null included, is false."""
    return F.coalesce(F.lower(F.trim(c)).isin("true", "1", "yes"), F.lit(False))


def parse_date(c: Column) -> Column:
    """Text to a UTC timestamp, null where it cannot be read."""
    return F.try_to_timestamp(c)


def phase(seconds: Column, period: int) -> Column:
    """The angle of a moment within a period that starts at the epoch."""
    return F.lit(2 * math.pi) * F.pmod(seconds, F.lit(period)).cast("double") / F.lit(float(period))


def ratio_or_zero(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def smape_term(actual: Column, predicted: Column) -> Column:
    return F.lit(2.0) * F.abs(predicted - actual) / (F.abs(actual) + F.abs(predicted) + F.lit(SMAPE_EPSILON))


def sig3(value: float | None, digits: int = 3) -> str:
    """A number for people, with `digits` significant digits; empty for null. Driver-side, for small report tables."""
    return "" if value is None else f"{value:.{digits}g}"


def clamped_bucket(value: Column, low: float, high: float, buckets: int) -> Column:
    """Histogram bucket 1..buckets of low..high, the last one closed on both sides."""
    return F.least(F.width_bucket(value, F.lit(float(low)), F.lit(float(high)), F.lit(buckets)), F.lit(buckets).cast("bigint"))
