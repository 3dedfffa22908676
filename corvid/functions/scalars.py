"""Numbers, times and vectors as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def epoch_or_iso(value: Column) -> Column:
    """TIMESTAMP of text: under 1e10 seconds, else milliseconds, else ISO; null if it is none."""
    number = value.try_cast("double")
    return F.coalesce(F.when(number < 1e10, F.timestamp_millis((number * 1000).cast("long"))).when(number.isNotNull(), F.timestamp_millis(number.cast("long"))), F.try_to_timestamp(value))


def age_days(updated: Column, now: Column) -> Column:
    """Days between, not under 0; 0 without a time."""
    return F.coalesce(F.greatest(F.lit(0.0), (F.unix_micros(now) - F.unix_micros(updated)) / 864e8), F.lit(0.0))


def backoff(attempt: Column, base_ms: float, max_ms: float, random: Column) -> Column:
    return F.least(F.lit(max_ms), F.floor(base_ms * F.pow(F.lit(2.0), F.least(attempt - 1, F.lit(20))) * (0.5 + random)))


def quiet(ts: Column, start: int, end: int, zone: str = "UTC") -> Column:
    """True in the hours from start to end, over midnight if need be."""
    h = F.hour(F.from_utc_timestamp(ts, zone))
    return (h >= start) & (h < end) if start <= end else (h >= start) | (h < end)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def unit(v: Column) -> Column:
    """L2-normalised vector; null for a zero or non-finite one."""
    n = norm(v)
    return F.when((n > 0) & (n < float("inf")), F.transform(v, lambda x: x.cast("double") / n))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def source_tier(kind: Column) -> Column:
    return F.when(kind.isNull() | (kind == "manual"), 0.02).when(kind == "filesystem", 0.015).otherwise(0.01)


def page_strength(length: Column) -> Column:
    return F.least(F.lit(0.01), length / 100000.0)
