"""Bi-temporal predicates and decay. The eight predicates differ on purpose and stay apart."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

LONG_LIVED, HALF_LIFE_LONG, HALF_LIFE = ("metric", "promise"), 365.0, 180.0


def ts(value: dt.datetime | str | Column) -> Column:
    if isinstance(value, Column):
        return value
    return F.lit(str(value).replace("T", " ")).cast("timestamp_ntz")


def active_at(cutoff) -> Column:
    """Facts as retrieval sees them, without scope: valid and known at cutoff, and not known to be over. Also
    the predicate for edges. A missing t_ingested counts as known."""
    c = ts(cutoff)
    return ((F.col("t_valid") <= c) & (F.col("t_ingested").isNull() | (F.col("t_ingested") <= c))
            & (F.col("t_invalid").isNull() | (F.col("t_invalid") > c) | F.coalesce(F.col("t_invalid_ingested") > c, F.lit(False))))


def active_in_scope(scope: str, cutoff) -> Column:
    return (F.col("scope") == scope) & active_at(cutoff)


def open_interval() -> Column:
    """Lifecycle: not invalidated at all."""
    return F.col("t_invalid").isNull()


def not_yet_invalid(cutoff) -> Column:
    """Of an episode's facts: no lower bound."""
    return F.col("t_invalid").isNull() | (F.col("t_invalid") > ts(cutoff))


def in_snapshot(axis: str, at) -> Column:
    """Diff: on the valid or the transaction axis."""
    c = ts(at)
    if axis == "transaction":
        return (F.col("t_ingested") <= c) & (F.col("t_invalid_ingested").isNull() | (F.col("t_invalid_ingested") > c))
    return (F.col("t_valid") <= c) & (F.col("t_invalid").isNull() | (F.col("t_invalid") > c))


def versions_conflict(old: str, new: str) -> Column:
    """An older edge version that a newer one closes; both axes must agree."""
    o, n = (lambda c: F.col(f"{old}.{c}")), (lambda c: F.col(f"{new}.{c}"))
    return ((o("t_valid") <= n("t_valid")) & (o("t_ingested") <= n("t_ingested")) & (o("t_invalid").isNull() | (o("t_invalid") > n("t_valid")))
            & (o("t_invalid_ingested").isNull() | (o("t_invalid_ingested") > n("t_ingested"))))


def simple_state() -> Column:
    return F.when(F.col("t_invalid").isNotNull(), "invalidated").otherwise("active")


def decayed_state(decayed: Column) -> Column:
    return (F.when(F.col("t_invalid").isNotNull(), "invalidated").when(decayed >= 0.5, "active").when(decayed >= 0.1, "stale")
            .otherwise("expired"))


def whole_days(start: Column, end: Column) -> Column:
    """Days, truncated toward zero."""
    return F.timestamp_diff("DAY", start, end)


def retrieval_confidence(as_of) -> Column:
    """Confidence halved every 365 days (metrics, promises) or 180 days (other), four decimals."""
    days = F.greatest(whole_days(F.col("t_valid"), ts(as_of)), F.lit(0)).cast("double")
    half = F.when(F.col("fact_type").isin(*LONG_LIVED), F.lit(HALF_LIFE_LONG)).otherwise(F.lit(HALF_LIFE))
    return F.round(F.col("confidence") * F.pow(F.lit(0.5), days / half) * F.lit(10000.0)) / F.lit(10000.0)


def lifecycle_confidence(as_of, half_life: float) -> Column:
    """One half-life for every type, neither clamped nor rounded."""
    days = whole_days(F.col("t_valid"), ts(as_of)).cast("double")
    return F.col("confidence") * F.exp(-F.log(F.lit(2.0)) / F.lit(float(half_life)) * days)


def is_hot(now, half_life: float) -> Column:
    return F.coalesce((F.col("access_count") > 0) & (whole_days(F.col("last_accessed"), ts(now)) <= F.lit(float(half_life))), F.lit(False))


def hour(t: Column) -> Column:
    return F.date_trunc("HOUR", t).cast("timestamp_ntz")


def parse_rfc3339(value: Column | str) -> Column:
    """RFC 3339 with Z or an offset as a UTC time; null for anything else. Digits of the second beyond six are cut off."""
    c = F.trim(F.col(value) if isinstance(value, str) else value)
    part = lambda k: F.regexp_extract(c, r"^(\d{4}-\d{2}-\d{2})[Tt ](\d{2}:\d{2}:\d{2})(?:\.(\d+))?([Zz]|[+-]\d{2}:\d{2})$", k)
    whole = F.try_to_timestamp(F.concat(part(1), F.lit(" "), part(2), F.lit("."), F.rpad(F.substring(part(3), 1, 6), 6, "0")), F.lit("yyyy-MM-dd HH:mm:ss.SSSSSS")).cast("timestamp_ntz")
    zone = F.upper(part(4))
    minutes = F.when(zone == "Z", 0).otherwise(F.concat(F.substring(zone, 1, 1), F.lit("1")).try_cast("int") * (F.substring(zone, 2, 2).try_cast("int") * 60 + F.substring(zone, 5, 2).try_cast("int")))
    return F.when(zone != "", whole - F.make_dt_interval(F.lit(0), F.lit(0), F.coalesce(minutes, F.lit(0))))
