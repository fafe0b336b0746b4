"""Nanosecond clock: every time is a LONG of UTC nanoseconds; nothing depends on the session's zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MS, SECOND, MINUTE, HOUR, DAY = 10**6, 10**9, 60 * 10**9, 3600 * 10**9, 86400 * 10**9
#: Durations by their names in information sets and horizons (fixed values).
DURATIONS = {"1s": SECOND, "10s": 10 * SECOND, "1min": MINUTE, "10min": 10 * MINUTE}


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp without zone."""
    days = F.datediff(ts, F.lit("1970-01-01").cast("date")).cast("long")
    return days * 86_400_000_000 + F.hour(ts).cast("long") * 3_600_000_000 + F.minute(ts).cast("long") * 60_000_000 + (F.extract(F.lit("SECOND"), ts) * 1_000_000).cast("long")


def ms_to_ns(ms: Column) -> Column:
    return ms.cast("long") * MS


def day_of(ns: Column) -> Column:
    """Days since 1970 (floored, so right for negative times too)."""
    return F.floor((ns - F.pmod(ns, F.lit(DAY))) / F.lit(DAY)).cast("long")


def date_string(ns: Column) -> Column:
    """The UTC date as YYYY-MM-DD."""
    return F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), day_of(ns).cast("int")), "yyyy-MM-dd")


def day_start(day: Column) -> Column:
    return day.cast("long") * DAY


def date_to_day(date: Column) -> Column:
    return F.datediff(date.cast("date"), F.lit("1970-01-01").cast("date")).cast("long")


def days_between(first: Column, last: Column) -> Column:
    """All days from first to last, both included; empty if last is before first."""
    return F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<long>"))
