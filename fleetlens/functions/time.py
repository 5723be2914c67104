"""Time arithmetic that does not depend on the session time zone.

Differences count unit *boundaries*: 00:59 to 01:01 is one hour.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

from fleetlens.config import CLOCK_OFFSET_MINUTES
from fleetlens.functions.text import col

_EPOCH = "DATE'1970-01-01'"


def moment(as_of: datetime) -> Column:
    """A Python datetime as a zone-free timestamp literal."""
    return F.lit(as_of.isoformat(sep=" ")).cast("timestamp_ntz")


def shifted_moment(as_of: datetime) -> Column:
    """``as_of`` on the clock heartbeats are stored on."""
    return moment(as_of) + F.expr(f"INTERVAL {CLOCK_OFFSET_MINUTES} MINUTES")


def day_number(ts: Column | str) -> Column:
    return F.unix_date(col(ts).cast("date")).cast("bigint")


def hour_number(ts: Column | str) -> Column:
    """Hours since the epoch, rounded down."""
    c = col(ts)
    return day_number(c) * 24 + F.hour(c)


def hour_of(as_of: datetime) -> int:
    """The hour number of a moment, as a plain number: a condition on it reaches the files' statistics."""
    return (as_of.replace(tzinfo=None) - datetime(1970, 1, 1)) // timedelta(hours=1)


def second_number(ts: Column | str) -> Column:
    c = col(ts)
    return hour_number(c) * 3600 + F.minute(c) * 60 + F.second(c)


def hours_between(start: Column | str, end: Column | str) -> Column:
    """Hour boundaries crossed from ``start`` to ``end``."""
    return hour_number(end) - hour_number(start)


def days_between(start: Column | str, end: Column | str) -> Column:
    """Day boundaries crossed from ``start`` to ``end``."""
    return day_number(end) - day_number(start)


def whole_days_between(start: Column | str, end: Column | str) -> Column:
    """Full 24-hour days from ``start`` to ``end``, never negative; NULL if either is unknown."""
    seconds = second_number(end) - second_number(start)
    # greatest() alone would turn an unknown difference into 0.
    return F.when(seconds.isNotNull(), F.greatest(F.lit(0).cast("bigint"), F.floor(seconds / 86400).cast("bigint")))


def months_between_starts(start: Column | str, end: Column | str) -> Column:
    """Month boundaries crossed from ``start`` to ``end``."""
    a, b = col(start), col(end)
    return (F.year(b) - F.year(a)) * 12 + F.month(b) - F.month(a)


def month_number(ts: Column | str) -> Column:
    """Months since year 0."""
    c = col(ts)
    return (F.year(c) * 12 + F.month(c) - 1).cast("int")


def stamp_label(ts: Column | str) -> Column:
    """'2001-08-02 05:30:00'. Text of the timestamp itself; formatting would go through the session zone."""
    return F.substring(col(ts).cast("string"), 1, 19)


def date_label(ts: Column | str) -> Column:
    return F.substring(col(ts).cast("string"), 1, 10)


def month_label(ts: Column | str) -> Column:
    return F.substring(col(ts).cast("string"), 1, 7)


def has_time_of_day(ts: Column | str) -> Column:
    c = col(ts)
    return c.cast("timestamp_ntz") != c.cast("date").cast("timestamp_ntz")


def before(as_of: Column, amount: int, unit: str) -> Column:
    return as_of - F.expr(f"INTERVAL {amount} {unit}")
