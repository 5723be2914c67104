"""Bucketing and classification columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fleetlens import config
from fleetlens.functions import time as tm
from fleetlens.functions.text import blank_to_null, clean, col, is_any, trimmed, whole_number


def segment_group(c: Column | str, blank: str | None = "(blank)") -> Column:
    """Merge segment variants: anything naming SME, then anything naming LE, else the text itself."""
    upper = F.upper(col(c))
    return (
        F.when(blank_to_null(c).isNull(), F.lit(blank))
        .when(upper.contains("SME"), F.lit("SME"))
        .when(upper.contains("LE"), F.lit("LE"))
        .otherwise(trimmed(c))
    )


def is_open(status: Column | str) -> Column:
    """Not in a terminal status; NULL for a NULL status, which is neither open nor closed."""
    return ~col(status).isin(*config.TERMINAL_STATUSES)


def category_key(c: Column | str) -> Column:
    return F.lower(clean(c))


def names_technical(key: Column | str) -> Column:
    """Keyword test for a category the catalog does not list."""
    return col(key).rlike(config.TECH_KEYWORDS)


def recency_bucket(last_seen: Column | str, as_of: Column) -> Column:
    """Six classes of heartbeat recency; ``as_of`` is on the heartbeat clock."""
    c = col(last_seen)
    return (
        F.when(c.isNull() | (c < F.lit("2000-01-01").cast("timestamp_ntz")), "Never seen")
        .when(c >= tm.before(as_of, 1, "HOUR"), "Live (<1h)")
        .when(c >= tm.before(as_of, 24, "HOURS"), "Online (<24h)")
        .when(c >= tm.before(as_of, 7, "DAYS"), "Idle (1-7d)")
        .when(c >= tm.before(as_of, 30, "DAYS"), "Offline (7-30d)")
        .otherwise("Dark (>30d)")
    )


def wait_band(days: Column | str) -> Column:
    """Band of a waiting or turnaround time in days."""
    d = col(days)
    return (
        F.when(d < 1, "Same day")
        .when(d < 3, "1-2d")
        .when(d < 8, "3-7d")
        .when(d <= 30, "8-30d")
        .otherwise("30d+")
    )


def age_band(days: Column | str) -> Column:
    """Band of an age in days; NULL for an unknown age."""
    d = col(days)
    return (
        F.when(d < 365, "<1y")
        .when(d < 2 * 365, "1-2y")
        .when(d < 3 * 365, "2-3y")
        .when(d < 5 * 365, "3-5y")
        .when(d.isNotNull(), "5y+")
    )


def deployment_band(days: Column | str) -> Column:
    """Short-range age band of a device's current placement."""
    d = col(days)
    return (
        F.when(d < 90, "<3 mo")
        .when(d < 180, "3-6 mo")
        .when(d < 365, "6-12 mo")
        .when(d < 730, "1-2 yr")
        .otherwise("2+ yr")
    )


def signal_bucket(signal: Column | str) -> Column:
    n = whole_number(signal)
    return (
        F.when(n.isNull(), "Unknown")
        .when(n < 10, "Poor")
        .when(n < 20, "Fair")
        .when(n < 30, "Good")
        .otherwise("Excellent")
    )


def battery_percent(level: Column | str) -> Column:
    """Battery charge, NULL while charging or unreadable."""
    return whole_number(F.nullif(F.upper(col(level)), F.lit("CHARGING")))


def battery_bucket(level: Column | str) -> Column:
    n = whole_number(level)
    return (
        F.when(F.upper(F.coalesce(col(level), F.lit(""))) == "CHARGING", "Charging")
        .when(n.isNull(), "Unknown")
        .when(n < 20, "Low")
        .otherwise("Normal")
    )


def counter_bucket(counter: Column | str) -> Column:
    n = whole_number(counter)
    return F.when(n == 0, "0").when(n <= 5, "1-5").when(n <= 20, "6-20").otherwise("21+")


def outcome_class(remarks: Column | str) -> Column:
    return (
        F.when(is_any(remarks, config.RESOLVED_OUTCOMES), "resolved")
        .when(is_any(remarks, config.UNRESOLVED_OUTCOMES), "unresolved")
        .otherwise("other")
    )


def location_key(pin: Column | str, city: Column | str, state: Column | str, country: Column | str) -> Column:
    """Stable key of a location: by postal code, else by city; NULL if it has neither."""
    land = F.coalesce(blank_to_null(country), F.lit(config.DEFAULT_COUNTRY))
    postal, town = clean(col(pin).cast("string")), clean(city)
    return F.when(postal != "", F.concat(F.lit("p:"), postal, F.lit("|"), land)).when(
        town != "", F.concat(F.lit("c:"), town, F.lit("|"), clean(state), F.lit("|"), land)
    )


def center_type(c: Column | str) -> Column:
    t = col(c)
    return F.when(t == "NETWORK_SPOKE", "Spoke").when(t == "NETWORK_HUB", "Hub").when(t == "CENTER", "Center")


def tat_is_valid(tat: Column | str) -> Column:
    """Turnaround that is known and not negative."""
    return col(tat).isNotNull() & (col(tat) >= 0)
