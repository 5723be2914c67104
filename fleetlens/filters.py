"""The universal filter set: one frozen object, turned into Column predicates per table."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date
from functools import reduce
from operator import and_
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens import config
from fleetlens.functions.classify import segment_group
from fleetlens.functions.text import clean, col

if TYPE_CHECKING:
    from fleetlens.sources.tables import Tables

_DATE = re.compile(r"\d{4}-\d{2}-\d{2}")

# Filter dimension -> column, on the raw center table and on the normalised dimension.
_RAW = {
    "segments": "hub_master_segment", "statuses": "Status", "states": "State", "hubs": "HubName",
    "cities": "City", "countries": "hub_country", "centers": "CenterID", "billable": "Billable",
    "machine_types": "MachineType", "device_ids": "DeviceID", "mac_serials": "MacSerialID",
}
_NORMALISED = {
    "segments": "segment", "statuses": "status", "states": "state", "hubs": "hub", "cities": "city",
    "countries": "country", "centers": "center_id", "billable": "billable",
    "machine_types": "machine_type", "device_ids": "device_id", "mac_serials": "mac_serial_id",
}


def in_list(c: Column | str, values: Sequence[str]) -> Column | None:
    """Include filter; None when there is nothing to restrict."""
    wanted = [v for v in values if v]
    return clean(c).isin(wanted) if wanted else None


def not_in_list(c: Column | str, values: Sequence[str]) -> Column | None:
    """Exclude filter; None when there is nothing to exclude."""
    wanted = [v for v in values if v]
    return ~clean(c).isin(wanted) if wanted else None


def _day(text: str) -> date | None:
    """The day a bound names; None for anything that is not a day of the calendar."""
    try:
        return date.fromisoformat(text) if _DATE.fullmatch(text or "") else None
    except ValueError:
        return None


def date_range(c: Column | str, start: str = "", end: str = "") -> Column | None:
    """Inclusive date range; a malformed bound is ignored, a NULL date fails an active range."""
    day = col(c).cast("date")
    parts = []
    first, last = _day(start), _day(end)
    if first:
        parts.append(day >= F.lit(first))
    if last:
        parts.append(day <= F.lit(last))
    return all_of(*parts)


def month_range(c: Column | str, start: str = "", end: str = "") -> Column | None:
    """The months a date range touches, over month numbers: what the range implies about a monthly partition."""
    first, last = _day(start), _day(end)
    return all_of(
        col(c) >= first.year * 12 + first.month - 1 if first else None, col(c) <= last.year * 12 + last.month - 1 if last else None
    )


def all_of(*parts: Column | None) -> Column | None:
    present = [p for p in parts if p is not None]
    return reduce(and_, present) if present else None


def where(df: DataFrame, *parts: Column | None) -> DataFrame:
    condition = all_of(*parts)
    return df if condition is None else df.filter(condition)


@dataclass(frozen=True)
class Filters:
    """Multi-value dimensions plus a date range; an empty dimension restricts nothing."""

    segments: tuple[str, ...] = ()
    statuses: tuple[str, ...] = ()
    states: tuple[str, ...] = ()
    hubs: tuple[str, ...] = ()
    cities: tuple[str, ...] = ()
    countries: tuple[str, ...] = ()
    centers: tuple[str, ...] = ()
    billable: tuple[str, ...] = ()
    machine_types: tuple[str, ...] = ()
    device_ids: tuple[str, ...] = ()
    mac_serials: tuple[str, ...] = ()
    device_types: tuple[str, ...] = ()
    device_status_exclude: tuple[str, ...] = ()
    date_from: str = ""
    date_to: str = ""
    hub: str = ""

    def center(self) -> Column | None:
        """Center attributes over the raw center table."""
        return self._attributes(_RAW, raw=True)

    def center_row(self) -> Column | None:
        """Center attributes and deployment date over normalised center rows."""
        return all_of(self._attributes(_NORMALISED, raw=False), self.dates("deployment_date"))

    def center_attributes(self) -> Column | None:
        """Center attributes alone, over normalised center rows."""
        return self._attributes(_NORMALISED, raw=False)

    def _attributes(self, names: dict[str, str], raw: bool) -> Column | None:
        parts = []
        for dimension, column in names.items():
            c = col(column)
            if dimension == "segments" and raw:
                c = segment_group(c)
            elif dimension == "centers":
                c = c.cast("string")
            parts.append(in_list(c, getattr(self, dimension)))
        return all_of(*parts)

    def dates(self, c: Column | str) -> Column | None:
        return date_range(c, self.date_from, self.date_to)

    def months(self, c: Column | str) -> Column | None:
        return month_range(c, self.date_from, self.date_to)

    def one_hub(self) -> Column | None:
        """Exact single-hub match; the empty name means every hub."""
        return col("HubName") == self.hub if self.hub else None

    def service(self) -> Column | None:
        """The dimensions a field-service ticket carries itself."""
        return all_of(
            in_list(segment_group("customer_category"), self.segments),
            in_list("state", self.states),
            in_list("city", self.cities),
            self.dates("created_on"),
        )

    def escalation(self) -> Column | None:
        """The dimensions an escalation carries itself."""
        return all_of(in_list("center_id", self.centers), self.dates("received_date"))

    def register(self) -> Column | None:
        """The dimensions a raw register row carries itself."""
        return all_of(
            in_list("issuetype_name", self.device_types),
            not_in_list("status_name", self.device_status_exclude),
            self.dates("ticket_created"),
        )


DEFAULT_FILTERS = Filters(
    statuses=config.DEFAULT_CENTER_STATUSES,
    device_status_exclude=config.DEFAULT_STATUS_EXCLUDE,
)


def by_center(facts: DataFrame, tables: Tables, filters: Filters) -> DataFrame:
    """Keep fact rows whose center passes the center attributes; a no-op without such a filter.

    A semi join takes each row once however often its center is listed. The centers are left as a filtered scan, without
    a distinct, so that large facts are thinned by a runtime Bloom filter of the passing ids before their shuffle.
    """
    condition = filters.center()
    if condition is None:
        return facts
    return facts.join(tables.centers.filter(condition).select("CenterID"), "CenterID", "left_semi")
