"""Logical tables and where they are read from."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession

from fleetlens.sources.cleaned import TICKET_CORE, TICKET_MONTH, cleaned_tickets

# Logical table -> default physical name.
TABLE_NAMES = {
    "center_details": "center_details",
    "support_tickets": "support_tickets",
    "heartbeats": "heartbeats",
    "device_register": "device_register",
    "field_service": "field_service",
    "escalations": "escalations",
    "deployments": "deployments",
    "geo_store": "geo_store",
}


class Tables:
    """Lazy access to the logical tables; each one is resolved on first use only."""

    def __init__(
        self, spark: SparkSession, load: Callable[[str], DataFrame], given: Mapping[str, DataFrame] | None = None
    ):
        self.spark = spark
        self._given = dict(given or {})
        self._read = load

    def _load(self, table: str) -> DataFrame:
        return self._given[table] if table in self._given else self._read(table)

    def replacing(self, frames: Mapping[str, DataFrame]) -> Tables:
        """The same tables with some taken from ``frames``, such as a materialised mart."""
        return Tables(self.spark, self._read, {**self._given, **frames})

    def mart(self, name: str) -> DataFrame | None:
        """A mart that was given in place of what it is built from, if there is one."""
        return self._given.get(name)

    def inputs(self, *names: str) -> dict[str, DataFrame]:
        """The logical tables ``names`` as they are read."""
        return {name: self._load(name) for name in names}

    def cleaned(self, *extra: str, within: Column | None = None) -> DataFrame:
        """Cleaned tickets with the core columns and ``extra``; from the mart once there is one.

        ``within`` is a condition on the month of creation that the caller's own filter implies; the mart is partitioned
        by that month, so that other months are not read.
        """
        mart = self.mart("cleaned_tickets")
        if mart is None:
            return cleaned_tickets(self.tickets, *extra)
        if within is not None and TICKET_MONTH in mart.columns:
            mart = mart.filter(within)
        return mart.select(*TICKET_CORE, *sorted(set(extra) - set(TICKET_CORE)))

    @classmethod
    def from_parquet(cls, spark: SparkSession, folder: str, names: Mapping[str, str] | None = None) -> Tables:
        paths = {**TABLE_NAMES, **(names or {})}
        return cls(spark, lambda t: spark.read.parquet(f"{folder}/{paths[t]}"))

    @classmethod
    def from_catalog(cls, spark: SparkSession, database: str, names: Mapping[str, str] | None = None) -> Tables:
        tables = {**TABLE_NAMES, **(names or {})}
        return cls(spark, lambda t: spark.table(f"{database}.{tables[t]}"))

    @classmethod
    def from_frames(cls, spark: SparkSession, frames: Mapping[str, DataFrame]) -> Tables:
        return cls(spark, frames.__getitem__)

    def scan(self, table: str, *columns: str) -> DataFrame:
        """A table by name, narrowed to ``columns`` when given."""
        df = self._load(table)
        return df.select(*columns) if columns else df

    @cached_property
    def centers(self) -> DataFrame:
        return self._load("center_details")

    @cached_property
    def tickets(self) -> DataFrame:
        return self._load("support_tickets")

    @cached_property
    def heartbeats(self) -> DataFrame:
        return self._load("heartbeats")

    @cached_property
    def register(self) -> DataFrame:
        return self._load("device_register")

    @cached_property
    def service(self) -> DataFrame:
        return self._load("field_service")

    @cached_property
    def escalations(self) -> DataFrame:
        return self._load("escalations")

    @cached_property
    def deployments(self) -> DataFrame:
        return self._load("deployments")

    @cached_property
    def geo_store(self) -> DataFrame:
        return self._load("geo_store")
