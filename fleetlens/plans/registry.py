"""Registered queries: name -> (Spark callable, check SQL)."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.functions import time as tm
from fleetlens.plans import check_sql
from fleetlens.sources.proxy import proxy_tables
from fleetlens.sources.tables import Tables


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[Tables], DataFrame]
    sql: str | None

    def run(self, spark: SparkSession, folder: str) -> DataFrame:
        return _plain(self.build(proxy_tables(spark, folder)))

    def oracle(self) -> str | None:
        return check_sql.complete(self.sql) if self.sql else None


QUERIES: dict[str, Query] = {}


def query(name: str, sql: str | None = None) -> Callable[[Callable[[Tables], DataFrame]], Callable[[Tables], DataFrame]]:
    """Register a query over the proxy tables, with the SQL that checks it."""

    def add(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = Query(name, build, sql)
        return build

    return add


def _plain(df: DataFrame) -> DataFrame:
    """Dates and timestamps as text, so that every engine writes them alike."""

    def shown(f: T.StructField):
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            return tm.stamp_label(c).alias(f.name)
        return c.cast("string").alias(f.name) if isinstance(f.dataType, T.DateType) else c

    if not any(isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)) for f in df.schema.fields):
        return df
    return df.select(*(shown(f) for f in df.schema.fields))


def load() -> dict[str, Query]:
    """All registered queries."""
    from fleetlens.plans import (  # noqa: F401  (importing registers)
        query_basics, query_centers, query_devices, query_lineage, query_profile, query_rollups, query_service,
        query_tickets, query_uptime,
    )

    if "P8_section_health" not in QUERIES:  # its check is made of the others'
        query("P8_section_health", query_profile.section_health_sql())(query_profile.section_health)

    def place(name: str) -> tuple[str, int, str]:
        letter, number = re.match(r"([A-Z])(\d+)", name).groups()
        return letter, int(number), name

    return {name: QUERIES[name] for name in sorted(QUERIES, key=place)}
