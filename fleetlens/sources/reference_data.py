"""Curated reference lists, small by nature, as local relations the optimizer can broadcast."""

from __future__ import annotations

import csv
from functools import cache
from importlib import resources

from pyspark.sql import DataFrame, SparkSession


@cache
def _rows(name: str) -> list[dict[str, str]]:
    text = resources.files("fleetlens.data").joinpath(name).read_text(encoding="utf-8")
    lines = [line for line in text.splitlines() if line and not line.startswith("#")]
    return list(csv.DictReader(lines, delimiter="|", quoting=csv.QUOTE_NONE))


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def sla_catalog_rows() -> list[tuple[str, int, bool]]:
    """(lower-cased category, target days, technical) of every catalog entry."""
    return [(r["name"].strip().lower(), int(r["days"]), r["tech"] == "true") for r in _rows("sla_catalog.csv")]


def account_group_rows() -> list[tuple[str, str, list[int]]]:
    return [(r["group"], r["tier"], [int(h) for h in r["hub_ids"].split()]) for r in _rows("account_groups.csv")]


def sla_catalog(spark: SparkSession) -> DataFrame:
    """category_key, catalog_days, catalog_tech."""
    values = ", ".join(f"({_text(n)}, {d}, {str(t).lower()})" for n, d, t in sla_catalog_rows())
    return spark.sql(f"SELECT * FROM VALUES {values} AS t(category_key, catalog_days, catalog_tech)")


def account_groups(spark: SparkSession) -> DataFrame:
    """account, tier."""
    values = ", ".join(f"({_text(g)}, {_text(t)})" for g, t, _ in account_group_rows())
    return spark.sql(f"SELECT * FROM VALUES {values} AS t(account, tier)")


def account_hubs(spark: SparkSession) -> DataFrame:
    """account, hub_id: one row per listed hub."""
    values = ", ".join(f"({_text(g)}, {h}L)" for g, _, hubs in account_group_rows() for h in hubs)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t(account, hub_id)")
