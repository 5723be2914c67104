"""Every page of the service dashboard as named, lazy results under one filter set."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from datetime import datetime

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.filters import Filters, where
from fleetlens.functions.classify import segment_group
from fleetlens.operators import centers as ct
from fleetlens.operators import devices as dv
from fleetlens.operators import explore as ex
from fleetlens.operators import geo, rollups
from fleetlens.operators import service as sv
from fleetlens.operators import tickets as tk
from fleetlens.operators import uptime as up
from fleetlens.sources.tables import Tables

Page = dict[str, DataFrame]


def dashboard(t: Tables, as_of: datetime, filters: Filters, mart: DataFrame) -> Page:
    """Assets, centers and support. ``mart`` is the center mart, written beforehand."""
    scores = up.scored(t, as_of, filters)
    index = dv.device_index(t, as_of)
    devices = dv.filtered_devices(t, as_of, filters, index)
    return {
        "reliability": ct.named(up.reliability(scores), mart, up.worst_first()),
        "uptime_fleet": up.fleet(scores),
        "asset_health": up.health_watchlist(scores),
        "center_kpis": ct.kpis(t, filters),
        "geo": ct.by_state(t, filters),
        "geo_customers": ct.by_state_or_city(t, filters),
        "deployment_age": ct.deployment_age(t, as_of, filters),
        "segments": ct.by_segment(t, filters),
        "ticket_kpis": tk.kpis(t, as_of, filters),
        "sla_kpis": tk.sla_kpis(t, as_of, filters),
        "sla_by_type": tk.sla_by_category(t, as_of, filters),
        "sla_risk": tk.open_risk_by_category(t, as_of, filters),
        "ticket_trend": tk.trend(t, as_of, filters),
        "open_by_status": tk.open_by_status(t, filters),
        "ticket_categories": tk.recent_categories(t, as_of, filters),
        "open_age": tk.open_age_bands(t, as_of, filters),
        "ticket_segments": tk.recent_segments(t, as_of, filters),
        "segment_options": ex.options(t.centers, segment_group("hub_master_segment", None), "segment"),
        "state_options": ex.options(t.centers, "State", "state"),
        "city_options": ex.options(t.centers, "City", "city"),
        "country_options": ex.options(t.centers, "hub_country", "country"),
        "machine_type_options": ex.options(t.centers, "MachineType", "machine_type"),
        "device_type_options": ex.options(index, "type", "type"),
        "device_status_options": ex.options(index, "status", "status"),
        "assets": dv.status_and_type_counts(devices),
        "cohort_reliability": dv.batch_cohorts(devices, tk.failures_by_center(t)),
        "fleet": dv.fleet_stats(devices),
        "fleet_status": dv.fleet_status(devices),
        "fleet_age_bands": dv.fleet_age_bands(devices),
    }


def numbers(t: Tables, as_of: datetime, filters: Filters) -> Page:
    devices = dv.filtered_devices(t, as_of, filters)
    return {
        "totals": ct.totals(t, filters),
        "breakdown": ct.breakdown(t, filters),
        "devices": dv.fleet_stats(devices),
        "devices_by_status": dv.fleet_status(devices),
        "device_age_bands": dv.fleet_age_bands(devices),
        "tickets": tk.totals(t, filters),
        "tickets_by_status": tk.by_status(t, filters),
    }


def overview(t: Tables, as_of: datetime, filters: Filters, mart: DataFrame) -> Page:
    return {
        "customers": rollups.customers_tree(mart, filters),
        "devices": rollups.devices_tree_for(t, as_of, filters),
        "tickets": rollups.tickets_tree(t, filters),
    }


def site_map(t: Tables, as_of: datetime, filters: Filters, mart: DataFrame) -> Page:
    points = geo.map_points(mart, t.geo_store, filters)
    return {"centers": points, "assets": geo.located_devices(dv.device_index(t, as_of), points)}


def telemetry(t: Tables, as_of: datetime, filters: Filters, mart: DataFrame) -> Page:
    return {
        "kpis": dv.telemetry_kpis(t, as_of, filters),
        "signal": dv.signal_buckets(t, filters),
        "battery": dv.battery_buckets(t, filters),
        "hardware": dv.hardware_versions(t, filters),
        "counters": dv.counter_buckets(t, filters),
        "centers": geo.telemetry_points(mart, t.geo_store, filters),
        "unlocated": geo.unlocated_count(mart, t.geo_store, filters),
    }


def service(t: Tables, filters: Filters) -> Page:
    return {
        "kpis": sv.service_kpis(t, filters),
        "flow": sv.service_flow(t, filters),
        "tat_bands": sv.service_tat_bands(t, filters),
        **{chart: sv.service_counts(t, chart, filters) for chart in sv.SERVICE_CHARTS},
    }


def escalations(t: Tables, filters: Filters) -> Page:
    return {
        "kpis": sv.escalation_kpis(t, filters),
        "volume": sv.escalation_volume(t, filters),
        **{chart: sv.escalation_counts(t, chart, filters) for chart in sv.ESCALATION_CHARTS},
    }


def accounts(t: Tables, as_of: datetime, filters: Filters, mart: DataFrame) -> Page:
    return {
        "customers": rollups.accounts(mart, t.geo_store, filters),
        "totals": rollups.account_totals(t, mart, t.geo_store, as_of, filters),
    }


def center_detail(t: Tables, as_of: datetime, center_id: int) -> Page:
    return {
        "info": ct.profile(t, as_of, center_id),
        "tickets": tk.center_totals(t, center_id),
        "open_tickets": tk.center_tickets(t, center_id, only_open=True),
        "all_tickets": tk.center_tickets(t, center_id),
        "assets": dv.center_devices(t, as_of, center_id),
    }


def section_health(sections: Mapping[str, Callable[[], DataFrame]]) -> DataFrame:
    """(section, row_count, ok) of each section; one that cannot be put together is reported, without a count, beside the
    others. All counts are one query."""
    report = None
    for name, make in sections.items():
        try:
            counted = make().agg(F.count("*").alias("row_count"))
        except PySparkException:
            counted = None
        spark = SparkSession.active()
        row = spark.range(1).select(F.lit(None).cast("bigint").alias("row_count")) if counted is None else counted
        row = row.select(F.lit(name).alias("section"), "row_count", F.lit(counted is not None).alias("ok"))
        report = row if report is None else report.unionAll(row)
    return report


def health(t: Tables, as_of: datetime, filters: Filters, mart: DataFrame, located: DataFrame) -> DataFrame:
    """Every section of the dashboard, the center mart, the map's centers and those still without a place, by rows."""
    page = dashboard(t, as_of, filters, mart)
    sections: dict[str, Callable[[], DataFrame]] = {name: lambda df=df: df for name, df in page.items()}
    return section_health(sections | {
        "center_360": lambda: where(mart, filters.center_row()), "map_points": lambda: geo.map_points(located, None, filters),
        "unlocated_centers": lambda: where(located, filters.center_attributes()).filter("lat IS NULL"),
    })
