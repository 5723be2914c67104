"""Devices: register index, serial resolution, cohorts and heartbeat telemetry."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens import config
from fleetlens.filters import Filters, by_center, where
from fleetlens.functions import classify as cl
from fleetlens.functions import time as tm
from fleetlens.functions.text import (
    blank_to_null, contains_text, decimal_number, label, model_of, serial_of, trimmed, whole_number,
)
from fleetlens.operators.explore import page_of, rank_counts, sort_order
from fleetlens.operators.tickets import failures_by_center
from fleetlens.sources.cleaned import center_dimension, register_devices
from fleetlens.sources.tables import Tables


def serial_map(heartbeats: DataFrame, centers: DataFrame) -> DataFrame:
    """serial, center_id: heartbeats first, then center device ids, then center adapter serials.

    One row per serial. Columns a center table lacks are skipped.
    """
    center_serials = [c for c in ("DeviceID", "MacSerialID") if c in centers.columns]
    found = heartbeats.select(F.lit(0).alias("rank"), F.col("DeviceID").alias("serial"), "CenterID")
    if center_serials:
        choices = F.array(
            *(F.struct(F.lit(i).alias("rank"), F.col(c).alias("serial")) for i, c in enumerate(center_serials, 1))
        )
        found = found.unionByName(
            centers.select(F.explode(choices).alias("s"), "CenterID").select("s.*", "CenterID")
        )
    serials = found.withColumn("serial", F.upper(trimmed("serial"))).filter(
        (F.col("serial") != "") & F.col("CenterID").isNotNull()
    )
    by_source = [F.min(F.when(F.col("rank") == i, F.col("CenterID"))) for i in range(len(center_serials) + 1)]
    return serials.groupBy("serial").agg(F.coalesce(*by_source).alias("center_id"))


def tracked(devices: DataFrame) -> DataFrame:
    """Drop housekeeping entries."""
    kind = F.lower(F.coalesce(trimmed("issuetype_name"), F.lit("")))
    return devices.filter(~kind.isin(*config.NON_DEVICE_TYPES))


def device_index(tables: Tables, as_of: datetime) -> DataFrame:
    """One row per tracked device, with serial, model, age and center (NULL when unmapped).

    A device with a blank key goes by its summary. ``issuetype_name`` and ``status_name`` are as registered,
    ``type`` and ``status`` as shown.
    """
    created = F.col("ticket_created")
    key = F.coalesce(F.nullif("issue_key", F.lit("")), "summary")
    devices = tracked(register_devices(tables.register)).filter(key != "").select(
        key.alias("key"),
        F.coalesce("summary", F.lit("")).alias("summary"),
        serial_of("summary").alias("serial"),
        F.coalesce(F.nullif("issuetype_name", F.lit("")), F.lit("Other")).alias("type"),
        model_of("summary").alias("category"),
        F.coalesce(trimmed("status_name"), F.lit("")).alias("status"),
        created.cast("date").alias("birthday"),
        tm.whole_days_between(created, tm.moment(as_of)).alias("age_days"),
        "issuetype_name", "status_name",
    )
    # A device without a serial matches nothing; its own key spreads such devices over all partitions.
    return (
        devices.withColumn("_match", F.coalesce("serial", F.concat(F.lit("?"), "key")))
        .join(serial_map(tables.heartbeats, tables.centers).withColumnRenamed("serial", "_match"), "_match", "left")
        .drop("_match")
    )


def filtered_devices(
    tables: Tables, as_of: datetime, filters: Filters = Filters(), index: DataFrame | None = None
) -> DataFrame:
    """Device index under the filters: type and status as registered, center attributes through the mapped
    center, the date range on the device's own creation date. An unknown status is never excluded."""
    types = list(filters.device_types)
    excluded = list(filters.device_status_exclude)
    df = where(
        device_index(tables, as_of) if index is None else index,
        F.col("issuetype_name").isin(types) if types else None,
        F.coalesce(~F.col("status_name").isin(excluded), F.lit(True)) if excluded else None,
        filters.dates("birthday"),
    )
    condition = filters.center_attributes()
    if condition is None:
        return df
    passing = center_dimension(tables.centers).filter(condition).select("center_id").distinct()
    return df.join(passing, "center_id", "left_semi")


def per_center(index: DataFrame) -> DataFrame:
    return (
        index.filter("center_id IS NOT NULL").groupBy("center_id").agg(F.count("*").alias("register_devices"))
    )


def fleet_stats(devices: DataFrame) -> DataFrame:
    return devices.agg(
        F.count("*").alias("total"),
        F.round(F.avg("age_days"), 0).cast("bigint").alias("avg_age_days"),
        F.count("age_days").alias("aged_devices"),
        F.count_if(cl.age_band("age_days") == "5y+").alias("past_life"),
    )


def fleet_status(devices: DataFrame) -> DataFrame:
    return rank_counts(devices, "status", "(blank)", name="k", count="n")


def fleet_age_bands(devices: DataFrame) -> DataFrame:
    band = cl.age_band("age_days")
    return devices.filter("age_days IS NOT NULL").groupBy(band.alias("k")).agg(F.count("*").alias("n"))


def status_and_type_counts(devices: DataFrame) -> DataFrame:
    """Counts by status and by type as one long table, in one pass."""
    named = devices.select(label("status", "(blank)").alias("status"), "type")
    by_status = F.grouping("status") == 0
    return (
        named.groupingSets([["status"], ["type"]], "status", "type")
        .agg(
            F.when(by_status, "status").otherwise("type").alias("dim"),
            F.when(by_status, F.col("status")).otherwise(F.col("type")).alias("label"),
            F.count("*").alias("cnt"),
        )
        .select("dim", "label", "cnt")
    )


def batch_cohorts(devices: DataFrame, failures: DataFrame) -> DataFrame:
    """Failure behaviour by year of birth.

    A failure before birth counts as failed, but not towards the time to first failure. The exact median
    is taken over distinct day counts, so its state is bounded by the days, not by the devices.
    """
    born = devices.filter("birthday IS NOT NULL").withColumn("batch_year", F.year("birthday"))
    # Reduce to center and birthday before meeting the failures: a busy center arrives as few rows.
    groups = born.groupBy("batch_year", "birthday", F.col("center_id").alias("cid")).agg(F.count("*").alias("n"))
    failed = F.col("first_fail").isNotNull()
    later = F.col("first_fail") > F.col("birthday").cast("timestamp_ntz")
    days = F.when(later, tm.whole_days_between(F.col("birthday").cast("timestamp_ntz"), F.col("first_fail")))
    joined = groups.join(failures, "cid", "left").withColumn("ttff", days)
    by_days = (
        joined.groupBy("batch_year", "ttff", "top_cat")
        .agg(
            F.sum("n").alias("devices"),
            F.sum(F.when(failed, F.col("n")).otherwise(0)).alias("failed"),
            F.sum(F.when(failed, F.col("n") * F.col("n_fail")).otherwise(0)).alias("failures"),
        )
    )
    # One pass serves both breakdowns: by day count for the statistics, by category for the top issue.
    sums = [F.sum(c).alias(c) for c in ("devices", "failed", "failures")]
    parts = by_days.groupingSets(
        [["batch_year", "ttff"], ["batch_year", "top_cat"]], "batch_year", "ttff", "top_cat"
    ).agg(*sums, (F.grouping("ttff") == 0).alias("by_day"))
    by_day, ttff, counted = F.col("by_day"), F.col("ttff"), F.col("failed") > 0
    named_issue = ~by_day & counted & (F.coalesce("top_cat", F.lit("")) != "")

    def total(c: str, condition: Column = F.lit(True)) -> Column:
        return F.coalesce(F.sum(F.when(by_day & condition, F.col(c))), F.lit(0))

    leading = F.min(F.when(named_issue, F.struct((-F.col("failed")).alias("rank"), "top_cat")))
    return (
        parts.groupBy("batch_year")
        .agg(
            total("devices").alias("devices"),
            F.round(total("failed") / total("devices") * 100, 1).alias("ftf_rate_pct"),
            F.round(F.expr("percentile(CASE WHEN by_day THEN ttff END, 0.5, devices)"), 0).cast("bigint").alias("median_ttff_days"),
            total("devices", ttff < 7).alias("early_fails"),
            F.round(total("failures") / total("devices"), 2).alias("avg_failures"),
            F.coalesce(leading["top_cat"], F.lit("")).alias("top_issue"),
        )
        .orderBy("batch_year")
    )


def cohorts(tables: Tables, as_of: datetime, filters: Filters = Filters()) -> DataFrame:
    return batch_cohorts(filtered_devices(tables, as_of, filters), failures_by_center(tables))


def center_devices(tables: Tables, as_of: datetime, center_id: int, limit: int = 100) -> DataFrame:
    """Devices of one center, oldest first."""
    return (
        device_index(tables, as_of)
        .filter(F.col("center_id") == center_id)
        .orderBy(F.coalesce("age_days", F.lit(0)).desc(), "key")
        .limit(limit)
    )


# Telemetry


def _online(as_of: datetime) -> Column:
    since = tm.before(tm.shifted_moment(as_of), config.ONLINE_WINDOW_HOURS, "HOURS")
    return F.count_if(F.col("LastTimeStamp") >= since).alias("online")


def center_telemetry(heartbeats: DataFrame, as_of: datetime) -> DataFrame:
    battery = cl.battery_percent("BatteryLevel")
    return heartbeats.groupBy(F.col("CenterID").alias("center_id")).agg(
        F.count("*").alias("devices"),
        _online(as_of),
        F.max("LastTimeStamp").alias("last_seen"),
        F.round(F.avg(whole_number("CSQ")), 1).alias("avg_csq"),
        F.round(F.avg(battery), 1).alias("avg_battery"),
        F.count_if(battery < 20).alias("low_battery"),
    )


def heartbeat_scope(tables: Tables, filters: Filters = Filters()) -> DataFrame:
    return by_center(tables.heartbeats, tables, filters)


def telemetry_kpis(tables: Tables, as_of: datetime, filters: Filters = Filters()) -> DataFrame:
    latency, space = decimal_number("Latency"), decimal_number("SpaceAvailable")
    seen, listed = blank_to_null("hardwareversion_clouddevices"), blank_to_null("hardwareversion_devicestable")
    both = seen.isNotNull() & listed.isNotNull()
    return heartbeat_scope(tables, filters).agg(
        F.count("*").alias("total"),
        _online(as_of),
        F.round(F.avg(whole_number("CSQ")), 1).alias("avg_csq"),
        F.count_if(cl.battery_percent("BatteryLevel") < 20).alias("low_battery"),
        F.round(F.avg(latency), 1).alias("avg_latency"),
        F.count(latency).alias("latency_reporting"),
        F.round(F.avg(whole_number("Retries")), 1).alias("avg_retries"),
        F.coalesce(F.sum(whole_number("UnsyncedData")), F.lit(0)).alias("unsynced_total"),
        F.round(F.avg(space), 0).alias("avg_space"),
        F.count(space).alias("space_reporting"),
        F.count_if(both & (seen != listed)).alias("hw_mismatch"),
        F.count_if(both).alias("hw_both_reporting"),
    )


def bucket_counts(df: DataFrame, bucket: Column) -> DataFrame:
    return df.groupBy(bucket.alias("k")).agg(F.count("*").alias("n"))


def signal_buckets(tables: Tables, filters: Filters = Filters()) -> DataFrame:
    return bucket_counts(heartbeat_scope(tables, filters), cl.signal_bucket("CSQ"))


def battery_buckets(tables: Tables, filters: Filters = Filters()) -> DataFrame:
    return bucket_counts(heartbeat_scope(tables, filters), cl.battery_bucket("BatteryLevel"))


def counter_buckets(tables: Tables, filters: Filters = Filters()) -> DataFrame:
    reporting = heartbeat_scope(tables, filters).filter(whole_number("EcgCounter").isNotNull())
    return bucket_counts(reporting, cl.counter_bucket("EcgCounter"))


def hardware_versions(tables: Tables, filters: Filters = Filters(), limit: int = 8) -> DataFrame:
    df = heartbeat_scope(tables, filters)
    return rank_counts(df, "hardwareversion_clouddevices", "Unknown", limit, name="hw", count="devices")


TELEMETRY_SORT_KEYS = {
    "device": "device", "center": "_center", "hub": "_hub", "last_seen": "_last", "csq": "csq", "battery": "_battery",
    "latency": "latency", "retries": "retries", "space": "space_avail", "ecg": "ecg",
}


def telemetry_explorer(
    tables: Tables, as_of: datetime, filters: Filters = Filters(), search: str = "",
    sort_by: str = "last_seen", sort_dir: str = "desc", page: int = 0, size: int = 15,
) -> DataFrame:
    rows = heartbeat_scope(tables, filters).select(
        F.col("DeviceID").alias("device"),
        F.coalesce("Centername", F.lit("")).alias("center"),
        F.coalesce("HubName", F.lit("")).alias("hub"),
        tm.stamp_label("LastTimeStamp").alias("last_seen"),
        F.coalesce("BatteryLevel", F.lit("")).alias("battery"),
        whole_number("CSQ").alias("csq"),
        decimal_number("Latency").alias("latency"),
        whole_number("Retries").alias("retries"),
        decimal_number("SpaceAvailable").alias("space_avail"),
        whole_number("EcgCounter").alias("ecg"),
        whole_number("UnsyncedData").alias("unsynced"),
        label("hardwareversion_clouddevices", "Unknown").alias("hardware"),
        label("hardwareversion_devicestable", "").alias("hardware_dt"),
        cl.recency_bucket("LastTimeStamp", tm.shifted_moment(as_of)).alias("status"),
        F.col("Centername").alias("_center"), F.col("HubName").alias("_hub"), F.col("LastTimeStamp").alias("_last"),
        whole_number("BatteryLevel").alias("_battery"),
    )
    rows = where(rows, contains_text(("device", "center", "hub"), search, min_length=1))
    ties = [F.col(c).asc_nulls_first() for c in ("device", "last_seen", "csq", "battery", "latency", "retries")]
    order = sort_order(TELEMETRY_SORT_KEYS, sort_by, sort_dir, "last_seen", ties)
    return page_of(rows, order, page, size).drop("_center", "_hub", "_last", "_battery")
