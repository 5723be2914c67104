"""Builders of the service tables from their own sources."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.config import CLOCK_OFFSET_MINUTES
from fleetlens.functions import time as tm
from fleetlens.functions.classify import center_type
from fleetlens.functions.text import col, trimmed
from fleetlens.operators.joins import left_join_spread
from fleetlens.sources.bucketed import Bucketed


def json_scalar(text: Column | str, key: str | None = None) -> Column:
    """A scalar of a JSON text by key (or the text's own root); NULL for an object, an array or broken JSON."""
    return parsed_scalar(F.try_parse_json(col(text)), key)


def parsed_scalar(parsed: Column, key: str | None = None) -> Column:
    """``json_scalar`` of a JSON that is parsed already."""
    path = f"$['{key}']" if key is not None else "$"
    value = F.try_variant_get(parsed, path, "variant")
    nested = F.schema_of_variant(value).rlike("^(OBJECT|ARRAY)")
    return F.when(~nested, F.try_variant_get(value, "$", "string"))


def usage_by_center(usage: DataFrame, centers: DataFrame) -> DataFrame:
    """Total, daily average and last date of daily counts per known center.

    Usage is summed per center before it meets the centers.
    """
    stats = usage.groupBy("CenterID").agg(
        F.sum("Number_of_ECGs").alias("s"), F.count("Number_of_ECGs").alias("n"), F.max("AcquiredDate").alias("last")
    )
    return _usage(centers.select("CenterID").join(stats, "CenterID"), "CenterID")


def usage_by_hub(usage: DataFrame, centers: DataFrame, digits: int = 4) -> DataFrame:
    stats = usage.groupBy("CenterID").agg(
        F.sum("Number_of_ECGs").alias("s"), F.count("Number_of_ECGs").alias("n"), F.max("AcquiredDate").alias("last")
    )
    return _usage(centers.select("CenterID", "HubID").join(stats, "CenterID"), "HubID", digits)


def _usage(rows: DataFrame, key: str, digits: int = 4) -> DataFrame:
    return rows.groupBy(key).agg(
        F.sum("s").alias("total_ecgs"),
        F.round(F.try_divide(F.sum("s"), F.sum("n")), digits).alias("daily_avg"),
        F.max("last").alias("last_ecg_date"),
    )


def latest_device(usage: DataFrame) -> DataFrame:
    """Device of the latest usage row per center."""
    order = [F.col("AcquiredDate").desc_nulls_last(), *(F.col(c).asc_nulls_first() for c in ("DeviceID", "MacSerialID", "MachineType"))]
    ranked = usage.withColumn("_rank", F.row_number().over(Window.partitionBy("CenterID").orderBy(*order)))
    return ranked.filter("_rank = 1").select(
        "CenterID", F.col("AcquiredDate").alias("acquired_date"), "DeviceID", "MacSerialID", "MachineType"
    )


def centers_with_device(centers: DataFrame, usage: DataFrame) -> DataFrame:
    return centers.select("CenterID", "Centername").join(latest_device(usage), "CenterID", "left")


def plan_dates(plans: DataFrame) -> DataFrame:
    return plans.groupBy("centerid").agg(
        F.min("startdate").alias("earliest_plan"), F.max("startdate").alias("latest_plan")
    )


def critical_call(preferences: DataFrame) -> DataFrame:
    value = json_scalar("preferences", "criticalCall").alias("critical_call")
    return preferences.select("centerid", value).filter("critical_call IS NOT NULL")


def kind_columns(today: date) -> list[Column]:
    return [
        center_type("type").alias("type"),
        tm.months_between_starts("deploymentdate", F.lit(today.isoformat()).cast("date")).alias("age_in_months"),
        F.when(F.col("Spoke_Center_Segment") == "F2P_CENTER", 1).otherwise(0).alias("f2p_customer"),
    ]


def center_kinds(centers: DataFrame, today: date) -> DataFrame:
    """Decoded type, age in month boundaries and free-to-pay flag of each center."""
    return centers.select("CenterID", *kind_columns(today))


def with_parsed_fields(centers: DataFrame) -> DataFrame:
    """Center rows with their custom fields parsed, once for all keys, as ``_fields``.

    A small file holds very many centers, and parsing takes far longer than reading: rows are dealt to all tasks first.
    """
    return centers.repartition("CenterID", "customfields").withColumn("_fields", F.try_parse_json("customfields"))


# Keys of the custom-field JSON.
CUSTOM_FIELDS = {
    "Is Bulk Download Enable": "is_bulk_download_enable", "Customer Status": "customer_status", "Master Segment": "master_segment",
    "Service Type": "service_type", "Webhook Meta": "webhook_meta", "Patient info hook meta": "patient_info_hook_meta",
    "Patient info hook": "patient_info_hook", "Transformer Webhook": "transformer_webhook",
    "ECHO configuration": "echo_configuration", "disable_rediagnosis": "disable_rediagnosis",
}


def custom_field_columns() -> list[Column]:
    """Columns of rows ``with_parsed_fields``."""
    fields = F.col("_fields")
    return [
        *(parsed_scalar(fields, k).alias(n) for k, n in CUSTOM_FIELDS.items()),
        json_scalar(parsed_scalar(fields, "Webhook")).alias("webhook"),
    ]


def custom_fields(centers: DataFrame) -> DataFrame:
    """Typed columns from the custom-field JSON; the webhook is a JSON text held inside it."""
    return with_parsed_fields(centers).select("CenterID", *custom_field_columns())


CONFIG_NAMES = ("CASE_SUBMISSION", "ENABLE_CASES_TYPE", "PRODUCT_OFFERING", "REPORT_TEMPLATE")


def config_columns(centers: DataFrame, config: DataFrame) -> DataFrame:
    """Key/value configuration pivoted to columns, with the default submission mode of unconfigured hubs."""
    wide = config.groupBy("centerid").pivot("name", list(CONFIG_NAMES)).agg(F.max("value"))
    submission = json_scalar("CASE_SUBMISSION", "RESTING")
    unset_hub = (F.col("type") == "NETWORK_HUB") & F.col("CASE_SUBMISSION").isNull()
    return centers.select("CenterID", "type").join(wide.withColumnRenamed("centerid", "CenterID"), "CenterID", "left").select(
        "CenterID",
        F.col("ENABLE_CASES_TYPE").alias("case_type"),
        submission.alias("case_submission"),
        F.coalesce(submission, F.when(unset_hub, "AUTO_SUBMISSION")).alias("case_submission_default"),
        json_scalar("PRODUCT_OFFERING", "value").alias("product_offering"),
        json_scalar("REPORT_TEMPLATE", "value").alias("report_template"),
    )


# Attribute of a curated sheet -> key of the JSON that overrides it.
SPOKE_ATTRIBUTES = {"master_segment": "Master Segment", "service_type": "Service Type", "hardware_type": "Hardware Type"}
HUB_ATTRIBUTES = SPOKE_ATTRIBUTES | {"hardware_sale_type": "Hardware Sale Type"}


def segment_overrides(centers: DataFrame, spoke_sheet: DataFrame, hub_sheet: DataFrame) -> DataFrame:
    """Attributes from a center's own JSON, else the curated sheet; for the center and for its hub."""
    rows = with_parsed_fields(centers.select("CenterID", "HubID", "customfields"))

    def own_values(prefix: str, attributes: dict[str, str]) -> list[Column]:
        return [parsed_scalar(F.col("_fields"), k).alias(f"{prefix}_own_{c}") for c, k in attributes.items()]

    hubs = rows.select(F.col("CenterID").alias("HubID"), *own_values("h", HUB_ATTRIBUTES))

    def sheet(df: DataFrame, key: str, to: str, prefix: str, attributes: dict[str, str]) -> DataFrame:
        return df.select(F.col(key).alias(to), *(F.col(c).alias(f"{prefix}_{c}") for c in attributes))

    def chosen(prefix: str, shown: str, attributes: dict[str, str]) -> list[Column]:
        return [F.coalesce(f"{prefix}_own_{c}", f"{prefix}_{c}").alias(f"{shown}_{c}") for c in attributes]

    own = rows.select("CenterID", "HubID", *own_values("s", SPOKE_ATTRIBUTES)).join(
        sheet(spoke_sheet, "centerid", "CenterID", "s", SPOKE_ATTRIBUTES), "CenterID", "left"
    )
    with_hub_fields = left_join_spread(own, hubs, "HubID")
    return left_join_spread(with_hub_fields, sheet(hub_sheet, "hubid", "HubID", "h", HUB_ATTRIBUTES), "HubID").select(
        "CenterID", *chosen("s", "spk", SPOKE_ATTRIBUTES), *chosen("h", "hub", HUB_ATTRIBUTES)
    )


def with_hub(centers: DataFrame) -> DataFrame:
    """Each center beside its hub's row."""
    hubs = centers.select(F.col("CenterID").alias("HubID"), F.col("Centername").alias("hub_center"), F.col("Current_MRR").alias("hub_mrr"))
    return left_join_spread(centers.select("CenterID", "HubID", "Current_MRR"), hubs, "HubID").select(
        "CenterID", "HubID", F.col("Current_MRR").alias("mrr"), "hub_center", "hub_mrr"
    )


def with_zone(centers: DataFrame, zones: DataFrame) -> DataFrame:
    """Zone by state name, compared trimmed and in lower case."""
    keyed = zones.select(F.lower(trimmed("state")).alias("_state"), F.col("Zone").alias("zone"))
    # A center without a state matches nothing; its id spreads such centers over all partitions.
    spread = F.concat(F.lit("?"), F.col("CenterID").cast("string"))
    return (
        centers.select("CenterID", "state", F.coalesce(F.lower(trimmed("state")), spread).alias("_state"))
        .join(keyed, "_state", "left")
        .select("CenterID", "state", "zone")
    )


def with_organization(centers: DataFrame, hub_names: DataFrame) -> DataFrame:
    """Organisation of a center's hub; a hub id that is no number never matches."""
    names = hub_names.select(F.col("hub_id").try_cast("bigint").alias("HubID"), "organization_name").filter("HubID IS NOT NULL")
    return left_join_spread(centers.select("CenterID", "HubID"), names, "HubID").select("CenterID", "HubID", "organization_name")


# Columns of the center source -> their names in the center table.
RENAMED_CENTER_COLUMNS = {"pin": "PinCode", "city": "City", "state": "State", "Country2": "hub_country"}


def build_center_details(
    centers: DataFrame, usage: DataFrame, plans: DataFrame, preferences: DataFrame, config: DataFrame, zones: DataFrame,
    spoke_sheet: DataFrame, hub_sheet: DataFrame, hub_names: DataFrame, today: date,
) -> DataFrame:
    """The center table: each center's own columns beside all that the other sources hold of it and of its hub.

    ``CenterID`` is the key of ``centers``. Every side has one row per center before it is joined, and all but the hub's
    calls meet on that key, so they share one partitioning.
    """
    replaced = {"type", "customfields", *(c.lower() for c in RENAMED_CENTER_COLUMNS)}
    own = with_parsed_fields(centers).select(
        *(c for c in centers.columns if c.lower() not in replaced), *(F.col(c).alias(n) for c, n in RENAMED_CENTER_COLUMNS.items()),
        *kind_columns(today), *custom_field_columns(),
    )
    hub_usage = usage_by_hub(usage, centers, digits=2).filter("HubID IS NOT NULL").select(
        F.col("HubID").alias("CenterID"), *(F.col(c).alias(f"hub_{c}") for c in ("total_ecgs", "daily_avg", "last_ecg_date"))
    )
    calls = critical_call(preferences)
    chosen = preferences.select(
        F.col("centerid").alias("CenterID"), json_scalar("preferences", "doNotAutoSuspend").alias("do_not_auto_suspend"),
        json_scalar("preferences", "showRepeatEcg").alias("show_repeat_ecg"),
    )
    built = left_join_spread(own, calls.select(F.col("centerid").alias("HubID"), F.col("critical_call").alias("hub_critical_call")), "HubID")
    sides = (
        usage_by_center(usage, centers), hub_usage, latest_device(usage), plan_dates(plans), calls, chosen,
        config_columns(centers, config), segment_overrides(centers, spoke_sheet, hub_sheet),
        with_hub(centers).drop("HubID", "mrr"), with_zone(centers, zones).drop("state"), with_organization(centers, hub_names).drop("HubID"),
    )
    for side in sides:
        built = built.join(side.withColumnRenamed("centerid", "CenterID"), "CenterID", "left")
    return built.withColumn("do_not_auto_suspend_default", F.coalesce("do_not_auto_suspend", F.lit("0")))


HEARTBEAT_FIELDS = ("BatteryLevel", "LastShutdown", "BatteryDischarging", "SpaceAvailable", "EcgCounter", "Retries", "Latency")


def build_heartbeats(heartbeats: DataFrame | Bucketed, devices: DataFrame, centers: DataFrame) -> DataFrame:
    """The heartbeat table: JSON fields as columns, timestamps on the shifted clock, the device's center.

    Devices meet their centers first, so the heartbeats are joined once; bucketed by ``DeviceID`` they are not moved.
    """
    listed = devices.select(
        F.col("deviceid").alias("DeviceID"), F.col("centerid").try_cast("bigint").alias("CenterID"),
        F.col("hardwareversion").alias("hardwareversion_devicestable"),
    ).filter("CenterID IS NOT NULL")
    seen = F.col("LastTimeStamp").try_cast("timestamp_ntz") + F.expr(f"INTERVAL {CLOCK_OFFSET_MINUTES} MINUTES")
    placed = listed.join(centers.select("CenterID", "Centername", "HubID", "HubName"), "CenterID")
    return (
        _joined(heartbeats, placed, ["DeviceID"])
        .select(
            "CenterID", "Centername", "HubID", "HubName", "DeviceID", "IMSI", "CSQ", seen.alias("LastTimeStamp"),
            "ServiceProvider", "PreviousHBLatency", "UnsyncedData", "lastHeartbeatData",
            *(json_scalar("lastHeartbeatData", f).alias(f) for f in HEARTBEAT_FIELDS),
            F.col("hardwareversion").alias("hardwareversion_clouddevices"), "hardwareversion_devicestable", "FirmwareName",
        )
    )


# Column of the managers' sheet -> its name in the ticket table.
MANAGER_COLUMNS = {
    "account_manager": "account_manager", "sales_manager": "sales_manager", "offering": "offering", "grp": "manager_group",
    "segment": "manager_sheet_segment", "vcardia": "vcardia", "mac": "mac", "tr": "tr", "total_units": "total_units",
    "inactive_units": "inactive_units", "active_units": "active_units",
}


def build_support_tickets(
    tickets: DataFrame | Bucketed, centers: DataFrame, members: DataFrame, organizations: DataFrame, managers: DataFrame
) -> DataFrame:
    """Tickets, with all their own columns, beside their center, hub, organisation and account manager.

    The small sides meet first, so the ticket table is joined once; bucketed by ``CenterID`` it is not moved. A ticket's
    own column gives way to one of that name from the other sides.
    """
    orgs = members.join(organizations, "organization_id").select(
        F.col("member_id").try_cast("bigint").alias("HubID"), "organization_name"
    ).filter("HubID IS NOT NULL")
    hubs = centers.select(
        F.col("CenterID").alias("HubID"), json_scalar("customfields", "Master Segment").alias("hub_master_segment"), F.col("IS_PREPAID").alias("is_prepaid")
    )
    people = managers.select(F.col("hub_id").alias("HubID"), *(F.col(c).alias(n) for c, n in MANAGER_COLUMNS.items()))
    enriched = (
        centers.select(
            "CenterID", "HubID", json_scalar("customfields", "Master Segment").alias("master_segment"),
            F.col("type").alias("customer_type"), F.col("Suspended").alias("suspended"),
            F.col("Status").alias("customer_status"), F.col("pin").alias("pincode"),
        )
        .join(hubs, "HubID")
        .join(orgs, "HubID", "left")
        .join(people, "HubID", "left")
        .drop("HubID")
    )
    names = tickets.read(centers.sparkSession).columns if isinstance(tickets, Bucketed) else tickets.columns
    renamed = {c: f"_new_{c}" for c in enriched.columns if c != "CenterID"}
    added = {c.lower() for c in renamed}
    joined = _joined(tickets, enriched.withColumnsRenamed(renamed), ["CenterID"])
    kept = [c for c in names if c in joined.columns and c.lower() not in added]
    return joined.select("CenterID", *(c for c in kept if c != "CenterID"), *(F.col(new).alias(c) for c, new in renamed.items()))


def numeric_order(rows: DataFrame, c: str) -> DataFrame:
    """Order a text id by its numeric value, largest first; ids that are no number come last."""
    return rows.orderBy(F.col(c).try_cast("bigint").desc_nulls_last(), F.col(c).asc_nulls_last())


def build_register(issues: DataFrame, changelog: DataFrame | Bucketed) -> DataFrame:
    """Issues fanned out over their changes; an issue without any keeps one row.

    Issues with changes are joined by an inner join, which adaptive execution can split where one issue
    holds very many changes; an outer join could not be split on that side. A changelog bucketed by both keys
    is not moved: the issues go to its buckets, and only its distinct keys to the issues.
    """
    keys = ["project_key", "issue_key"]
    changes = changelog.read(issues.sparkSession).drop("_salt") if isinstance(changelog, Bucketed) else changelog
    changed = _joined(changelog, issues, keys).select(*issues.columns, *(c for c in changes.columns if c not in keys))
    unchanged = issues.join(changes.select(*keys).distinct(), keys, "left_anti")
    return changed.unionByName(unchanged, allowMissingColumns=True)


def _joined(facts: DataFrame | Bucketed, small: DataFrame, keys: list[str]) -> DataFrame:
    return facts.join(small.sparkSession, small) if isinstance(facts, Bucketed) else facts.join(small, keys)
