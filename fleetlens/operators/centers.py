"""Centers: counts, listings, profile and the one-row-per-center mart."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.filters import Filters, where
from fleetlens.functions import classify as cl
from fleetlens.functions import time as tm
from fleetlens.functions.text import blank_to_null, contains_text, label
from fleetlens.operators import devices as dv
from fleetlens.operators import uptime as up
from fleetlens.operators.explore import empties_last, page_of, rank_counts
from fleetlens.operators.sketches import bitmap_counts, bitmap_parts
from fleetlens.operators.tickets import center_ticket_stats
from fleetlens.sources.cleaned import center_dimension, one_row_per_center
from fleetlens.sources.tables import Tables


def scope(tables: Tables, filters: Filters = Filters(), dated: bool = True) -> DataFrame:
    return where(tables.centers, filters.center(), filters.dates("deploymentdate") if dated else None)


def kpis(tables: Tables, filters: Filters = Filters()) -> DataFrame:
    """Distinct centers, cities, active deployments and centers with an open ticket."""
    with_open = (
        tables.cleaned()
        .filter(F.col("CenterID").isNotNull() & cl.is_open("status"))
        .select("CenterID", F.lit(True).alias("has_open"))
        .distinct()
    )
    flagged = (
        scope(tables, filters)
        .groupBy("CenterID", blank_to_null("City").alias("city"))
        .agg(F.max(F.col("deactivationdate").isNull()).alias("active"))
        .join(with_open, "CenterID", "left")
    )
    return flagged.agg(
        F.countDistinct("CenterID").alias("centers"),
        F.countDistinct("city").alias("cities"),
        F.countDistinct(F.when(F.col("active"), F.col("CenterID"))).alias("active_deployments"),
        F.countDistinct(F.when(F.col("has_open"), F.col("CenterID"))).alias("centers_with_open_tickets"),
    )


def by_state(tables: Tables, filters: Filters = Filters(), limit: int = 12, column: str = "State") -> DataFrame:
    return rank_counts(
        scope(tables, filters), column, "Unknown", limit, name="state", count="devices", distinct="CenterID"
    )


def by_state_or_city(tables: Tables, filters: Filters = Filters(), limit: int = 12) -> DataFrame:
    """By state, or by city once exactly one state is selected."""
    return by_state(tables, filters, limit, column="City" if len(filters.states) == 1 else "State")


def deployment_age(tables: Tables, as_of: datetime, filters: Filters = Filters()) -> DataFrame:
    """Age bands, one age per center."""
    first = up.births(tables, filters)
    band = cl.age_band(tm.days_between("birth", tm.moment(as_of)))
    return first.groupBy(band.alias("band")).agg(F.count("*").alias("devices"))


def by_segment(
    tables: Tables, filters: Filters = Filters(), limit: int = 12, dated: bool = False,
    name: str = "status", count: str = "devices", entity: str = "CenterID",
) -> DataFrame:
    df = scope(tables, filters, dated)
    return rank_counts(
        df, cl.segment_group("hub_master_segment"), "(blank)", limit, name=name, count=count, distinct=entity
    )


def totals(tables: Tables, filters: Filters = Filters()) -> DataFrame:
    return scope(tables, filters).agg(
        F.countDistinct("CenterID").alias("centers"), F.countDistinct("HubID").alias("hubs")
    )


def _by_dimension(tables: Tables, filters: Filters) -> DataFrame:
    named = scope(tables, filters).select(
        label("Status", "(blank)").alias("status"), cl.segment_group("hub_master_segment").alias("segment"),
        "CenterID", "HubID", F.col("deploymentdate").alias("day"),
    )
    return named.select(
        F.explode(F.create_map(F.lit("status"), "status", F.lit("segment"), "segment")).alias("dim", "k"),
        "CenterID", "HubID", "day",
    )


def _ranked_labels(long: DataFrame, limit: int) -> DataFrame:
    """The labels are few; ranking them needs no large sort."""
    place = F.row_number().over(Window.partitionBy("entity", "dim").orderBy(F.desc("n"), "k"))
    kept = (F.col("dim") == "status") | (F.col("_place") <= limit)
    return long.withColumn("_place", place).filter(kept).select("entity", "dim", "k", "n")


def breakdown(tables: Tables, filters: Filters = Filters(), limit: int = 15) -> DataFrame:
    """Centers and hubs by status and by segment, as one long table in one pass."""
    counts = _by_dimension(tables, filters).groupBy("dim", "k").agg(
        F.countDistinct("CenterID").alias("centers"), F.countDistinct("HubID").alias("hubs")
    )
    entity = F.explode(F.create_map(F.lit("centers"), "centers", F.lit("hubs"), "hubs")).alias("entity", "n")
    return _ranked_labels(counts.select("dim", "k", entity).filter("n > 0 OR entity = 'hubs'"), limit)


def breakdown_parts(tables: Tables, filters: Filters = Filters()) -> DataFrame:
    """Bitmaps of the centers and hubs met under each label, by day of deployment; days merge exactly."""
    rows = _by_dimension(tables, filters)
    centers = bitmap_parts(rows.withColumnsRenamed({"CenterID": "centers", "HubID": "hubs"}), ["dim", "k"], ["centers", "hubs"], F.col("day"))
    # A label without any hub has its place among the hubs too, with a count of 0.
    met = rows.filter("CenterID IS NOT NULL OR HubID IS NULL").groupBy("dim", "k", F.col("day").alias("part")).agg(F.lit(0).alias("_"))
    empty = F.bitmap_construct_agg(F.lit(None).cast("bigint"))
    nobody = met.groupBy("dim", "k", "part").agg(empty.alias("bits")).select("dim", "k", "part", F.lit("hubs").alias("entity"), F.lit(1).cast("bigint").alias("bucket"), "bits")
    return centers.unionByName(nobody)


def breakdown_of(parts: DataFrame, limit: int = 15) -> DataFrame:
    """The breakdown over the days whose ``parts`` are given."""
    return _ranked_labels(bitmap_counts(parts, ["dim", "k"]), limit)


def listing(
    tables: Tables, as_of: datetime, filters: Filters = Filters(), page: int = 0, size: int = 25
) -> DataFrame:
    """Distinct center rows with their device counts, one page by center id."""
    rows = scope(tables, filters).select(
        F.col("CenterID").alias("center_id"), F.col("Centername").alias("center"), F.col("Status").alias("status"),
        F.col("Type").alias("type"), F.col("Spoke_Center_Segment").alias("segment"), F.col("HubID").alias("hub_id"),
        F.col("HubName").alias("hub"), F.col("City").alias("city"), F.col("State").alias("state"),
        F.col("PinCode").alias("pin"), F.col("deploymentdate").cast("string").alias("deployed"),
        F.col("deactivationdate").cast("string").alias("deactivated"),
    ).distinct()
    order = [F.col(c).asc_nulls_first() for c in rows.columns]
    shown = page_of(rows, order, page, size)
    return shown.join(dv.per_center(dv.device_index(tables, as_of)), "center_id", "left").withColumn(
        "devices", F.coalesce("register_devices", F.lit(0))
    ).drop("register_devices")


def profile(tables: Tables, as_of: datetime, center_id: int) -> DataFrame:
    born = F.min("deploymentdate")
    kept = {"center": "Centername", "hub_id": "HubID", "hub": "HubName", "city": "City", "state": "State",
            "pin": "PinCode", "country": "hub_country"}
    return tables.centers.filter(F.col("CenterID") == center_id).agg(
        *(F.min(c).alias(name) for name, c in kept.items()),
        born.cast("string").alias("first_deployment"),
        tm.months_between_starts(born, tm.moment(as_of)).alias("age_months"),
    )


# Deployment windows (device to center, over time)


def latest_windows(deployments: DataFrame) -> DataFrame:
    """Latest window per device."""
    order = [F.col("startdatetime").desc_nulls_last()] + [
        F.col(c).asc_nulls_first() for c in ("centerid", "enddatetime", "city", "state")
    ]
    ranked = deployments.withColumn("_rank", F.row_number().over(Window.partitionBy("deviceid").orderBy(*order)))
    return ranked.filter("_rank = 1").drop("_rank")


def window_kpis(tables: Tables) -> DataFrame:
    return latest_windows(tables.deployments).agg(
        F.countDistinct("centerid").alias("centers"),
        F.count("*").alias("devices"),
        F.countDistinct(blank_to_null("state")).alias("states"),
        F.countDistinct(blank_to_null("city")).alias("cities"),
        F.count_if(F.col("enddatetime").isNull()).alias("active_deployments"),
    )


def window_states(tables: Tables, limit: int = 12) -> DataFrame:
    return rank_counts(latest_windows(tables.deployments), "state", "Unknown", limit, name="state", count="devices")


def window_age(tables: Tables, as_of: datetime) -> DataFrame:
    current = latest_windows(tables.deployments.filter("enddatetime IS NULL"))
    band = cl.deployment_band(tm.days_between("startdatetime", tm.moment(as_of)))
    return current.groupBy(band.alias("band")).agg(F.count("*").alias("devices"))


def window_status(tables: Tables, as_of: datetime) -> DataFrame:
    running = F.col("enddatetime").isNull() | (F.col("enddatetime") > tm.moment(as_of))
    status = F.when(running, "Active").otherwise("Ended")
    return tables.deployments.groupBy(status.alias("status")).agg(F.countDistinct("deviceid").alias("devices"))


def window_centers(tables: Tables) -> DataFrame:
    """Attributes of each center from its latest window."""
    names = {"CenterName": "center", "hubid": "hub_id", "hubname": "hub", "city": "city", "state": "state",
             "pin": "pin", "country": "country"}
    order = [F.col("startdatetime").desc_nulls_last()] + [F.col(c).asc_nulls_first() for c in names]
    ranked = tables.deployments.withColumn(
        "_rank", F.row_number().over(Window.partitionBy("centerid").orderBy(*order))
    )
    return ranked.filter("_rank = 1").select(
        F.col("centerid").alias("center_id"), *(F.col(c).alias(n) for c, n in names.items())
    )


def window_profile(tables: Tables, as_of: datetime, center_id: int) -> DataFrame:
    born = F.min("startdatetime")
    kept = {"center": "CenterName", "hub_id": "hubid", "hub": "hubname", "city": "city", "state": "state",
            "pin": "pin", "country": "country"}
    return tables.deployments.filter(F.col("centerid") == center_id).agg(
        *(F.min(c).alias(name) for name, c in kept.items()),
        tm.date_label(born).alias("first_deployment"),
        tm.months_between_starts(born, tm.moment(as_of)).alias("age_months"),
        F.countDistinct("deviceid").alias("devices_ever"),
    )


# Center-360 mart


def center_360(
    tables: Tables, as_of: datetime, heartbeats_as_of: datetime | None = None, single_row: bool = False,
    stats: DataFrame | None = None, devices: DataFrame | None = None,
) -> DataFrame:
    """Every center with telemetry, tickets, uptime and device count.

    Each side is aggregated to one row per center before it joins; tickets are read once, for volumes and
    uptime alike, and the scores are computed on the joined row. Per-center
    ticket statistics and the device index are taken from ``stats`` and ``devices`` where they are at hand.
    """
    seen_at = heartbeats_as_of or as_of
    dimension = center_dimension(tables.centers)
    base = one_row_per_center(dimension) if single_row else dimension
    stats = center_ticket_stats(tables.cleaned(), as_of) if stats is None else stats
    devices = dv.device_index(tables, as_of) if devices is None else devices
    zero, blank = F.lit(0).cast("bigint"), F.lit("")
    joined = (
        base.join(dv.center_telemetry(tables.heartbeats, seen_at), "center_id", "left")
        .join(stats, "center_id", "left")
        .join(up.births(tables), "center_id", "left")
        .join(dv.per_center(devices), "center_id", "left")
    )

    def or_zero(c: str) -> Column:
        return F.coalesce(c, zero).alias(c)

    return up.with_scores(joined, as_of).select(
        "center_id", F.coalesce("center", blank).alias("center"), "hub_id", "hub", "city", "state",
        F.coalesce("pin", blank).alias("pin"), "country", "segment", "status", "billable", "machine_type", "device_id",
        "mac_serial_id", "deployment_date", or_zero("devices"), or_zero("online"), "last_seen", "avg_csq",
        "avg_battery", or_zero("low_battery"), or_zero("open_tickets"), or_zero("tickets_total"), or_zero("swapped"),
        *up.lifecycle_columns(), or_zero("failures"), or_zero("register_devices"),
    )


def center_names(tables: Tables, as_of: datetime) -> DataFrame:
    """Name and device count per center, without the rest of the mart."""
    dimension = center_dimension(tables.centers).select("center_id", F.coalesce("center", F.lit("")).alias("center"))
    return dimension.join(dv.per_center(dv.device_index(tables, as_of)), "center_id", "left")


EXPLORER_SORT_KEYS = (
    "center", "state", "devices", "open_tickets", "swapped", "lifecycle_years", "downtime_days", "uptime_pct",
    "tickets_total", "register_devices", "mtbf_hrs", "failures",
)


def explorer(
    mart: DataFrame, filters: Filters = Filters(), search: str = "", sort_by: str = "devices",
    sort_dir: str = "desc", page: int = 0, size: int = 15, dimension: DataFrame | None = None,
) -> DataFrame:
    """One page of the mart. Open tickets tie-break on the worst uptime, then the id decides.

    The filters rest on center attributes alone, so the total can be counted over the bare center dimension;
    give it where the mart is not yet a table.
    """
    key = sort_by if sort_by in EXPLORER_SORT_KEYS else "devices"
    found = (filters.center_row(), contains_text(("center", "center_id", "hub", "state"), search, min_length=1))
    rows = where(mart, *found)
    counted = None if dimension is None else where(dimension, *found)
    order = [empties_last(key, sort_dir, is_text=key in ("center", "state"))]
    if key == "open_tickets":
        order.append(F.col("uptime_pct").asc_nulls_last())
    order += [F.col("center_id").asc_nulls_last(), F.col("city").asc()]
    return page_of(rows, order, page, size, counted=counted)


def named(rows: DataFrame, mart: DataFrame, order: Sequence[Column] = ()) -> DataFrame:
    """Add the center's name (or 'Center #id') and device count to rows keyed by ``centerid``, sorted by ``order``.

    A join keeps no order, so rows that are to be in one are sorted here.
    """
    known = mart.groupBy(F.col("center_id").alias("centerid")).agg(
        F.min("center").alias("_name"), F.max("register_devices").alias("_devices")
    )
    numbered = F.concat(F.lit("Center #"), F.col("centerid").cast("string"))
    joined = rows.join(known, "centerid", "left").select(
        *rows.columns,
        F.coalesce(F.nullif("_name", F.lit("")), numbered).alias("center"),
        F.coalesce("_devices", F.lit(0)).alias("devices"),
    )
    return joined.orderBy(*order) if order else joined
