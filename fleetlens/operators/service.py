"""Field-service tickets and escalations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens import config
from fleetlens.filters import Filters, where
from fleetlens.functions import classify as cl
from fleetlens.functions import time as tm
from fleetlens.functions.text import contains_text, is_any
from fleetlens.operators.explore import page_of, rank_counts, sort_order
from fleetlens.sources.tables import Tables


def service_scope(tables: Tables, filters: Filters = Filters()) -> DataFrame:
    return where(tables.service, filters.service())


def service_kpis(tables: Tables, filters: Filters = Filters()) -> DataFrame:
    """Open and closed tickets, median turnaround, invalid turnarounds, remote share, recent visits.

    The 30-day window hangs on the newest ticket, not on today. The exact median is taken over distinct
    turnarounds and their counts, which stay few however many tickets there are.
    """
    rows = service_scope(tables, filters)
    newest = rows.agg(F.max("created_on").cast("date")).scalar()
    recent = F.col("created_on").cast("date") >= F.date_sub(newest, 30)
    by_tat = (
        rows.withColumn("_recent", recent)
        .groupBy("tat_days_")
        .agg(
            F.count("*").alias("n"),
            F.count_if(F.col("status") == "Open").alias("open_tickets"),
            F.count_if(F.col("status") == "Closed").alias("closed_tickets"),
            F.count_if(F.col("closure_type") == "OVERCALL_RESOLUTION").alias("remote"),
            F.count("closure_type").alias("typed"),
            F.count_if((F.col("closure_type") == "CENTER_VISIT") & F.col("_recent")).alias("visits"),
        )
        .withColumn("tat", F.when(cl.tat_is_valid("tat_days_"), F.col("tat_days_")))
    )
    return by_tat.agg(
        F.coalesce(F.sum("open_tickets"), F.lit(0)).alias("open_tickets"),
        F.coalesce(F.sum("closed_tickets"), F.lit(0)).alias("closed_tickets"),
        F.round(F.expr("percentile(tat, 0.5, n)"), 1).alias("median_tat_days"),
        F.coalesce(F.sum(F.when(F.col("tat_days_") < 0, F.col("n"))), F.lit(0)).alias("invalid_tat"),
        F.round(F.try_divide(F.sum("remote"), F.sum("typed")) * 100, 1).alias("remote_pct"),
        F.coalesce(F.sum("visits"), F.lit(0)).alias("visits_30d"),
    )


def service_flow(tables: Tables, filters: Filters = Filters()) -> DataFrame:
    """Created and closed per month; a month may have only one of the two."""
    rows = service_scope(tables, filters)
    created = rows.groupBy(tm.month_label("created_on").alias("month")).agg(F.count("*").alias("created"))
    closed = (
        rows.filter("closed_date IS NOT NULL")
        .groupBy(tm.month_label("closed_date").alias("month"))
        .agg(F.count("*").alias("closed"))
    )
    return (
        created.join(closed, "month", "full_outer")
        .select("month", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("created", "closed")))
        .orderBy("month")
    )


def service_tat_bands(tables: Tables, filters: Filters = Filters()) -> DataFrame:
    valid = service_scope(tables, filters).filter(cl.tat_is_valid("tat_days_"))
    return valid.groupBy(cl.wait_band("tat_days_").alias("band")).agg(F.count("*").alias("cnt"))


# Chart -> (column, label of blanks, rows shown).
SERVICE_CHARTS = {
    "resolution": ("closure_type", "Unknown", None),
    "service_types": ("service_type", "Unknown", 12),
    "models": ("category", "Unknown", 16),
    "representatives": ("representative", "Unassigned", 12),
}


def service_counts(tables: Tables, chart: str, filters: Filters = Filters()) -> DataFrame:
    rows = service_scope(tables, filters)
    if chart == "representatives":
        rows = rows.filter(F.col("status") == "Closed")
    return rank_counts(rows, *SERVICE_CHARTS[chart])


SERVICE_SORT_KEYS = {
    "created_on": "_created", "status": "status", "ticket_territory": "territory", "product": "product",
    "service_type": "service_type", "representative": "representative", "tat_days_": "tat_days_",
    "closure_type": "closure_type",
}


def _text(name: str, alias: str | None = None):
    return F.coalesce(name, F.lit("")).alias(alias or name)


def service_explorer(
    tables: Tables, filters: Filters = Filters(), search: str = "", sort_by: str = "created_on",
    sort_dir: str = "desc", page: int = 0, size: int = 50,
) -> DataFrame:
    found = where(
        service_scope(tables, filters), contains_text(("ticket_id", "contact_person_name", "representative"), search)
    )
    rows = found.select(
        "ticket_id", tm.date_label("created_on").alias("created"), tm.date_label("closed_date").alias("closed"), "status",
        _text("contact_person_name", "contact"), _text("ticket_territory", "territory"), _text("product"),
        _text("service_type"), _text("representative"), "tat_days_", _text("closure_type"),
        F.col("created_on").alias("_created"),
    )
    order = sort_order(SERVICE_SORT_KEYS, sort_by, sort_dir, "created_on", [F.col("ticket_id").asc_nulls_first()])
    return page_of(rows, order, page, size).drop("_created")


def escalation_scope(tables: Tables, filters: Filters = Filters()) -> DataFrame:
    return where(tables.escalations, filters.escalation())


def escalation_kpis(tables: Tables, filters: Filters = Filters()) -> DataFrame:
    resolved = is_any("remarks", config.RESOLVED_OUTCOMES)
    return escalation_scope(tables, filters).agg(
        F.count("*").alias("issues"),
        F.count_if(resolved).alias("resolved"),
        F.count_if(is_any("remarks", config.UNRESOLVED_OUTCOMES)).alias("unresolved"),
        F.round(F.try_divide(F.count_if(resolved), F.count("*")) * 100, 1).alias("resolved_pct"),
        F.round(F.avg(F.when(F.col("tat_days_") >= 0, F.col("tat_days_"))), 1).alias("avg_tat_days"),
    )


def escalation_volume(tables: Tables, filters: Filters = Filters()) -> DataFrame:
    received = escalation_scope(tables, filters).filter("received_date IS NOT NULL")
    return received.groupBy(tm.month_label("received_date").alias("ym")).agg(F.count("*").alias("cnt")).orderBy("ym")


ESCALATION_CHARTS = {
    "issue_types": ("issue_type", "Unknown", 12),
    "device_types": ("machine_devicetype", "Unknown", 12),
    "outcomes": ("remarks", "Unknown", None),
    "owners": ("cs_team_name_service_team", "Unassigned", 14),
    "reasons": ("reason", "Unknown", 12),
}


def escalation_counts(tables: Tables, chart: str, filters: Filters = Filters()) -> DataFrame:
    return rank_counts(escalation_scope(tables, filters), *ESCALATION_CHARTS[chart])


ESCALATION_SORT_KEYS = {
    "received_date": "_received", "closed_date": "_closed", "center_name": "center_name", "location": "location",
    "machine_devicetype": "device_type", "issue_type": "issue_type", "cs_team_name_service_team": "owner",
    "tat_days_": "tat_days_", "remarks": "outcome",
}


def escalation_explorer(
    tables: Tables, filters: Filters = Filters(), search: str = "", sort_by: str = "received_date",
    sort_dir: str = "desc", page: int = 0, size: int = 15,
) -> DataFrame:
    found = where(escalation_scope(tables, filters), contains_text(("center_name", "zoho_id", "issue"), search))
    rows = found.select(
        tm.date_label("received_date").alias("received"), tm.date_label("closed_date").alias("closed"),
        _text("zoho_id"), _text("center_id"), _text("center_name"), _text("location"),
        _text("machine_devicetype", "device_type"), _text("issue_type"), _text("reason"),
        _text("cs_team_name_service_team", "owner"), "tat_days_", _text("remarks", "outcome"),
        F.col("received_date").alias("_received"), F.col("closed_date").alias("_closed"),
    )
    ties = [F.col(c).asc_nulls_first() for c in rows.columns if not c.startswith("_")]
    order = sort_order(ESCALATION_SORT_KEYS, sort_by, sort_dir, "received_date", ties)
    return page_of(rows, order, page, size).drop("_received", "_closed")
