"""Support tickets: volume, service levels, worklist, per-center summaries."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens import config
from fleetlens.filters import Filters, by_center, where
from fleetlens.functions import classify as cl
from fleetlens.functions import time as tm
from fleetlens.functions.text import blank_to_null, contains_text, label
from fleetlens.operators.explore import page_of, rank_counts, sort_order
from fleetlens.sources.cleaned import TICKET_MONTH, cleaned_tickets
from fleetlens.sources.reference_data import account_hubs, sla_catalog
from fleetlens.sources.tables import Tables


def scope(tables: Tables, filters: Filters = Filters(), *extra: str) -> DataFrame:
    """Cleaned tickets under the filters. Filters apply after the copies are collapsed."""
    extras = (*extra, "HubName") if filters.hub else extra
    df = tables.cleaned(*extras, within=filters.months(TICKET_MONTH))
    return by_center(where(df, filters.one_hub(), filters.dates("CreatedAt")), tables, filters)


def with_sla(tickets: DataFrame) -> DataFrame:
    """Add sla_days, is_tech and sla_matched from the catalog; unlisted categories use the defaults."""
    catalog = F.broadcast(sla_catalog(tickets.sparkSession))
    key = cl.category_key("IssueCategory")
    return (
        tickets.withColumn("category_key", key)
        .join(catalog, "category_key", "left")
        .withColumn("sla_days", F.coalesce("catalog_days", F.lit(config.SLA_DEFAULT_DAYS)))
        .withColumn("is_tech", F.coalesce("catalog_tech", cl.names_technical("category_key")))
        .withColumn("sla_matched", F.col("catalog_days").isNotNull())
        .drop("category_key", "catalog_days", "catalog_tech")
    )


def measured(tickets: DataFrame, as_of: datetime) -> DataFrame:
    """Add the service-level measures of a ticket: resolved, res_days, is_open, age_days, breached, at_risk."""
    resolved = (F.col("status") == "Closed") & F.col("CreatedAt").isNotNull() & F.col("ClosedAt").isNotNull()
    late_from = config.AT_RISK_SHARE * F.col("sla_days")
    return (
        with_sla(tickets)
        .withColumn("resolved", resolved)
        .withColumn("res_days", F.when(F.col("resolved"), tm.hours_between("CreatedAt", "ClosedAt") / 24))
        .withColumn("is_open", cl.is_open("status"))
        .withColumn("age_days", tm.hours_between("CreatedAt", tm.moment(as_of)) / 24)
        .withColumn("breached", F.col("is_open") & (F.col("age_days") > F.col("sla_days")))
        .withColumn(
            "at_risk",
            F.col("is_open") & (F.col("age_days") <= F.col("sla_days")) & (F.col("age_days") > late_from),
        )
    )


def _percent(part: Column, whole: Column) -> Column:
    return F.round(F.try_divide(F.count_if(part), F.count_if(whole)) * 100, 1)


def _category() -> Column:
    return label("IssueCategory", "Uncategorised")


def kpis(tables: Tables, as_of: datetime, filters: Filters = Filters()) -> DataFrame:
    now = tm.moment(as_of)
    week, fortnight = tm.before(now, 7, "DAYS"), tm.before(now, 14, "DAYS")
    created, closed, opened = F.col("CreatedAt"), F.col("ClosedAt"), cl.is_open("status")
    return scope(tables, filters).agg(
        F.count("*").alias("total_tickets"),
        F.count_if(opened).alias("open_tickets"),
        F.count_if(created >= week).alias("created_7d"),
        F.count_if(closed >= week).alias("closed_7d"),
        F.count_if((created >= fortnight) & (created < week)).alias("created_7d_prev"),
        F.count_if((closed >= fortnight) & (closed < week)).alias("closed_7d_prev"),
        F.round(F.avg(F.when(opened, tm.hours_between(created, now) / 24)), 1).alias("avg_open_age_days"),
    )


def sla_kpis(tables: Tables, as_of: datetime, filters: Filters = Filters()) -> DataFrame:
    df = measured(scope(tables, filters), as_of)
    resolved, tech = F.col("resolved"), F.col("is_tech")
    within = resolved & (F.col("res_days") <= F.col("sla_days"))
    return df.agg(
        F.count_if(resolved).alias("resolved_n"),
        _percent(within, resolved).alias("within_pct"),
        _percent(tech & within, tech & resolved).alias("within_tech"),
        _percent(~tech & within, ~tech & resolved).alias("within_nontech"),
        F.count_if("breached").alias("breached_open"),
        F.count_if("at_risk").alias("atrisk_open"),
        F.round(F.avg("res_days"), 1).alias("avg_res_days"),
    )


def sla_by_category(
    tables: Tables, as_of: datetime, filters: Filters = Filters(), least: int = 20, limit: int = 15
) -> DataFrame:
    resolved = F.col("resolved")
    return (
        measured(scope(tables, filters), as_of)
        .groupBy(_category().alias("category"))
        .agg(
            F.min("sla_days").alias("sla_days"),
            F.min("is_tech").alias("is_tech"),
            F.count("*").alias("tickets"),
            F.count_if(resolved).alias("resolved_n"),
            _percent(resolved & (F.col("res_days") > F.col("sla_days")), resolved).alias("breach_pct"),
            F.round(F.avg("res_days"), 1).alias("avg_res_days"),
        )
        .filter(F.col("resolved_n") >= least)
        .orderBy(F.desc("breach_pct"), F.desc("tickets"), "category")
        .limit(limit)
    )


OPEN_TICKET_EXTRAS = ("HubName", "priority", "assignee", "TicketLink")


def open_tickets(tables: Tables) -> DataFrame:
    """Open tickets of a known creation time, with the hours from which each is at risk and breached.

    ``at_risk_at`` and ``breach_at`` are hour numbers that no moment enters, so one table answers for every moment by a
    range condition. It is ordered by them: written as Parquet, files and row groups of tickets not yet at risk are skipped.
    """
    target = 24 * F.col("sla_days").cast("bigint")
    hour = tm.hour_number("CreatedAt")
    return (
        with_sla(tables.cleaned(*OPEN_TICKET_EXTRAS).filter(cl.is_open("status") & F.col("CreatedAt").isNotNull()))
        .withColumn("at_risk_at", hour + F.floor(config.AT_RISK_SHARE * target) + 1)
        .withColumn("breach_at", hour + target + 1)
        .repartitionByRange("at_risk_at", "ticketNumber")
        .sortWithinPartitions("at_risk_at", "breach_at")
    )


def critical(tables: Tables, as_of: datetime, filters: Filters = Filters(), risk: str = "") -> DataFrame:
    """Open tickets that are breached or at risk at ``as_of``, or of one of these bands alone, with ``breached``."""
    now = tm.hour_of(as_of)
    mart = tables.mart("open_tickets")
    rows = where(
        open_tickets(tables) if mart is None else mart,
        F.col("at_risk_at") <= now,
        {"breached": F.col("breach_at") <= now, "atrisk": F.col("breach_at") > now}.get(risk.lower()),
        filters.one_hub(), filters.dates("CreatedAt"),
    )
    return by_center(rows, tables, filters).withColumn("breached", F.col("breach_at") <= now)


def open_risk_by_category(tables: Tables, as_of: datetime, filters: Filters = Filters(), limit: int = 12) -> DataFrame:
    return (
        critical(tables, as_of, filters)
        .groupBy(_category().alias("category"))
        .agg(F.count_if("breached").alias("breached"), F.count_if(~F.col("breached")).alias("atrisk"))
        .orderBy((F.col("breached") + F.col("atrisk")).desc(), "category")
        .limit(limit)
    )


WORKLIST_SORT_KEYS = {
    k: k
    for k in (
        "days_over", "age_days", "sla_days", "created", "category", "status", "priority", "assignee", "center_id", "risk",
    )
}


def worklist_rows(tables: Tables, as_of: datetime, filters: Filters = Filters(), risk: str = "") -> DataFrame:
    """Open tickets past, or close to, their target."""
    age = (F.lit(tm.hour_of(as_of)) - tm.hour_number("CreatedAt")) / 24
    return critical(tables, as_of, filters, risk).select(
        F.col("ticketNumber").alias("ticket"),
        F.col("CenterID").alias("center_id"),
        _category().alias("category"),
        "status",
        label("priority", "—").alias("priority"),
        label("assignee", "—").alias("assignee"),
        F.coalesce("TicketLink", F.lit("")).alias("link"),
        "sla_days",
        tm.date_label("CreatedAt").alias("created"),
        F.round(age, 1).alias("age_days"),
        F.round(age - F.col("sla_days"), 1).alias("days_over"),
        F.when(F.col("breached"), "BREACHED").otherwise("AT_RISK").alias("risk"),
    )


def worklist(
    tables: Tables, as_of: datetime, filters: Filters = Filters(), search: str = "", risk: str = "",
    sort_by: str = "days_over", sort_dir: str = "desc", page: int = 0, size: int = 15,
) -> DataFrame:
    rows = where(
        worklist_rows(tables, as_of, filters, risk), contains_text(("ticket", "category", "assignee", "center_id"), search)
    )
    ties = [F.col("ticket").desc_nulls_last(), F.col("center_id"), F.col("created"), F.col("days_over"), F.col("category")]
    return page_of(rows, sort_order(WORKLIST_SORT_KEYS, sort_by, sort_dir, "days_over", ties), page, size)


def trend(tables: Tables, as_of: datetime, filters: Filters = Filters()) -> DataFrame:
    """Created and closed tickets per month over the last twelve months, from one pass."""
    since = tm.before(tm.moment(as_of), 12, "MONTHS")

    def happened(c: str, created: int) -> Column:
        month = F.when(F.col(c) >= since, tm.month_label(c))
        return F.struct(month.alias("month"), F.lit(created).alias("created"), F.lit(1 - created).alias("closed"))

    moves = F.explode(F.array(happened("CreatedAt", 1), happened("ClosedAt", 0)))
    return (
        scope(tables, filters)
        .select(moves.alias("m"))
        .filter(F.col("m.month").isNotNull())
        .groupBy("m.month")
        .agg(F.sum("m.created").alias("created"), F.sum("m.closed").alias("closed"))
        .orderBy("month")
    )


def open_by_status(tables: Tables, filters: Filters = Filters(), limit: int = 10) -> DataFrame:
    return (
        scope(tables, filters)
        .filter(cl.is_open("status"))
        .groupBy("status")
        .agg(F.count("*").alias("cnt"))
        .orderBy(F.desc("cnt"), "status")
        .limit(limit)
    )


def _recent(df: DataFrame, as_of: datetime, days: int = 90) -> DataFrame:
    return df.filter(F.col("CreatedAt") >= tm.before(tm.moment(as_of), days, "DAYS"))


def recent_categories(tables: Tables, as_of: datetime, filters: Filters = Filters(), limit: int = 10) -> DataFrame:
    return rank_counts(_recent(scope(tables, filters), as_of), "IssueCategory", "Uncategorised", limit, name="category")


def recent_segments(tables: Tables, as_of: datetime, filters: Filters = Filters(), limit: int = 8) -> DataFrame:
    df = _recent(scope(tables, filters, "hub_master_segment"), as_of)
    return rank_counts(df, cl.segment_group("hub_master_segment", "Unknown"), "Unknown", limit, name="segment")


def open_age_bands(tables: Tables, as_of: datetime, filters: Filters = Filters()) -> DataFrame:
    return (
        scope(tables, filters)
        .filter(cl.is_open("status") & F.col("CreatedAt").isNotNull())
        .groupBy(cl.wait_band(tm.hours_between("CreatedAt", tm.moment(as_of)) / 24).alias("band"))
        .agg(F.count("*").alias("cnt"))
    )


def totals(tables: Tables, filters: Filters = Filters()) -> DataFrame:
    tech = F.col("is_tech")
    return with_sla(scope(tables, filters)).agg(
        F.count("*").alias("total"), F.count_if(tech).alias("tech"), F.count_if(~tech).alias("nontech")
    )


def by_status(tables: Tables, filters: Filters = Filters(), limit: int = 15) -> DataFrame:
    return rank_counts(scope(tables, filters), "status", "(blank)", limit, name="k", count="n")


def center_ticket_stats(tickets: DataFrame, as_of: datetime) -> DataFrame:
    """Per center, from one pass over cleaned tickets: volumes, failures and merged downtime.

    Downtime is the length, in hour boundaries, of the union of a center's failure intervals. Only hour
    numbers matter for it, so tickets are first reduced to one row per center and starting hour, with the
    latest end, before any shuffle. A center's rows after that are bounded by the hours it has existed,
    however many tickets it has. Then each row adds what lies beyond the latest earlier end.
    """
    now = tm.moment(as_of)
    failure = F.col("is_tech") & F.col("CreatedAt").isNotNull()
    hourly = (
        with_sla(tickets.filter(F.col("CenterID").isNotNull()))
        .groupBy(F.col("CenterID").alias("center_id"), F.when(failure, tm.hour_number("CreatedAt")).alias("_start"))
        .agg(
            F.max(F.when(failure, tm.hour_number(F.coalesce("ClosedAt", now)))).alias("_end"),
            F.count("*").alias("_n"),
            F.count_if(cl.is_open("status")).alias("_open"),
            F.count_if(_names_swap()).alias("_swap"),
            F.count_if(failure).alias("_failures"),
        )
    )
    before = Window.partitionBy("center_id").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    earlier = F.max("_end").over(before)
    gain = F.greatest(F.lit(0).cast("bigint"), F.col("_end") - F.greatest("_start", "_earlier"))
    return (
        hourly.withColumn("_earlier", earlier)
        .groupBy("center_id")
        .agg(
            F.sum("_n").alias("tickets_total"),
            F.sum("_open").alias("open_tickets"),
            F.sum("_swap").alias("swapped"),
            F.sum("_failures").alias("failures"),
            F.coalesce(F.sum(F.when(F.col("_start").isNotNull(), gain)), F.lit(0)).alias("downtime_hrs"),
        )
    )


def _names_swap() -> Column:
    return F.lower(F.coalesce("IssueCategory", F.lit(""))).contains("swap")


def per_center(tables: Tables) -> DataFrame:
    """Ticket volumes per center, where downtime is not asked for."""
    return (
        tables.cleaned("hub_master_segment")
        .filter(F.col("CenterID").isNotNull())
        .groupBy(F.col("CenterID").alias("center_id"))
        .agg(
            F.count("*").alias("tickets_total"),
            F.count_if(cl.is_open("status")).alias("open_tickets"),
            F.count_if(_names_swap()).alias("swapped"),
            F.min(cl.segment_group("hub_master_segment", None)).alias("segment"),
        )
    )


def failure_tickets(tickets: DataFrame) -> DataFrame:
    """Technical tickets of a known center and creation time."""
    dated = tickets.filter(F.col("CenterID").isNotNull() & F.col("CreatedAt").isNotNull())
    return with_sla(dated).filter("is_tech")


def failures_by_center(tables: Tables) -> DataFrame:
    """First failure, number of failures and most frequent category per center."""
    by_category = (
        failure_tickets(tables.cleaned())
        .groupBy(F.col("CenterID").alias("cid"), "IssueCategory")
        .agg(F.min("CreatedAt").alias("first"), F.count("*").alias("n"))
    )
    leading = F.min(F.struct((-F.col("n")).alias("rank"), "IssueCategory"))
    return by_category.groupBy("cid").agg(
        F.min("first").alias("first_fail"), F.sum("n").alias("n_fail"), leading["IssueCategory"].alias("top_cat")
    )


def center_totals(tables: Tables, center_id: int) -> DataFrame:
    """Drill-down headline of one center."""
    df = tables.cleaned("hub_master_segment").filter(F.col("CenterID") == center_id)
    return df.agg(
        F.count("*").alias("total_tickets"),
        F.count_if(cl.is_open("status")).alias("open_tickets"),
        F.min(cl.segment_group("hub_master_segment", None)).alias("segment"),
    )


def center_tickets(tables: Tables, center_id: int, only_open: bool = False, limit: int | None = None) -> DataFrame:
    """Newest tickets of one center: ``limit`` of them, by default 25 open ones, or 50 of any status."""
    df = tables.cleaned("priority", "subject", "TicketLink").filter(F.col("CenterID") == center_id)
    if only_open:
        df = df.filter(cl.is_open("status"))
    return (
        df.orderBy(F.col("CreatedAt").desc_nulls_last(), F.col("ticketNumber").asc_nulls_first())
        .limit((25 if only_open else 50) if limit is None else limit)
        .select(
            F.col("ticketNumber").alias("ticket"),
            "status",
            label("priority", "—").alias("priority"),
            label("subject", "(no subject)").alias("subject"),
            label("IssueCategory", "").alias("category"),
            F.coalesce("TicketLink", F.lit("")).alias("link"),
            tm.stamp_label("CreatedAt").alias("created"),
        )
    )


def account_ticket_stats(tables: Tables, as_of: datetime, filters: Filters = Filters()) -> DataFrame:
    """Tickets, open breaches and compliance of the curated accounts' hubs. The date range does not apply."""
    hubs = F.broadcast(account_hubs(tables.spark).select(F.col("hub_id").alias("HubID")).distinct())
    df = tables.cleaned("HubID").join(hubs, "HubID", "left_semi")
    df = measured(by_center(df, tables, filters), as_of)
    within = F.col("resolved") & (F.col("res_days") <= F.col("sla_days"))
    return df.agg(
        F.count("*").alias("total_tickets"),
        F.count_if("breached").alias("sla_breach"),
        _percent(within, F.col("resolved")).alias("sla_within_pct"),
    )


def look_up(tables: Tables, ident: int | Column) -> DataFrame:
    """Resolve a number: as a center if there is one, else as a ticket of a known center."""
    as_center = tables.centers.filter(F.col("CenterID") == ident).select(
        F.lit(0).alias("rank"), F.lit("center").alias("kind"), F.col("CenterID").alias("center_id"),
        F.lit(None).cast("bigint").alias("ticket"),
    )
    as_ticket = cleaned_tickets(tables.tickets.filter(F.col("ticketNumber") == ident)).filter("CenterID IS NOT NULL").select(
        F.lit(1).alias("rank"), F.lit("ticket").alias("kind"), F.col("CenterID").alias("center_id"),
        F.col("ticketNumber").alias("ticket"),
    )
    return as_center.limit(1).unionByName(as_ticket).orderBy("rank", "center_id").limit(1).drop("rank")
