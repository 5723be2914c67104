"""Profiling and reconciliation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.filters import Filters
from fleetlens.functions import time as tm
from fleetlens.operators import profile as pf
from fleetlens.operators import sketches
from fleetlens.plans import pages
from fleetlens.plans.marts import center_mart, located_mart, with_ticket_marts
from fleetlens.plans.query_tickets import WORKLIST_SQL
from fleetlens.plans.registry import QUERIES, query
from fleetlens.sources.proxy import EVENTS_AS_OF, TICKETS_AS_OF
from fleetlens.sources.tables import Tables

_SERVICE_TEXT = (
    "ticket_id", "status", "closure_type", "service_type", "category", "representative", "product", "ticket_territory",
    "contact_person_name", "customer_category", "state", "city", "customer_id", "serial_number", "zoho_ticket", "ticket_type",
)
_SERVICE_ORDERED = ("created_on", "closed_date", "tat_days_")


def _column(c: str, ordered: bool) -> str:
    bounds = f"CAST(MIN({c}) AS VARCHAR), CAST(MAX({c}) AS VARCHAR)" if ordered else "NULL, NULL"
    return f"""SELECT '{c}' AS column_name, CASE typeof(ANY_VALUE({c})) WHEN 'VARCHAR' THEN 'string' WHEN 'INTEGER' THEN 'int' ELSE
    REPLACE(LOWER(typeof(ANY_VALUE({c}))), 'timestamp', 'timestamp_ntz') END AS type, COUNT(*) AS row_count, ROUND(COUNT(*) FILTER (WHERE {c} IS NULL) / COUNT(*) * 100, 1) AS null_pct,
  {bounds} FROM field_service"""


@query("P1_column_profile", "SELECT * FROM (" + " UNION ALL ".join(
    [_column(c, False) for c in _SERVICE_TEXT] + [_column(c, True) for c in _SERVICE_ORDERED]
) + ") p(column_name, type, row_count, null_pct, min_value, max_value)")
def _(t: Tables) -> DataFrame:
    return pf.column_profile(t.service, distinct=False)


@query("P1_column_profile_distinct", "SELECT *, TRUE AS distinct_near FROM (" + " UNION ALL ".join(
    [_column(c, False) for c in _SERVICE_TEXT] + [_column(c, True) for c in _SERVICE_ORDERED]
) + ") p(column_name, type, row_count, null_pct, min_value, max_value)")
def _(t: Tables) -> DataFrame:
    """The profile, and whether the distinct values that merged sketches of all months estimate are within 5 % of the exact ones."""
    profile = pf.column_profile(t.service, distinct=False)
    names = [f.name for f in t.service.schema.fields]
    estimates = sketches.distinct_estimates(sketches.distinct_parts(t.service, names, tm.month_number("created_on")))
    exact = t.service.agg(F.array(*(F.struct(F.lit(c).alias("column_name"), F.countDistinct(F.col(c).cast("string")).alias("exact")) for c in names)).alias("s"))
    near = F.abs(F.col("distinct_values") - F.col("exact")) <= 0.05 * F.col("exact")
    return profile.join(estimates, "column_name").join(exact.select(F.inline("s")), "column_name").select(*profile.columns, near.alias("distinct_near"))


@query("P2_top_values", "SELECT column_name, value, n FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY column_name ORDER BY n DESC, value NULLS FIRST) AS rn FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, {c} AS value, COUNT(*) AS n FROM field_service GROUP BY 2 HAVING "
    f"(SELECT COUNT(DISTINCT {c}) FROM field_service) BETWEEN 1 AND 25" for c in _SERVICE_TEXT
) + ")) WHERE rn <= 25")
def _(t: Tables) -> DataFrame:
    return pf.top_values(t.service)


def _resolution(table: str, key: str, known: str, known_key: str) -> str:
    hit = f"{key} IN (SELECT CAST({known_key} AS VARCHAR) FROM {known} WHERE {known_key} IS NOT NULL)"
    return f"""
SELECT COUNT(*) AS row_count, COUNT({key}) AS has_key, COUNT(*) FILTER (WHERE regexp_full_match({key}, '[0-9]+')) AS numeric_looking,
  COUNT(*) FILTER (WHERE {hit}) AS resolves, COUNT(DISTINCT CASE WHEN {hit} THEN {key} END) AS distinct_hits FROM {table}"""


@query("P3_service_customer_keys", _resolution("field_service", "customer_id", "center_details", "CenterID"))
def _(t: Tables) -> DataFrame:
    return pf.key_resolution(t.service, "customer_id", t.centers, "CenterID")


@query("P3_service_serials", _resolution("field_service", "serial_number", "heartbeats", "DeviceID"))
def _(t: Tables) -> DataFrame:
    return pf.key_resolution(t.service, "serial_number", t.heartbeats, "DeviceID")


@query("P3_service_center_serials", _resolution("field_service", "serial_number", "center_details", "DeviceID"))
def _(t: Tables) -> DataFrame:
    return pf.key_resolution(t.service, "serial_number", t.centers, "DeviceID")


@query("P3_escalation_center_keys", _resolution("escalations", "center_id", "center_details", "CenterID"))
def _(t: Tables) -> DataFrame:
    return pf.key_resolution(t.escalations, "center_id", t.centers, "CenterID")


def _digits(table: str, key: str) -> str:
    return f"""
SELECT COUNT(*) AS row_count, COUNT({key}) AS has_reference, COUNT(*) FILTER (WHERE regexp_replace(COALESCE({key}, ''), '[^0-9]', '', 'g')
  IN (SELECT CAST(ticketNumber AS VARCHAR) FROM o_cleaned WHERE ticketNumber IS NOT NULL)) AS resolves FROM {table}"""


@query("P4_service_ticket_references", _digits("field_service", "zoho_ticket"))
def _(t: Tables) -> DataFrame:
    return pf.digits_resolution(t.service, "zoho_ticket", t)


@query("P4_escalation_ticket_references", _digits("escalations", "zoho_id"))
def _(t: Tables) -> DataFrame:
    return pf.digits_resolution(t.escalations, "zoho_id", t)


def _sanity(table: str, opened: str) -> str:
    return f"""
SELECT COUNT(*) AS n, COUNT(*) FILTER (WHERE strftime({opened}, '%H:%M:%S') <> '00:00:00') AS opened_has_time,
  COUNT(*) FILTER (WHERE strftime(closed_date, '%H:%M:%S') <> '00:00:00') AS closed_has_time,
  COUNT(*) FILTER (WHERE closed_date < {opened}) AS closed_before_opened, COUNT(*) FILTER (WHERE tat_days_ < 0) AS negative_tat,
  ROUND(AVG(tat_days_), 2) AS avg_tat_days, ROUND(quantile_cont(tat_days_, 0.5), 2) AS median_tat_days FROM {table}"""


@query("P5_service_time_sanity", _sanity("field_service", "created_on"))
def _(t: Tables) -> DataFrame:
    return pf.time_sanity(t.service, "created_on")


@query("P5_escalation_time_sanity", _sanity("escalations", "received_date"))
def _(t: Tables) -> DataFrame:
    return pf.time_sanity(t.escalations, "received_date")


@query("P6_yearly_service", """
SELECT YEAR(created_on) AS yr, COUNT(*) AS all_tickets, COUNT(*) FILTER (WHERE ticket_type = 'BREAKDOWN') AS breakdown,
  COUNT(*) FILTER (WHERE ticket_type = 'BREAKDOWN' AND customer_id IN (SELECT CAST(CenterID AS VARCHAR) FROM center_details))
    AS breakdown_with_center
FROM field_service GROUP BY 1""")
def _(t: Tables) -> DataFrame:
    return pf.yearly_service(t)


@query("P6_yearly_support", """
SELECT YEAR(CreatedAt) AS yr, COUNT(*) AS tickets, COUNT(*) FILTER (WHERE is_tech) AS tech_failure_tickets,
  COUNT(DISTINCT CenterID) AS centers FROM o_measured WHERE CreatedAt IS NOT NULL GROUP BY 1""")
def _(t: Tables) -> DataFrame:
    return pf.yearly_support(t)


@query("P7_worklist_check", f"""
WITH w AS ({WORKLIST_SQL}), l AS (SELECT COUNT(*) AS worklist, COUNT(*) FILTER (WHERE risk = 'BREACHED') AS worklist_breached,
  COUNT(*) FILTER (WHERE risk = 'AT_RISK') AS worklist_atrisk FROM w),
k AS (SELECT COUNT(*) FILTER (WHERE is_open AND age_days > sla_days) AS breached_open,
  COUNT(*) FILTER (WHERE is_open AND age_days <= sla_days AND age_days > 0.75 * sla_days) AS atrisk_open FROM o_measured)
SELECT *, worklist = breached_open + atrisk_open AS totals_match, worklist = worklist_breached + worklist_atrisk AS bands_match
FROM l CROSS JOIN k""")
def _(t: Tables) -> DataFrame:
    return pf.worklist_check(t, TICKETS_AS_OF)


@query("P8_source_health", """
SELECT 'center_details' AS source, COUNT(*) AS row_count FROM center_details UNION ALL SELECT 'heartbeats', COUNT(*) FROM heartbeats
UNION ALL SELECT 'support_tickets', COUNT(*) FROM support_tickets UNION ALL SELECT 'device_register', COUNT(*) FROM device_register""")
def _(t: Tables) -> DataFrame:
    return pf.source_health(t)


# Section of the dashboard -> the query whose check says how many rows it has.
_SECTIONS = {
    "reliability": "U7_reliability", "uptime_fleet": "U8_fleet_uptime", "asset_health": "U9_health_watchlist", "center_kpis": "N1_center_kpis",
    "geo": "N2_centers_by_state", "geo_customers": "N3_centers_by_state_or_city", "deployment_age": "N4_deployment_age", "segments": "N5_centers_by_segment",
    "ticket_kpis": "T2_ticket_kpis", "sla_kpis": "T3_sla_kpis", "sla_by_type": "T4_breach_by_category", "sla_risk": "T5_open_risk_by_category",
    "ticket_trend": "T7_monthly_trend", "open_by_status": "T8_open_by_status", "ticket_categories": "T9_recent_categories", "open_age": "T10_open_age_bands",
    "ticket_segments": "T11_recent_segments", "segment_options": "N7_segment_options", "state_options": "N7_state_options", "city_options": "N7_city_options",
    "country_options": "N7_country_options", "machine_type_options": "N7_machine_type_options", "device_type_options": "N7_device_type_options",
    "device_status_options": "N7_device_status_options", "assets": "D4_status_and_type_counts", "cohort_reliability": "D5_batch_cohorts", "fleet": "D3_fleet_stats",
    "fleet_status": "D3_fleet_status", "fleet_age_bands": "D3_fleet_age_bands", "center_360": "N11_center_360", "map_points": "G4_map_points",
}


def _counted(section: str, sql: str) -> str:
    return f"SELECT '{section}' AS section, (SELECT COUNT(*) FROM ({sql})) AS row_count, TRUE AS ok"


def section_health_sql() -> str:
    known = [_counted(section, QUERIES[name].sql) for section, name in _SECTIONS.items()]
    return " UNION ALL ".join([*known, _counted("unlocated_centers", "SELECT * FROM o_placed WHERE lat IS NULL")])


def section_health(t: Tables) -> DataFrame:
    marts = with_ticket_marts(t)
    return pages.health(marts, TICKETS_AS_OF, Filters(), center_mart(marts, TICKETS_AS_OF, EVENTS_AS_OF), located_mart(marts, TICKETS_AS_OF, EVENTS_AS_OF))
