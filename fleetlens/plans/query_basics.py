"""Queries over the building blocks: sources, filters, classification, joins, explorer helpers."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.filters import Filters, by_center, date_range, in_list, not_in_list, where
from fleetlens.functions import classify as cl
from fleetlens.functions import time as tm
from fleetlens.functions.text import contains_text, model_of, serial_of, label
from fleetlens.operators import centers as ct
from fleetlens.operators import devices as dv
from fleetlens.operators import explore as ex
from fleetlens.operators import geo, joins
from fleetlens.operators import service as sv
from fleetlens.operators import tickets as tk
from fleetlens.operators import uptime as up
from fleetlens.operators.search import center_index, service_index
from fleetlens.plans.check_sql import (
    AS_OF, age_band, clean, is_open, location_key, named, segment, stamp, wait_band, whole,
)
from fleetlens.plans.marts import MartFolder, build_marts, mart_sizes, new_folder, ticket_parts
from fleetlens.plans.query_devices import CHOSEN, CHOSEN_SQL, DEVICES_SQL, RECENCY_SQL
from fleetlens.plans.query_service import FLOW_SQL, NARROW as SERVICE_NARROW, NARROW_SQL as SERVICE_NARROW_SQL, SOME, SOME_SQL
from fleetlens.plans.query_tickets import NARROW, NARROW_SQL
from fleetlens.plans.registry import query
from fleetlens.session import remove, sparing_disk
from fleetlens.sources.cleaned import center_dimension, cleaned_tickets, register_devices
from fleetlens.sources.proxy import EVENTS_AS_OF, TICKETS_AS_OF
from fleetlens.sources.tables import Tables

# Sources


@query("S1_narrow_scan", f"SELECT CenterID, status, {stamp('CreatedAt')} AS CreatedAt FROM support_tickets")
def _(t: Tables) -> DataFrame:
    return t.scan("support_tickets", "CenterID", "status", "CreatedAt")


@query("S2_raw_sources", """
SELECT 'center_details' AS source, 'CenterID' AS order_key, COUNT(*) AS row_count, COUNT(CenterID) AS keyed FROM center_details
UNION ALL SELECT 'heartbeats', 'DeviceID', COUNT(*), COUNT(DeviceID) FROM heartbeats
UNION ALL SELECT 'support_tickets', 'ticketNumber', COUNT(*), COUNT(ticketNumber) FROM support_tickets
UNION ALL SELECT 'device_register', 'issue_key', COUNT(*), COUNT(issue_key) FROM device_register""")
def _(t: Tables) -> DataFrame:
    parts = [
        t.scan(s.table, s.order_key).agg(F.count("*").alias("row_count"), F.count(s.order_key).alias("keyed")).select(
            F.lit(name).alias("source"), F.lit(s.order_key).alias("order_key"), "row_count", "keyed")
        for name, s in ex.RAW_SOURCES.items()
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


_RAW_CENTER = """SELECT * REPLACE (CAST(CAST(deploymentdate AS DATE) AS VARCHAR) AS deploymentdate,
  CAST(CAST(deactivationdate AS DATE) AS VARCHAR) AS deactivationdate) FROM center_details"""
_CENTER_ORDER = ", ".join(f"{c} NULLS FIRST" for c in (
    "CenterID", "Centername", "HubID", "HubName", "City", "State", "PinCode", "hub_country", "hub_master_segment", "Status",
    "Billable", "MachineType", "DeviceID", "MacSerialID", "Type", "Spoke_Center_Segment", "deploymentdate", "deactivationdate"))


@query("S3_raw_page_centers", f"""
WITH r AS ({_RAW_CENTER} WHERE {segment('hub_master_segment')} IN ('LE') AND deploymentdate >= DATE '1996-01-01')
SELECT *, (SELECT COUNT(*) FROM r) AS total_rows FROM r ORDER BY {_CENTER_ORDER} LIMIT 25 OFFSET 25""")
def _(t: Tables) -> DataFrame:
    return ex.raw_page(t, "center_details", Filters(segments=("LE",), date_from="1996-01-01"), page=1)


@query("S3_raw_page_tickets", f"""
WITH r AS (SELECT * REPLACE ({stamp('CreatedAt')} AS CreatedAt, {stamp('ClosedAt')} AS ClosedAt) FROM support_tickets WHERE {NARROW_SQL})
SELECT *, (SELECT COUNT(*) FROM r) AS total_rows FROM r ORDER BY ticketNumber NULLS FIRST, CenterID NULLS FIRST, HubID NULLS FIRST,
  HubName NULLS FIRST, hub_master_segment NULLS FIRST, CreatedAt NULLS FIRST, ClosedAt NULLS FIRST, status NULLS FIRST,
  IssueCategory NULLS FIRST, assignee NULLS FIRST, priority NULLS FIRST, subject NULLS FIRST, TicketLink NULLS FIRST LIMIT 500""")
def _(t: Tables) -> DataFrame:
    columns = ["ticketNumber", "CenterID", "HubID", "HubName", "hub_master_segment", "CreatedAt", "ClosedAt", "status",
               "IssueCategory", "assignee", "priority", "subject", "TicketLink"]
    return ex.raw_page(t, "support_tickets", NARROW, size=500).select(*columns, "total_rows")


@query("S4_raw_export", f"{_RAW_CENTER} ORDER BY {_CENTER_ORDER}")
def _(t: Tables) -> DataFrame:
    return ex.raw_export_rows(t, "center_details")


@query("S5_cleaned_tickets", f"""
SELECT IssueCategory, status, COUNT(*) AS tickets, COUNT(DISTINCT ticketNumber) AS numbers, {stamp('MAX(CreatedAt)')} AS newest
FROM o_cleaned GROUP BY 1, 2""")
def _(t: Tables) -> DataFrame:
    return cleaned_tickets(t.tickets).groupBy("IssueCategory", "status").agg(
        F.count("*").alias("tickets"), F.countDistinct("ticketNumber").alias("numbers"), F.max("CreatedAt").alias("newest"))


@query("S6_register_devices", f"SELECT * REPLACE ({stamp('ticket_created')} AS ticket_created) FROM o_register")
def _(t: Tables) -> DataFrame:
    return register_devices(t.register)


@query("S7_center_dimension", "SELECT * REPLACE (CAST(deployment_date AS VARCHAR) AS deployment_date) FROM o_dimension")
def _(t: Tables) -> DataFrame:
    return center_dimension(t.centers)


_ACTIVE = "(SELECT * FROM o_center_360 WHERE status = 'ACTIVE')"
_SHOWN = "(SELECT * FROM o_devices WHERE COALESCE(status_name, '') <> 'Decommissioned' AND center_id IN (SELECT center_id FROM o_dimension WHERE status = 'ACTIVE'))"
_SCORED = f"SELECT COUNT(*) FROM (SELECT DISTINCT CenterID FROM center_details WHERE deploymentdate IS NOT NULL AND {clean('Status')} = 'ACTIVE')"


# Every mart's number of rows, each from its definition and not from the marts.
@query("S8_marts", f"""
WITH ranked AS (SELECT {named('country', '(blank)')} AS c, ROW_NUMBER() OVER (ORDER BY COUNT(*) DESC, {named('country', '(blank)')}) > 5 AS other
  FROM {_ACTIVE} GROUP BY 1),
leaves AS (SELECT DISTINCT {named('country', '(blank)')} AS c, {named('segment', '(blank)')} AS s FROM {_ACTIVE}),
bands AS (SELECT type, {age_band('age_days')} AS band FROM {_SHOWN}),
placed AS (SELECT p.*, (SELECT COUNT(lat) FROM o_placed c WHERE c.city = p.city AND c.state = p.state AND p.city <> '') AS near,
  (SELECT COUNT(lat) FROM o_placed h WHERE h.hub_id = p.hub_id) AS same_hub FROM o_placed p)
SELECT 'cleaned_tickets' AS mart, (SELECT COUNT(*) FROM o_cleaned) AS row_count
UNION ALL SELECT 'center_tickets', (SELECT COUNT(*) FROM o_center_tickets)
UNION ALL SELECT 'device_index', (SELECT COUNT(*) FROM o_devices)
UNION ALL SELECT 'center_360', (SELECT COUNT(*) FROM o_center_360)
UNION ALL SELECT 'scores', ({_SCORED}) UNION ALL SELECT 'reliability', ({_SCORED})
UNION ALL SELECT 'fleet_uptime', 1 UNION ALL SELECT 'sla_kpis', 1
UNION ALL SELECT 'devices', (SELECT COUNT(*) FROM {_SHOWN})
UNION ALL SELECT 'customers_tree', (SELECT 1 + COUNT(*) FILTER (NOT other) + MAX(other::INT) FROM ranked)
  + (SELECT COUNT(*) FROM leaves JOIN ranked ON leaves.c = ranked.c WHERE NOT other)
UNION ALL SELECT 'devices_tree', (SELECT 1 + COUNT(DISTINCT type) + COUNT(DISTINCT (type, band)) FILTER (band IS NOT NULL) FROM bands)
UNION ALL SELECT 'tickets_tree', 1 + 3 + 2 + 3 + (SELECT COUNT(DISTINCT {named('closure_type', 'Unknown')}) FROM field_service)
UNION ALL SELECT 'map_points', (SELECT COUNT(*) FROM placed WHERE status = 'ACTIVE' AND (lat IS NOT NULL OR near > 0 OR same_hub > 0))
UNION ALL SELECT 'accounts', (SELECT COUNT(DISTINCT account) FROM o_hubs)""")
def _(t: Tables) -> DataFrame:
    return mart_sizes(t.spark, build_marts(t, TICKETS_AS_OF, new_folder(t.spark), EVENTS_AS_OF))


def value_at_share(df: DataFrame, column: str, share: float, cells: int = 65_536) -> int | None:
    """The value of a whole-numbered column at this share of the ranks, the upper one between two; NULLs do not count.

    Rows are counted by cell of the range of values that holds the rank, until the cell is one value: no task holds all
    values, as an exact percentile would. The column is written apart, so that every pass reads it alone, and deleted after.
    """
    path = new_folder(df.sparkSession)
    df.select(F.col(column).cast("bigint").alias("v")).filter("v IS NOT NULL").write.parquet(path)
    values = df.sparkSession.read.schema("v bigint").parquet(path)
    low, high, n = values.agg(F.min("v"), F.max("v"), F.count("v")).first()
    rank = math.ceil((n - 1) * share)
    while n and low < high:
        width = (high - low) // cells + 1
        counted = values.filter(F.col("v").between(low, high)).groupBy(F.expr(f"(v - ({low}L)) div {width}L").alias("cell")).count()
        for cell, held in sorted(map(tuple, counted.collect())):
            if rank < held:
                low, high = low + cell * width, min(high, low + cell * width + width - 1)
                break
            rank -= held
    remove(df.sparkSession, path)
    return low


def one_percent_changed(t: Tables) -> Tables:
    """The tables after the newest hundredth of the tickets was closed, and a ticket of each center in it removed."""
    late = F.col("ticketNumber") >= F.lit(value_at_share(t.tickets, "ticketNumber", 0.99))
    changed = t.tickets.filter(~late | F.col("ticketNumber").isNull() | (F.col("ticketNumber") % 7 != 0)).withColumns({
        "status": F.when(late, F.lit("Closed")).otherwise(F.col("status")),
        "ClosedAt": F.when(late, F.coalesce("ClosedAt", tm.moment(TICKETS_AS_OF))).otherwise(F.col("ClosedAt")),
    })
    return t.replacing({"support_tickets": changed})


def row_differences(built: DataFrame, kept: DataFrame, part: int = 0, parts: int = 1) -> DataFrame:
    """One row: how many rows of ``built`` are missing in ``kept`` and how many of ``kept`` are surplus, repeats counted.

    What ``exceptAll`` either way would count, from one grouping of all rows. With ``parts``, of the rows that their content
    deals to ``part``: equal rows meet in one, so the parts add up to the whole.
    """
    columns = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(built.columns)]
    marked = built.select(*columns, F.lit(1).alias("side")).unionAll(kept.select(*columns, F.lit(-1).alias("side")))
    names = [f"c{i}" for i in range(len(columns))]
    if parts > 1:
        marked = marked.filter(F.pmod(F.xxhash64(*names), F.lit(parts)) == part)
    more = marked.groupBy(*names).agg(F.sum("side").alias("n")).filter("n <> 0")
    zero = F.lit(0).cast("bigint")
    return more.agg(
        F.coalesce(F.sum(F.greatest("n", zero)), zero).alias("missing"), F.coalesce(F.sum(F.greatest(-F.col("n"), zero)), zero).alias("surplus"),
    )


@query("S8_refreshed_marts", "SELECT name AS mart, 0 AS missing, 0 AS surplus FROM (VALUES ('cleaned_tickets'), ('center_tickets'), ('center_360'), ('scores')) v(name)")
def _(t: Tables) -> DataFrame:
    """Rows in which marts refreshed after a change differ from marts built anew."""
    with sparing_disk(t.spark):
        return _refresh_report(t)


def _refresh_report(t: Tables) -> DataFrame:
    # The refresh reads tickets from a table and reads it often, so they are one here too, until the marts are built.
    spark, stored = t.spark, new_folder(t.spark)
    t.tickets.write.parquet(stored)
    parts = ticket_parts(spark, stored)
    t = t.replacing({"support_tickets": spark.read.schema(t.tickets.schema).parquet(stored)})
    marts, changed = MartFolder(spark, new_folder(spark), ranges=64, buckets=16, parts=parts), one_percent_changed(t)
    marts.refresh(t, TICKETS_AS_OF, EVENTS_AS_OF)
    marts.refresh(changed, TICKETS_AS_OF, EVENTS_AS_OF)
    whole = build_marts(changed, TICKETS_AS_OF, new_folder(spark), EVENTS_AS_OF, parts=parts)
    remove(spark, stored)
    report = []
    for name in ("cleaned_tickets", "center_tickets", "center_360", "scores"):
        built, kept = spark.read.parquet(whole[name]), marts.mart(name)
        n = -(-parts // 2) if name == "cleaned_tickets" else 1
        found = [row_differences(built, kept.select(built.columns), part, n).first() for part in range(n)]
        report.append((name, sum(r["missing"] for r in found), sum(r["surplus"] for r in found)))
    return spark.createDataFrame(report, "mart string, missing bigint, surplus bigint")


# Filters


@query("F1_include", "SELECT CenterID, State FROM center_details WHERE TRIM(COALESCE(State, '')) IN ('State 3', 'State 7')")
def _(t: Tables) -> DataFrame:
    return where(t.centers, in_list("State", ("State 3", "", "State 7"))).select("CenterID", "State")


@query("F2_exclude", "SELECT CenterID, Status FROM center_details WHERE TRIM(COALESCE(Status, '')) NOT IN ('ACTIVE')")
def _(t: Tables) -> DataFrame:
    return where(t.centers, not_in_list("Status", ("ACTIVE",))).select("CenterID", "Status")


@query("F3_date_range", f"""
SELECT CAST(CAST(CreatedAt AS DATE) AS VARCHAR) AS day, COUNT(*) AS n FROM support_tickets
WHERE CAST(CreatedAt AS DATE) BETWEEN DATE '1998-03-01' AND DATE '1999-02-28' GROUP BY 1""")
def _(t: Tables) -> DataFrame:
    kept = where(t.tickets, date_range("CreatedAt", "1998-03-01", "1999-02-28"), date_range("ClosedAt", "not a date"))
    return kept.groupBy(F.col("CreatedAt").cast("date").alias("day")).agg(F.count("*").alias("n"))


ATTRIBUTES = Filters(
    segments=("LE", "SME", "(blank)"), statuses=("ACTIVE", "INACTIVE"), billable=("YES",), machine_types=("Alpha", "Beta", "Gamma"),
    cities=("City 7", "City 0", "City 3", "City 15", "City 33", "City 36", "City 42"),
)
ATTRIBUTES_SQL = f"""{segment('hub_master_segment')} IN ('LE', 'SME', '(blank)') AND TRIM(Status) IN ('ACTIVE', 'INACTIVE')
  AND TRIM(Billable) IN ('YES') AND TRIM(MachineType) IN ('Alpha', 'Beta', 'Gamma')
  AND TRIM(City) IN ('City 7', 'City 0', 'City 3', 'City 15', 'City 33', 'City 36', 'City 42')"""


@query("F4_center_attributes", f"SELECT CenterID, City, State FROM center_details WHERE {ATTRIBUTES_SQL}")
def _(t: Tables) -> DataFrame:
    return where(t.centers, ATTRIBUTES.center()).select("CenterID", "City", "State")


@query("F5_center_bridge", f"""
SELECT status, COUNT(*) AS n FROM support_tickets WHERE CenterID IN (SELECT CenterID FROM center_details WHERE {ATTRIBUTES_SQL})
GROUP BY 1""")
def _(t: Tables) -> DataFrame:
    return by_center(t.tickets, t, ATTRIBUTES).groupBy("status").agg(F.count("*").alias("n"))


@query("F6_center_rows", """
SELECT center_id, city FROM o_dimension WHERE segment IN ('LE') AND status IN ('ACTIVE')
  AND deployment_date BETWEEN DATE '1995-06-01' AND DATE '1998-06-30'""")
def _(t: Tables) -> DataFrame:
    chosen = Filters(segments=("LE",), statuses=("ACTIVE",), date_from="1995-06-01", date_to="1998-06-30")
    return where(center_dimension(t.centers), chosen.center_row()).select("center_id", "city")


@query("F7_single_hub", f"""
SELECT COUNT(*) AS total, COUNT(*) FILTER (WHERE {is_open()}) AS open FROM o_cleaned WHERE HubName = 'Hub 59'""")
def _(t: Tables) -> DataFrame:
    return tk.scope(t, Filters(hub="Hub 59")).agg(
        F.count("*").alias("total"), F.count_if(cl.is_open("status")).alias("open"))


@query("F8_service_filters", f"SELECT ticket_id, state FROM field_service WHERE {SERVICE_NARROW_SQL}")
def _(t: Tables) -> DataFrame:
    return sv.service_scope(t, SERVICE_NARROW).select("ticket_id", "state")


@query("F9_escalation_filters", f"SELECT center_id, zoho_id FROM escalations WHERE {SOME_SQL}")
def _(t: Tables) -> DataFrame:
    return sv.escalation_scope(t, SOME).select("center_id", "zoho_id")


@query("F10_register_filters", f"SELECT key, type, status, center_id FROM o_devices WHERE {CHOSEN_SQL}")
def _(t: Tables) -> DataFrame:
    return dv.filtered_devices(t, TICKETS_AS_OF, CHOSEN).select("key", "type", "status", "center_id")


@query("F11_open_tickets", f"SELECT status, {is_open()} AS is_open, COUNT(*) AS n FROM support_tickets GROUP BY 1, 2")
def _(t: Tables) -> DataFrame:
    return t.tickets.groupBy("status", cl.is_open("status").alias("is_open")).agg(F.count("*").alias("n"))


@query("F12_valid_turnaround", """
SELECT COUNT(*) FILTER (WHERE tat_days_ >= 0) AS valid, COUNT(*) FILTER (WHERE tat_days_ < 0) AS invalid,
  COUNT(*) FILTER (WHERE tat_days_ IS NULL) AS unknown FROM field_service""")
def _(t: Tables) -> DataFrame:
    tat = F.col("tat_days_")
    return t.service.agg(
        F.count_if(cl.tat_is_valid(tat)).alias("valid"), F.count_if(tat < 0).alias("invalid"),
        F.count_if(tat.isNull()).alias("unknown"))


@query("F13_one_segment", "SELECT CenterID FROM center_details WHERE TRIM(COALESCE(hub_master_segment, '')) = 'Government'")
def _(t: Tables) -> DataFrame:
    return where(t.centers, in_list("hub_master_segment", ("Government",))).select("CenterID")


# Classification: every distinct input with its class and how often it occurs.


def _classes(df: DataFrame, **columns: Column) -> DataFrame:
    return df.groupBy(*(c.alias(n) for n, c in columns.items())).agg(F.count("*").alias("n"))


@query("C1_segment_group", f"""
SELECT hub_master_segment AS segment, {segment('hub_master_segment')} AS merged, COUNT(*) AS n FROM support_tickets GROUP BY 1, 2""")
def _(t: Tables) -> DataFrame:
    return _classes(t.tickets, segment=F.col("hub_master_segment"), merged=cl.segment_group("hub_master_segment"))


def _sla_classes(columns: str) -> str:
    return f"SELECT IssueCategory, {columns}, COUNT(*) AS n FROM o_measured GROUP BY ALL"


@query("C2_sla_days", _sla_classes("sla_days"))
def _(t: Tables) -> DataFrame:
    return tk.with_sla(cleaned_tickets(t.tickets)).groupBy("IssueCategory", "sla_days").agg(F.count("*").alias("n"))


@query("C3_technical", _sla_classes("is_tech"))
def _(t: Tables) -> DataFrame:
    return tk.with_sla(cleaned_tickets(t.tickets)).groupBy("IssueCategory", "is_tech").agg(F.count("*").alias("n"))


@query("C4_sla_record", _sla_classes("sla_days, is_tech, matched AS sla_matched"))
def _(t: Tables) -> DataFrame:
    rows = tk.with_sla(cleaned_tickets(t.tickets))
    return rows.groupBy("IssueCategory", "sla_days", "is_tech", "sla_matched").agg(F.count("*").alias("n"))


@query("C5_recency", f"SELECT DeviceID, CenterID, {RECENCY_SQL} AS bucket FROM heartbeats")
def _(t: Tables) -> DataFrame:
    bucket = cl.recency_bucket("LastTimeStamp", tm.shifted_moment(EVENTS_AS_OF))
    return t.heartbeats.select("DeviceID", "CenterID", bucket.alias("bucket"))


@query("C6_open_age_band", f"""
SELECT a AS age_days, {wait_band('a')} AS band, COUNT(*) AS n
FROM (SELECT date_diff('hour', CreatedAt, {AS_OF}) / 24.0 AS a FROM support_tickets WHERE {is_open()} AND CreatedAt IS NOT NULL) GROUP BY 1, 2""")
def _(t: Tables) -> DataFrame:
    open_ones = t.tickets.filter(cl.is_open("status") & F.col("CreatedAt").isNotNull())
    age = tm.hours_between("CreatedAt", tm.moment(TICKETS_AS_OF)) / 24
    return _classes(open_ones, age_days=age, band=cl.wait_band(age))


@query("C7_turnaround_band", f"""
SELECT tat_days_, {wait_band('tat_days_')} AS band, COUNT(*) AS n FROM field_service WHERE tat_days_ >= 0 GROUP BY 1, 2""")
def _(t: Tables) -> DataFrame:
    valid = t.service.filter(cl.tat_is_valid("tat_days_"))
    return _classes(valid, tat_days_=F.col("tat_days_"), band=cl.wait_band("tat_days_"))


@query("C8_device_age_band", f"SELECT age_days, {age_band('age_days')} AS band, COUNT(*) AS n FROM o_devices GROUP BY 1, 2")
def _(t: Tables) -> DataFrame:
    return _classes(dv.device_index(t, TICKETS_AS_OF), age_days=F.col("age_days"), band=cl.age_band("age_days"))


@query("C9_signal_bucket", f"""
SELECT CSQ, CASE WHEN {whole('CSQ')} IS NULL THEN 'Unknown' WHEN {whole('CSQ')} < 10 THEN 'Poor' WHEN {whole('CSQ')} < 20 THEN 'Fair'
  WHEN {whole('CSQ')} < 30 THEN 'Good' ELSE 'Excellent' END AS bucket, COUNT(*) AS n FROM heartbeats GROUP BY 1, 2""")
def _(t: Tables) -> DataFrame:
    return _classes(t.heartbeats, CSQ=F.col("CSQ"), bucket=cl.signal_bucket("CSQ"))


@query("C10_battery_bucket", f"""
SELECT BatteryLevel, CASE WHEN UPPER(COALESCE(BatteryLevel, '')) = 'CHARGING' THEN 'Charging' WHEN {whole('BatteryLevel')} IS NULL
  THEN 'Unknown' WHEN {whole('BatteryLevel')} < 20 THEN 'Low' ELSE 'Normal' END AS bucket, COUNT(*) AS n FROM heartbeats GROUP BY 1, 2""")
def _(t: Tables) -> DataFrame:
    return _classes(t.heartbeats, BatteryLevel=F.col("BatteryLevel"), bucket=cl.battery_bucket("BatteryLevel"))


@query("C11_counter_bucket", f"""
SELECT EcgCounter, CASE WHEN {whole('EcgCounter')} = 0 THEN '0' WHEN {whole('EcgCounter')} <= 5 THEN '1-5'
  WHEN {whole('EcgCounter')} <= 20 THEN '6-20' ELSE '21+' END AS bucket, COUNT(*) AS n FROM heartbeats
WHERE {whole('EcgCounter')} IS NOT NULL GROUP BY 1, 2""")
def _(t: Tables) -> DataFrame:
    counted = t.heartbeats.filter(F.col("EcgCounter").try_cast("bigint").isNotNull())
    return _classes(counted, EcgCounter=F.col("EcgCounter"), bucket=cl.counter_bucket("EcgCounter"))


@query("C12_outcome_class", f"""
SELECT remarks, CASE WHEN {clean('remarks')} IN ('Issue Resolved', 'Auto Resolved') THEN 'resolved'
  WHEN {clean('remarks')} IN ('Not resolved', 'No response') THEN 'unresolved' ELSE 'other' END AS outcome, COUNT(*) AS n
FROM escalations GROUP BY 1, 2""")
def _(t: Tables) -> DataFrame:
    return _classes(t.escalations, remarks=F.col("remarks"), outcome=cl.outcome_class("remarks"))


@query("C13_model_token", "SELECT summary, category AS model, COUNT(*) AS n FROM o_devices GROUP BY 1, 2")
def _(t: Tables) -> DataFrame:
    devices = dv.tracked(register_devices(t.register))
    return _classes(devices, summary=F.coalesce("summary", F.lit("")), model=model_of("summary"))


@query("C14_serial", "SELECT summary, serial, COUNT(*) AS n FROM o_devices GROUP BY 1, 2")
def _(t: Tables) -> DataFrame:
    devices = dv.tracked(register_devices(t.register))
    return _classes(devices, summary=F.coalesce("summary", F.lit("")), serial=serial_of("summary"))


@query("C15_created_age", "SELECT CAST(birthday AS VARCHAR) AS birthday, age_days, COUNT(*) AS n FROM o_devices GROUP BY 1, 2")
def _(t: Tables) -> DataFrame:
    created = F.col("ticket_created")
    devices = dv.tracked(register_devices(t.register))
    return _classes(devices, birthday=created.cast("date"), age_days=tm.whole_days_between(created, tm.moment(TICKETS_AS_OF)))


@query("C16_blank_labels", f"""
SELECT {named('IssueCategory', 'Uncategorised')} AS category, {named('priority', '—')} AS priority, {named('assignee', 'Unassigned')} AS assignee,
  {named('status', '(blank)')} AS status, COUNT(*) AS n FROM support_tickets GROUP BY ALL""")
def _(t: Tables) -> DataFrame:
    return _classes(
        t.tickets, category=label("IssueCategory", "Uncategorised"), priority=label("priority", "—"),
        assignee=label("assignee", "Unassigned"), status=label("status", "(blank)"))


@query("C17_location_key", f"""
SELECT {location_key('PinCode', 'City', 'State', 'hub_country')} AS key, COUNT(*) AS n FROM center_details GROUP BY 1""")
def _(t: Tables) -> DataFrame:
    return _classes(t.centers, key=cl.location_key("PinCode", "City", "State", "hub_country"))


# Joins


@query("J1_left_join_first", """
SELECT d.key, d.center_id, f.DeviceID AS first_device, f.CSQ AS first_csq FROM o_devices d LEFT JOIN (
  SELECT * FROM (SELECT CenterID, DeviceID, CSQ, ROW_NUMBER() OVER (PARTITION BY CenterID ORDER BY DeviceID NULLS FIRST, CSQ NULLS FIRST) AS rn
    FROM heartbeats) WHERE rn = 1) f ON d.center_id = f.CenterID""")
def _(t: Tables) -> DataFrame:
    first = t.heartbeats.select(
        F.col("CenterID").alias("center_id"), F.col("DeviceID").alias("first_device"), F.col("CSQ").alias("first_csq"))
    devices = dv.device_index(t, TICKETS_AS_OF).select("key", "center_id")
    return joins.left_join_first(devices, first, "center_id", ["first_device", "first_csq"])


@query("J2_semi_join", f"SELECT IssueCategory, COUNT(*) AS n FROM o_cleaned WHERE {NARROW_SQL} GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return tk.scope(t, NARROW).groupBy("IssueCategory").agg(F.count("*").alias("n"))


@query("J3_full_outer_months", FLOW_SQL)
def _(t: Tables) -> DataFrame:
    return sv.service_flow(t)


@query("J4_newest_bound", """
SELECT ticket_id, CAST(CAST(created_on AS DATE) AS VARCHAR) AS created FROM field_service
WHERE CAST(created_on AS DATE) >= (SELECT CAST(MAX(created_on) AS DATE) FROM field_service) - 30""")
def _(t: Tables) -> DataFrame:
    created = F.col("created_on").cast("date")
    newest = t.service.agg(F.max("created_on").cast("date")).scalar()
    return t.service.filter(created >= F.date_sub(newest, 30)).select("ticket_id", created.alias("created"))


@query("J5_birth_with_downtime", f"""
SELECT center_id, {stamp('birth')} AS birth, COALESCE(downtime_hrs, 0) AS downtime_hrs
FROM o_births LEFT JOIN o_downtime USING (center_id)""")
def _(t: Tables) -> DataFrame:
    down = tk.center_ticket_stats(cleaned_tickets(t.tickets), TICKETS_AS_OF).select("center_id", "downtime_hrs")
    return up.births(t).join(down, "center_id", "left").withColumn("downtime_hrs", F.coalesce("downtime_hrs", F.lit(0)))


@query("J6_open_flag_by_state", f"""
SELECT {named('State', 'Unknown')} AS state, COUNT(DISTINCT CASE WHEN CenterID IN (SELECT CenterID FROM o_cleaned
  WHERE CenterID IS NOT NULL AND {is_open()}) THEN CenterID END) AS with_open FROM center_details GROUP BY 1""")
def _(t: Tables) -> DataFrame:
    opened = cleaned_tickets(t.tickets).filter(cl.is_open("status"))
    flagged = joins.with_flag(t.centers.select("CenterID", "State"), opened, "CenterID", "has_open")
    return flagged.groupBy(label("State", "Unknown").alias("state")).agg(
        F.countDistinct(F.when(F.col("has_open"), F.col("CenterID"))).alias("with_open"))


@query("J7_serial_map", "SELECT serial, center_id FROM o_serials")
def _(t: Tables) -> DataFrame:
    return dv.serial_map(t.heartbeats, t.centers)


@query("J8_device_center", "SELECT key, serial, center_id FROM o_devices")
def _(t: Tables) -> DataFrame:
    return dv.device_index(t, TICKETS_AS_OF).select("key", "serial", "center_id")


@query("J9_center_account", "SELECT account, center_id, d.hub_id FROM o_dimension d JOIN o_hubs h ON d.hub_id = h.hub_id")
def _(t: Tables) -> DataFrame:
    return joins.with_account(center_dimension(t.centers)).select("account", "center_id", "hub_id")


@query("J10_coordinates", f"""
SELECT center_id, CAST(NULLIF(split_part(value, ',', 1), 'x') AS DOUBLE) AS lat, CAST(NULLIF(split_part(value, ',', 2), '') AS DOUBLE) AS lng
FROM o_dimension LEFT JOIN o_store ON key = {location_key('pin', 'city', 'state', 'country')}""")
def _(t: Tables) -> DataFrame:
    return geo.with_coordinates(center_dimension(t.centers), t.geo_store).select("center_id", "lat", "lng")


@query("J11_center_names", """
SELECT s.center_id AS centerid, failures, COALESCE(NULLIF(name, ''), 'Center #' || CAST(s.center_id AS VARCHAR)) AS center,
  COALESCE(devices, 0) AS devices
FROM o_scored s LEFT JOIN (SELECT center_id, MIN(COALESCE(center, '')) AS name FROM o_dimension GROUP BY 1) n ON s.center_id = n.center_id
LEFT JOIN (SELECT center_id, COUNT(*) AS devices FROM o_devices GROUP BY 1) d ON s.center_id = d.center_id""")
def _(t: Tables) -> DataFrame:
    rows = up.reliability(up.scored(t, TICKETS_AS_OF)).select("centerid", "failures")
    return ct.named(rows, ct.center_names(t, TICKETS_AS_OF))


# Explorer helpers


@query("X1_search", """
SELECT ticket_id, contact_person_name FROM field_service
WHERE LOWER(COALESCE(ticket_id, '')) LIKE '%contact 1%' OR LOWER(COALESCE(contact_person_name, '')) LIKE '%contact 1%'""")
def _(t: Tables) -> DataFrame:
    found = service_index(t).search("CONTACT 1", ("ticket_id", "contact_person_name"))
    return found.select("ticket_id", "contact_person_name")


_TWO = "SELECT ticket_id, contact_person_name FROM field_service WHERE LOWER(COALESCE(ticket_id, '')) LIKE '%t9%' OR LOWER(COALESCE(contact_person_name, '')) LIKE '%t9%' OR LOWER(COALESCE(ticket_id, '')) LIKE '%99%'"


@query("X1_search_by_scan", _TWO)
def _(t: Tables) -> DataFrame:
    fields = ("ticket_id", "contact_person_name")
    return where(t.service, contains_text(fields, "T9") | contains_text(("ticket_id",), "99")).select(*fields)


@query("X1_search_two_characters", """
SELECT ticket_id, contact_person_name FROM field_service
WHERE LOWER(COALESCE(ticket_id, '')) LIKE '%99%' OR LOWER(COALESCE(contact_person_name, '')) LIKE '%99%'""")
def _(t: Tables) -> DataFrame:
    fields = ("ticket_id", "contact_person_name")
    return service_index(t).search("99", fields).select(*fields)


@query("X2_page", """
SELECT ticket_id, status, (SELECT COUNT(*) FROM field_service) AS total_rows FROM field_service ORDER BY ticket_id LIMIT 20 OFFSET 40""")
def _(t: Tables) -> DataFrame:
    return ex.page_of(t.service.select("ticket_id", "status"), [F.col("ticket_id").asc()], 2, 20)


@query("X3_sort_whitelist", """
SELECT ticket_id, product FROM field_service ORDER BY product DESC NULLS LAST, ticket_id LIMIT 30""")
def _(t: Tables) -> DataFrame:
    keys = {"product": "product", "status": "status"}
    order = ex.sort_order(keys, "drop table", "desc", "product", [F.col("ticket_id").asc()])
    return t.service.select("ticket_id", "product").orderBy(*order).limit(30)


@query("X4_empties_last", """
SELECT CenterID, City, State FROM center_details ORDER BY NULLIF(State, '') DESC NULLS LAST, CenterID DESC, City NULLS FIRST""")
def _(t: Tables) -> DataFrame:
    order = [ex.empties_last("State", "desc", is_text=True), F.col("CenterID").desc(), F.col("City").asc_nulls_first()]
    return t.centers.select("CenterID", "City", "State").orderBy(*order)


def _top(column: str, name: str) -> str:
    return f"""
SELECT TRIM({column}) AS {name}, COUNT(DISTINCT CenterID) AS centers FROM center_details WHERE TRIM({column}) <> ''
GROUP BY 1 ORDER BY centers DESC, {name} LIMIT 50"""


@query("X5_top_hubs", _top("HubName", "hub"))
def _(t: Tables) -> DataFrame:
    return ex.top_values(t.centers, "HubName", "hub")


@query("X5_top_device_ids", _top("DeviceID", "device_id"))
def _(t: Tables) -> DataFrame:
    return ex.top_values(t.centers, "DeviceID", "device_id")


@query("X5_top_mac_serials", _top("MacSerialID", "mac_serial"))
def _(t: Tables) -> DataFrame:
    return ex.top_values(t.centers, "MacSerialID", "mac_serial")


def _find(column: str, name: str, text: str, also: str = "") -> str:
    return f"""
SELECT DISTINCT TRIM({column}) AS {name} FROM center_details WHERE TRIM({column}) <> ''
  AND (LOWER(TRIM({column})) LIKE '%{text}%' {also}) ORDER BY 1 LIMIT 50"""


@query("X6_find_hubs", _find("HubName", "hub", "13", "OR CAST(HubID AS VARCHAR) LIKE '%13%'"))
def _(t: Tables) -> DataFrame:
    return ex.find_values(center_index(t), "HubName", "hub", "13", also="HubID")


@query("X6_find_device_ids", _find("DeviceID", "device_id", "d1-0001"))
def _(t: Tables) -> DataFrame:
    return ex.find_values(center_index(t), "DeviceID", "device_id", "D1-0001")


@query("X6_find_mac_serials", _find("MacSerialID", "mac_serial", "m2-00001"))
def _(t: Tables) -> DataFrame:
    return ex.find_values(center_index(t), "MacSerialID", "mac_serial", "m2-00001")


@query("X6_find_centers", """
SELECT CAST(CenterID AS VARCHAR) AS value, COALESCE(NULLIF(TRIM(Centername), ''), 'Center') || ' · #' || CAST(CenterID AS VARCHAR) AS label
FROM center_details WHERE LOWER(TRIM(Centername)) LIKE '%44%' OR CAST(CenterID AS VARCHAR) LIKE '%44%'
GROUP BY CenterID, Centername ORDER BY CenterID, Centername NULLS FIRST LIMIT 50""")
def _(t: Tables) -> DataFrame:
    return ex.find_centers(center_index(t), "44")
