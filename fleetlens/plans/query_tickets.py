"""Support-ticket queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.filters import Filters
from fleetlens.operators import tickets as tk
from fleetlens.plans.check_sql import AS_OF, is_open, named, segment, stamp, wait_band
from fleetlens.plans.marts import with_ticket_marts
from fleetlens.plans.registry import query
from fleetlens.sources.cleaned import cleaned_tickets
from fleetlens.sources.proxy import TICKETS_AS_OF
from fleetlens.sources.tables import Tables

CENTER = 59
NARROW = Filters(segments=("LE", "SME"), statuses=("ACTIVE",), date_from="1996-02-01", date_to="2001-07-15")
NARROW_SQL = f"""CenterID IN (SELECT CenterID FROM center_details
    WHERE {segment('hub_master_segment')} IN ('LE', 'SME') AND TRIM(Status) = 'ACTIVE')
  AND CAST(CreatedAt AS DATE) BETWEEN DATE '1996-02-01' AND DATE '2001-07-15'"""

_TICKETS = f"""SELECT ticketNumber, CenterID, {stamp('CreatedAt')} AS CreatedAt, {stamp('ClosedAt')} AS ClosedAt,
  status, IssueCategory FROM o_cleaned"""


@query("T1_dedup_tickets", _TICKETS)
def _(t: Tables) -> DataFrame:
    return cleaned_tickets(t.tickets)


def _kpis(where: str = "TRUE") -> str:
    return f"""
WITH f AS (SELECT COALESCE({is_open()}, FALSE) AS pending, date_diff('hour', CreatedAt, {AS_OF}) / 24.0 AS age,
    (epoch({AS_OF}) - epoch(CreatedAt)) / 86400 AS made, (epoch({AS_OF}) - epoch(ClosedAt)) / 86400 AS done
  FROM o_cleaned WHERE {where})
SELECT COUNT(*) AS total_tickets, COUNT(*) FILTER (pending) AS open_tickets, ROUND(AVG(age) FILTER (pending), 1) AS avg_open_age_days,
  COUNT(*) FILTER (made <= 7) AS created_7d, COUNT(*) FILTER (made > 7 AND made <= 14) AS created_7d_prev,
  COUNT(*) FILTER (done <= 7) AS closed_7d, COUNT(*) FILTER (done > 7 AND done <= 14) AS closed_7d_prev FROM f"""


@query("T2_ticket_kpis", _kpis())
def _(t: Tables) -> DataFrame:
    return tk.kpis(t, TICKETS_AS_OF)


@query("T2_ticket_kpis_filtered", _kpis(NARROW_SQL))
def _(t: Tables) -> DataFrame:
    return tk.kpis(t, TICKETS_AS_OF, NARROW)


def _sla(where: str = "TRUE") -> str:
    return f"""
SELECT COUNT(met) AS resolved_n, ROUND(AVG(res_days) FILTER (resolved), 1) AS avg_res_days, ROUND(AVG(met) * 100, 1) AS within_pct,
  ROUND(AVG(met) FILTER (is_tech) * 100, 1) AS within_tech, ROUND(AVG(met) FILTER (NOT is_tech) * 100, 1) AS within_nontech,
  COUNT(*) FILTER (stage = 'late') AS breached_open, COUNT(*) FILTER (stage = 'near') AS atrisk_open
FROM o_staged WHERE {where}"""


@query("T3_sla_kpis", _sla())
def _(t: Tables) -> DataFrame:
    return tk.sla_kpis(t, TICKETS_AS_OF)


@query("T3_sla_kpis_filtered", _sla(NARROW_SQL))
def _(t: Tables) -> DataFrame:
    return tk.sla_kpis(with_ticket_marts(t), TICKETS_AS_OF, NARROW)


@query("T4_breach_by_category", f"""
SELECT {named('IssueCategory', 'Uncategorised')} AS category, MIN(sla_days) AS sla_days, BOOL_AND(is_tech) AS is_tech,
  COUNT(*) AS tickets, COUNT(met) AS resolved_n, ROUND(AVG(1 - met) * 100, 1) AS breach_pct,
  ROUND(AVG(res_days) FILTER (resolved), 1) AS avg_res_days
FROM o_staged GROUP BY 1 HAVING COUNT(met) >= 20
ORDER BY breach_pct DESC, tickets DESC, category LIMIT 15""")
def _(t: Tables) -> DataFrame:
    return tk.sla_by_category(t, TICKETS_AS_OF)


@query("T5_open_risk_by_category", f"""
SELECT * FROM (SELECT {named('IssueCategory', 'Uncategorised')} AS category,
  COUNT(*) FILTER (stage = 'late') AS breached, COUNT(*) FILTER (stage = 'near') AS atrisk
  FROM o_staged GROUP BY 1) WHERE breached + atrisk > 0 ORDER BY breached + atrisk DESC, category LIMIT 12""")
def _(t: Tables) -> DataFrame:
    return tk.open_risk_by_category(with_ticket_marts(t), TICKETS_AS_OF)


WORKLIST_SQL = f"""
SELECT ticketNumber AS ticket, CenterID AS center_id, {named('IssueCategory', 'Uncategorised')} AS category, status,
  {named('priority', '—')} AS priority, {named('assignee', '—')} AS assignee, COALESCE(TicketLink, '') AS link, sla_days,
  strftime(CreatedAt, '%Y-%m-%d') AS created, ROUND(age_days, 1) AS age_days, ROUND(age_days - sla_days, 1) AS days_over,
  CASE WHEN age_days > sla_days THEN 'BREACHED' ELSE 'AT_RISK' END AS risk
FROM o_measured WHERE is_open AND CreatedAt IS NOT NULL AND age_days > 0.75 * sla_days"""


@query("T6_sla_worklist", WORKLIST_SQL)
def _(t: Tables) -> DataFrame:
    return tk.worklist_rows(with_ticket_marts(t), TICKETS_AS_OF)


@query("T6_sla_worklist_page", f"""
WITH w AS ({WORKLIST_SQL}), f AS (SELECT * FROM w WHERE risk = 'BREACHED'
  AND (CAST(ticket AS VARCHAR) LIKE '%agent 5%' OR LOWER(category) LIKE '%agent 5%' OR LOWER(assignee) LIKE '%agent 5%'
    OR CAST(center_id AS VARCHAR) LIKE '%agent 5%'))
SELECT *, (SELECT COUNT(*) FROM f) AS total_rows FROM f
ORDER BY days_over DESC NULLS LAST, ticket DESC NULLS LAST, center_id NULLS FIRST, created, days_over, category LIMIT 15 OFFSET 15""")
def _(t: Tables) -> DataFrame:
    return tk.worklist(with_ticket_marts(t), TICKETS_AS_OF, search="AGENT 5", risk="breached", page=1)


@query("T7_monthly_trend", f"""
SELECT strftime(moment, '%Y-%m') AS month, COUNT(*) FILTER (what = 'made') AS created, COUNT(*) FILTER (what = 'done') AS closed
FROM (SELECT CreatedAt AS made, ClosedAt AS done FROM o_cleaned) UNPIVOT (moment FOR what IN (made, done))
WHERE moment >= {AS_OF} - INTERVAL 12 MONTH GROUP BY 1 ORDER BY 1""")
def _(t: Tables) -> DataFrame:
    return tk.trend(t, TICKETS_AS_OF)


@query("T8_open_by_status", f"""
SELECT status, COUNT(*) AS cnt FROM o_cleaned WHERE {is_open()} GROUP BY status ORDER BY cnt DESC, status LIMIT 10""")
def _(t: Tables) -> DataFrame:
    return tk.open_by_status(t)


@query("T9_recent_categories", f"""
SELECT {named('IssueCategory', 'Uncategorised')} AS category, COUNT(*) AS cnt FROM o_cleaned
WHERE CreatedAt >= {AS_OF} - INTERVAL 90 DAY GROUP BY 1 ORDER BY cnt DESC, category LIMIT 10""")
def _(t: Tables) -> DataFrame:
    return tk.recent_categories(t, TICKETS_AS_OF)


@query("T10_open_age_bands", f"""
SELECT {wait_band(f"(date_diff('hour', CreatedAt, {AS_OF}) / 24.0)")} AS band, COUNT(*) AS cnt FROM o_cleaned
WHERE {is_open()} AND CreatedAt IS NOT NULL GROUP BY 1""")
def _(t: Tables) -> DataFrame:
    return tk.open_age_bands(t, TICKETS_AS_OF)


@query("T11_recent_segments", f"""
SELECT {segment('hub_master_segment', "'Unknown'")} AS segment, COUNT(*) AS cnt FROM o_cleaned
WHERE CreatedAt >= {AS_OF} - INTERVAL 90 DAY GROUP BY 1 ORDER BY cnt DESC, segment LIMIT 8""")
def _(t: Tables) -> DataFrame:
    return tk.recent_segments(t, TICKETS_AS_OF)


@query("T12_ticket_totals", """
SELECT COUNT(*) AS total, COUNT(*) FILTER (WHERE is_tech) AS tech, COUNT(*) FILTER (WHERE NOT is_tech) AS nontech FROM o_measured""")
def _(t: Tables) -> DataFrame:
    return tk.totals(t)


@query("T13_tickets_by_status", f"""
SELECT {named('status', '(blank)')} AS k, COUNT(*) AS n FROM o_cleaned GROUP BY 1 ORDER BY n DESC, k LIMIT 15""")
def _(t: Tables) -> DataFrame:
    return tk.by_status(t)


@query("T14_center_tickets", "SELECT center_id, tickets_total, open_tickets, swapped, segment FROM o_center_tickets")
def _(t: Tables) -> DataFrame:
    return tk.per_center(t)


@query("T15_center_failures", f"SELECT cid, {stamp('first_fail')} AS first_fail, n_fail, top_cat FROM o_center_failures")
def _(t: Tables) -> DataFrame:
    return tk.failures_by_center(t)


@query("T16_center_totals", f"""
SELECT COUNT(*) AS total_tickets, COUNT(*) FILTER (WHERE {is_open()}) AS open_tickets,
  MIN({segment('hub_master_segment', 'NULL')}) AS segment FROM o_cleaned WHERE CenterID = {CENTER}""")
def _(t: Tables) -> DataFrame:
    return tk.center_totals(t, CENTER)


def _drill(where: str, limit: int) -> str:
    return f"""
SELECT ticketNumber AS ticket, status, {named('priority', '—')} AS priority, {named('subject', '(no subject)')} AS subject,
  {named('IssueCategory', '')} AS category, COALESCE(TicketLink, '') AS link, {stamp('CreatedAt')} AS created
FROM o_cleaned WHERE CenterID = {CENTER} {where} ORDER BY CreatedAt DESC NULLS LAST, ticketNumber NULLS FIRST LIMIT {limit}"""


@query("T16_center_tickets_open", _drill(f"AND {is_open()}", 25))
def _(t: Tables) -> DataFrame:
    return tk.center_tickets(t, CENTER, only_open=True)


@query("T16_center_tickets_all", _drill("", 50))
def _(t: Tables) -> DataFrame:
    return tk.center_tickets(t, CENTER)


ACCOUNT_STATS_SQL = """
SELECT COUNT(*) AS total_tickets, COUNT(*) FILTER (WHERE is_open AND age_days > sla_days) AS sla_breach,
  ROUND(COUNT(*) FILTER (WHERE resolved AND res_days <= sla_days) / NULLIF(COUNT(*) FILTER (WHERE resolved), 0) * 100, 1) AS sla_within_pct
FROM o_measured WHERE HubID IN (SELECT hub_id FROM o_hubs)"""


@query("T17_account_ticket_stats", ACCOUNT_STATS_SQL)
def _(t: Tables) -> DataFrame:
    return tk.account_ticket_stats(t, TICKETS_AS_OF)


@query("T18_look_up", f"""
SELECT 'center' AS kind, {CENTER} AS center_id, CAST(NULL AS BIGINT) AS ticket
WHERE EXISTS (SELECT 1 FROM center_details WHERE CenterID = {CENTER})
UNION ALL SELECT 'ticket', CenterID, ticketNumber FROM o_cleaned WHERE CenterID IS NOT NULL
  AND ticketNumber = (SELECT MAX(ticketNumber) FROM o_cleaned WHERE CenterID IS NOT NULL)
  AND ticketNumber NOT IN (SELECT CenterID FROM center_details)""")
def _(t: Tables) -> DataFrame:
    newest = cleaned_tickets(t.tickets).filter("CenterID IS NOT NULL").agg(F.max("ticketNumber")).scalar()
    return tk.look_up(t, CENTER).unionByName(tk.look_up(t, newest))
