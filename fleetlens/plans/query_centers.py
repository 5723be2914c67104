"""Center queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.filters import Filters
from fleetlens.operators import centers as ct
from fleetlens.operators import devices as dv
from fleetlens.operators.explore import options
from fleetlens.functions.classify import segment_group
from fleetlens.plans.check_sql import AS_OF, age_band, named, segment, stamp
from fleetlens.plans.marts import center_mart
from fleetlens.plans.query_tickets import CENTER
from fleetlens.plans.registry import query
from fleetlens.sources.proxy import EVENTS_AS_OF, TICKETS_AS_OF
from fleetlens.sources.tables import Tables

ONE_STATE = Filters(states=("State 3",))
PAID = Filters(billable=("YES", "NO"), date_from="1995-06-01", date_to="1998-06-30")


@query("N1_center_kpis", """
WITH c AS (SELECT CenterID AS center_id, BOOL_OR(deactivationdate IS NULL) AS running FROM center_details
  WHERE CenterID IS NOT NULL GROUP BY 1)
SELECT COUNT(*) AS centers, (SELECT COUNT(DISTINCT TRIM(City)) FROM center_details WHERE TRIM(City) <> '') AS cities,
  COUNT(*) FILTER (running) AS active_deployments, COUNT(*) FILTER (open_tickets > 0) AS centers_with_open_tickets
FROM c LEFT JOIN o_center_tickets USING (center_id)""")
def _(t: Tables) -> DataFrame:
    return ct.kpis(t)


def _by(column: str, where: str = "TRUE") -> str:
    return f"""
SELECT {named(column, 'Unknown')} AS state, COUNT(DISTINCT CenterID) AS devices FROM center_details WHERE {where}
GROUP BY 1 ORDER BY devices DESC, state LIMIT 12"""


@query("N2_centers_by_state", _by("State"))
def _(t: Tables) -> DataFrame:
    return ct.by_state(t)


@query("N3_centers_by_city_of_state", _by("City", "TRIM(State) = 'State 3'"))
def _(t: Tables) -> DataFrame:
    return ct.by_state_or_city(t, ONE_STATE)


@query("N3_centers_by_state_or_city", _by("State"))
def _(t: Tables) -> DataFrame:
    return ct.by_state_or_city(t)


@query("N4_deployment_age", f"""
SELECT {age_band(f"date_diff('day', birth, {AS_OF})")} AS band, COUNT(*) AS devices FROM o_births GROUP BY 1""")
def _(t: Tables) -> DataFrame:
    return ct.deployment_age(t, TICKETS_AS_OF)


@query("N5_centers_by_segment", f"""
SELECT {segment('hub_master_segment')} AS status, COUNT(DISTINCT CenterID) AS devices FROM center_details
GROUP BY 1 ORDER BY devices DESC, status LIMIT 12""")
def _(t: Tables) -> DataFrame:
    return ct.by_segment(t)


@query("N6_totals", "SELECT COUNT(DISTINCT CenterID) AS centers, COUNT(DISTINCT HubID) AS hubs FROM center_details")
def _(t: Tables) -> DataFrame:
    return ct.totals(t)


@query("N6_totals_filtered", """
SELECT COUNT(DISTINCT CenterID) AS centers, COUNT(DISTINCT HubID) AS hubs FROM center_details
WHERE TRIM(Billable) IN ('YES', 'NO') AND deploymentdate BETWEEN DATE '1995-06-01' AND DATE '1998-06-30'""")
def _(t: Tables) -> DataFrame:
    return ct.totals(t, PAID)


def _six(entity: str, key: str, dim: str, expression: str, limit: str = "") -> str:
    return f"""(SELECT '{entity}' AS entity, '{dim}' AS dim, {expression} AS k, COUNT(DISTINCT {key}) AS n FROM center_details
  GROUP BY 3 ORDER BY n DESC, k {limit})"""


_BREAKDOWN_SQL = (" UNION ALL ".join("SELECT * FROM " + s for s in (
    _six("centers", "CenterID", "status", named("Status", "(blank)")),
    _six("hubs", "HubID", "status", named("Status", "(blank)")),
    _six("centers", "CenterID", "segment", segment("hub_master_segment"), "LIMIT 15"),
    _six("hubs", "HubID", "segment", segment("hub_master_segment"), "LIMIT 15"),
)))


@query("N6_breakdown", _BREAKDOWN_SQL)
def _(t: Tables) -> DataFrame:
    return ct.breakdown(t)


@query("N6_breakdown_merged", _BREAKDOWN_SQL)
def _(t: Tables) -> DataFrame:
    """The same from bitmaps kept per day of deployment."""
    return ct.breakdown_of(ct.breakdown_parts(t))


def _options(column: str, name: str) -> str:
    return f"SELECT DISTINCT TRIM({column}) AS {name} FROM center_details WHERE TRIM({column}) <> ''"


@query("N7_segment_options", f"""
SELECT DISTINCT {segment('hub_master_segment')} AS segment FROM center_details WHERE TRIM(hub_master_segment) <> ''""")
def _(t: Tables) -> DataFrame:
    return options(t.centers, segment_group("hub_master_segment", None), "segment")


@query("N7_state_options", _options("State", "state"))
def _(t: Tables) -> DataFrame:
    return options(t.centers, "State", "state")


@query("N7_city_options", _options("City", "city"))
def _(t: Tables) -> DataFrame:
    return options(t.centers, "City", "city")


@query("N7_country_options", _options("hub_country", "country"))
def _(t: Tables) -> DataFrame:
    return options(t.centers, "hub_country", "country")


@query("N7_machine_type_options", _options("MachineType", "machine_type"))
def _(t: Tables) -> DataFrame:
    return options(t.centers, "MachineType", "machine_type")


@query("N7_device_type_options", "SELECT DISTINCT TRIM(type) AS type FROM o_devices WHERE TRIM(type) <> ''")
def _(t: Tables) -> DataFrame:
    return options(dv.device_index(t, TICKETS_AS_OF), "type", "type")


@query("N7_device_status_options", "SELECT DISTINCT TRIM(status) AS status FROM o_devices WHERE TRIM(status) <> ''")
def _(t: Tables) -> DataFrame:
    return options(dv.device_index(t, TICKETS_AS_OF), "status", "status")


_LISTED = "center_id, center, status, type, segment, hub_id, hub, city, state, pin, deployed, deactivated"


@query("N8_center_listing", f"""
WITH c AS (SELECT DISTINCT CenterID AS center_id, Centername AS center, Status AS status, Type AS type,
    Spoke_Center_Segment AS segment, HubID AS hub_id, HubName AS hub, City AS city, State AS state, PinCode AS pin,
    CAST(CAST(deploymentdate AS DATE) AS VARCHAR) AS deployed, CAST(CAST(deactivationdate AS DATE) AS VARCHAR) AS deactivated
  FROM center_details),
p AS (SELECT * FROM c ORDER BY {', '.join(f'{x} NULLS FIRST' for x in _LISTED.split(', '))} LIMIT 25 OFFSET 50)
SELECT p.*, (SELECT COUNT(*) FROM c) AS total_rows, COALESCE(n, 0) AS devices
FROM p LEFT JOIN (SELECT center_id, COUNT(*) AS n FROM o_devices GROUP BY 1) d USING (center_id)""")
def _(t: Tables) -> DataFrame:
    return ct.listing(t, TICKETS_AS_OF, page=2)


@query("N9_center_profile", f"""
SELECT MIN(Centername) AS center, MIN(HubID) AS hub_id, MIN(HubName) AS hub, MIN(City) AS city, MIN(State) AS state,
  MIN(PinCode) AS pin, MIN(hub_country) AS country, CAST(CAST(MIN(deploymentdate) AS DATE) AS VARCHAR) AS first_deployment,
  date_diff('month', MIN(deploymentdate), CAST({AS_OF} AS DATE)) AS age_months
FROM center_details WHERE CenterID = {CENTER}""")
def _(t: Tables) -> DataFrame:
    return ct.profile(t, TICKETS_AS_OF, CENTER)


@query("N10_window_kpis", """
SELECT COUNT(DISTINCT centerid) AS centers, COUNT(*) AS devices, COUNT(DISTINCT NULLIF(TRIM(state), '')) AS states,
  COUNT(DISTINCT NULLIF(TRIM(city), '')) AS cities, COUNT(*) FILTER (WHERE enddatetime IS NULL) AS active_deployments FROM o_windows""")
def _(t: Tables) -> DataFrame:
    return ct.window_kpis(t)


@query("N10_window_states", f"""
SELECT {named('state', 'Unknown')} AS state, COUNT(*) AS devices FROM o_windows GROUP BY 1 ORDER BY devices DESC, 1 LIMIT 12""")
def _(t: Tables) -> DataFrame:
    return ct.window_states(t)


@query("N10_window_age", f"""
SELECT CASE WHEN d < 90 THEN '<3 mo' WHEN d < 180 THEN '3-6 mo' WHEN d < 365 THEN '6-12 mo' WHEN d < 730 THEN '1-2 yr'
    ELSE '2+ yr' END AS band, COUNT(*) AS devices
FROM (SELECT deviceid, date_diff('day', MAX(startdatetime), {AS_OF}) AS d FROM deployments WHERE enddatetime IS NULL GROUP BY 1)
GROUP BY 1""")
def _(t: Tables) -> DataFrame:
    return ct.window_age(t, TICKETS_AS_OF)


@query("N10_window_status", f"""
SELECT CASE WHEN enddatetime IS NULL OR enddatetime > {AS_OF} THEN 'Active' ELSE 'Ended' END AS status,
  COUNT(DISTINCT deviceid) AS devices FROM deployments GROUP BY 1""")
def _(t: Tables) -> DataFrame:
    return ct.window_status(t, TICKETS_AS_OF)


@query("N10_window_centers", """
SELECT centerid AS center_id, CenterName AS center, hubid AS hub_id, hubname AS hub, city, state, pin, country FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY centerid ORDER BY startdatetime DESC NULLS LAST, CenterName NULLS FIRST,
    hubid NULLS FIRST, hubname NULLS FIRST, city NULLS FIRST, state NULLS FIRST, pin NULLS FIRST, country NULLS FIRST) AS rn
  FROM deployments) WHERE rn = 1""")
def _(t: Tables) -> DataFrame:
    return ct.window_centers(t)


@query("N10_window_profile", f"""
SELECT MIN(CenterName) AS center, MIN(hubid) AS hub_id, MIN(hubname) AS hub, MIN(city) AS city, MIN(state) AS state,
  MIN(pin) AS pin, MIN(country) AS country, strftime(MIN(startdatetime), '%Y-%m-%d') AS first_deployment,
  date_diff('month', MIN(startdatetime), {AS_OF}) AS age_months, COUNT(DISTINCT deviceid) AS devices_ever
FROM deployments WHERE centerid = {CENTER}""")
def _(t: Tables) -> DataFrame:
    return ct.window_profile(t, TICKETS_AS_OF, CENTER)


MART_SQL = f"""SELECT * REPLACE (CAST(deployment_date AS VARCHAR) AS deployment_date, {stamp('last_seen')} AS last_seen) FROM o_center_360"""


@query("N11_center_360", MART_SQL)
def _(t: Tables) -> DataFrame:
    return ct.center_360(t, TICKETS_AS_OF, EVENTS_AS_OF)


@query("N11_center_360_single_row", """
SELECT center_id, MIN(center) AS center, COUNT(*) AS n FROM (
  SELECT DISTINCT ON (center_id) center_id, COALESCE(center, '') AS center FROM o_dimension
  ORDER BY center_id, center NULLS FIRST) GROUP BY center_id""")
def _(t: Tables) -> DataFrame:
    mart = ct.center_360(t, TICKETS_AS_OF, EVENTS_AS_OF, single_row=True)
    return mart.groupBy("center_id").agg(F.min("center").alias("center"), F.count("*").alias("n"))


BROWSED = Filters(segments=("LE", "SME", "ECHO"), statuses=("ACTIVE",), date_from="1995-03-01")


def _explorer(order: str, where: str, offset: int = 0) -> str:
    return f"""
WITH f AS ({MART_SQL} WHERE {where})
SELECT *, (SELECT COUNT(*) FROM f) AS total_rows FROM f ORDER BY {order} LIMIT 15 OFFSET {offset}"""


@query("N12_center_explorer", _explorer(
    "open_tickets DESC NULLS LAST, uptime_pct NULLS LAST, center_id NULLS LAST, city",
    """segment IN ('LE', 'SME', 'ECHO') AND status = 'ACTIVE' AND deployment_date >= '1995-03-01'
    AND (LOWER(center) LIKE '%state 1%' OR CAST(center_id AS VARCHAR) LIKE '%state 1%' OR LOWER(hub) LIKE '%state 1%'
      OR LOWER(state) LIKE '%state 1%')""", 15))
def _(t: Tables) -> DataFrame:
    mart = center_mart(t, TICKETS_AS_OF, EVENTS_AS_OF)
    return ct.explorer(mart, BROWSED, "State 1", "open_tickets", "desc", page=1)


@query("N12_center_explorer_default", _explorer("devices DESC NULLS LAST, center_id NULLS LAST, city", "TRUE"))
def _(t: Tables) -> DataFrame:
    mart = center_mart(t, TICKETS_AS_OF, EVENTS_AS_OF)
    return ct.explorer(mart, sort_by="no such key")
