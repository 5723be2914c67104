"""Rollup, account and geography queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.filters import DEFAULT_FILTERS, Filters
from fleetlens.operators import devices as dv
from fleetlens.operators import geo, rollups
from fleetlens.functions.text import label
from fleetlens.plans.check_sql import age_band, clean, is_open, named
from fleetlens.plans.marts import center_mart, located_mart, with_ticket_marts
from fleetlens.plans.query_tickets import ACCOUNT_STATS_SQL
from fleetlens.plans.registry import query
from fleetlens.sources.cleaned import center_dimension
from fleetlens.sources.proxy import EVENTS_AS_OF, TICKETS_AS_OF
from fleetlens.sources.tables import Tables


def _mart(t: Tables) -> DataFrame:
    return center_mart(t, TICKETS_AS_OF, EVENTS_AS_OF)


def _located(t: Tables) -> DataFrame:
    return located_mart(t, TICKETS_AS_OF, EVENTS_AS_OF)


_COUNTRY = named("country", "(blank)")


@query("R1_top_plus_others", f"""
WITH c AS (SELECT {named('hub_country', '(blank)')} AS k, COUNT(*) AS n FROM center_details GROUP BY 1),
r AS (SELECT *, ROW_NUMBER() OVER (ORDER BY n DESC, k) > 5 AS is_other FROM c)
SELECT CASE WHEN is_other THEN 'Others' ELSE k END AS key, is_other, CAST(SUM(n) AS BIGINT) AS cnt FROM r GROUP BY 1, 2""")
def _(t: Tables) -> DataFrame:
    counts = t.centers.groupBy(label("hub_country", "(blank)").alias("k")).agg(F.count("*").alias("n"))
    return rollups.top_plus_others(counts, "k", "n")


def _stats(keys: str, source: str) -> str:
    """Node statistics by their definition, one node at a time."""
    return f"""
SELECT {keys}, COUNT(*) AS value, CAST(SUM(register_devices) AS BIGINT) AS devices, CAST(SUM(open_tickets) AS BIGINT) AS open_tickets,
  ROUND(AVG(uptime_pct), 1) AS uptime_pct,
  COALESCE((list(city ORDER BY city_n DESC, city) FILTER (WHERE city <> ''))[1], '') AS top_city
FROM (SELECT *, COUNT(*) OVER (PARTITION BY {keys}, city) AS city_n FROM {source}) GROUP BY {keys}"""


@query("R2_node_stats", f"WITH m AS (SELECT *, country AS node FROM o_center_360) {_stats('node', 'm')}")
def _(t: Tables) -> DataFrame:
    return rollups.node_stats(rollups.center_cells(_mart(t).withColumnRenamed("country", "node"), "node"), ["node"])


@query("R3_customers_tree", f"""
WITH m AS (SELECT * REPLACE ({_COUNTRY} AS country) FROM o_center_360),
r AS (SELECT country AS c, ROW_NUMBER() OVER (ORDER BY COUNT(*) DESC, country) > 5 AS is_other FROM m GROUP BY 1),
b AS (SELECT m.* REPLACE (CASE WHEN is_other THEN 'Others' ELSE country END AS country), is_other AS other FROM m JOIN r ON country = c),
n AS (SELECT 0 AS level, '' AS nc, '' AS ns, FALSE AS o, * FROM b UNION ALL SELECT 1, country, '', other, * FROM b
  UNION ALL SELECT 2, country, segment, other, * FROM b WHERE NOT other),
s AS ({_stats('level, nc, ns, o', 'n')})
SELECT level, nc AS country, ns AS segment, o AS is_other, value, devices, open_tickets, uptime_pct, top_city FROM s""")
def _(t: Tables) -> DataFrame:
    return rollups.customers_tree(_mart(t))


@query("R4_devices_tree", f"""
WITH d AS (SELECT type, {age_band('age_days')} AS band FROM o_devices)
SELECT 0 AS level, '' AS type, '' AS band, COUNT(*) AS value FROM d
UNION ALL SELECT 1, type, '', COUNT(*) FROM d GROUP BY type
UNION ALL SELECT 2, type, band, COUNT(*) FROM d WHERE band IS NOT NULL GROUP BY type, band""")
def _(t: Tables) -> DataFrame:
    return rollups.devices_tree_for(t, TICKETS_AS_OF)


@query("R5_tickets_tree", f"""
WITH z AS (SELECT COUNT(*) AS total, COUNT(*) FILTER (WHERE {is_open()}) AS open FROM o_cleaned),
e AS (SELECT COUNT(*) FILTER (WHERE {clean('remarks')} IN ('Issue Resolved', 'Auto Resolved')) AS r,
  COUNT(*) FILTER (WHERE {clean('remarks')} IN ('Not resolved', 'No response')) AS u, COUNT(*) AS n FROM escalations),
l AS (SELECT 'Support' AS source, 'Open' AS outcome, open AS value FROM z UNION ALL SELECT 'Support', 'Closed', total - open FROM z
  UNION ALL SELECT 'Field service', {named('closure_type', 'Unknown')}, COUNT(*) FROM field_service GROUP BY 2
  UNION ALL SELECT 'Escalations', 'Resolved', r FROM e UNION ALL SELECT 'Escalations', 'Unresolved', u FROM e
  UNION ALL SELECT 'Escalations', 'Visit needed', n - r - u FROM e)
SELECT 2 AS level, source, outcome, value FROM l
UNION ALL SELECT 1, source, '', CAST(SUM(value) AS BIGINT) FROM l GROUP BY source
UNION ALL SELECT 0, '', '', CAST(SUM(value) AS BIGINT) FROM l""")
def _(t: Tables) -> DataFrame:
    return rollups.tickets_tree(t)


ACCOUNTS_SQL = """
SELECT h.account, h.tier, COALESCE(centers, 0) AS centers, COALESCE(devices, 0) AS devices, COALESCE(open_tickets, 0) AS open_tickets,
  COALESCE(located, 0) AS located, COALESCE(assets, 0) AS assets
FROM (SELECT DISTINCT account, tier FROM o_hubs) h LEFT JOIN (
  SELECT account, CAST(SUM(n) AS BIGINT) AS centers, CAST(SUM(d) AS BIGINT) AS devices, CAST(SUM(o) AS BIGINT) AS open_tickets,
    CAST(SUM(l) AS BIGINT) AS located, CAST(SUM(a) AS BIGINT) AS assets
  FROM (SELECT account, center_id, COUNT(*) AS n, SUM(register_devices) AS d, SUM(open_tickets) AS o, COUNT(lat) AS l,
      MAX(register_devices) AS a FROM o_placed p JOIN o_hubs u ON p.hub_id = u.hub_id GROUP BY 1, 2) GROUP BY account) a
ON h.account = a.account"""


@query("R6_accounts", ACCOUNTS_SQL)
def _(t: Tables) -> DataFrame:
    return rollups.accounts(_located(t), None)


@query("R6_account_totals", f"""
WITH a AS ({ACCOUNTS_SQL}), s AS ({ACCOUNT_STATS_SQL})
SELECT COUNT(*) AS customers, CAST(SUM(centers) AS BIGINT) AS centers, CAST(SUM(devices) AS BIGINT) AS devices,
  CAST(SUM(open_tickets) AS BIGINT) AS open_tickets, CAST(SUM(assets) AS BIGINT) AS assets,
  COUNT(*) FILTER (WHERE centers > 0) AS with_data, MIN(total_tickets) AS ticket_count, MIN(sla_breach) AS sla_breach,
  MIN(sla_within_pct) AS sla_within_pct FROM a CROSS JOIN s""")
def _(t: Tables) -> DataFrame:
    marts = with_ticket_marts(t)  # the center mart reads the cleaned tickets too
    return rollups.account_totals(marts, _located(marts), None, TICKETS_AS_OF)


@query("G1_distinct_locations", "SELECT * FROM o_locations")
def _(t: Tables) -> DataFrame:
    return geo.distinct_locations(t.centers)


@query("G2_unresolved_locations", "SELECT * FROM o_locations WHERE key NOT IN (SELECT key FROM geo_store)")
def _(t: Tables) -> DataFrame:
    return geo.unresolved_locations(t.centers, t.geo_store)


@query("G3_coverage", """
SELECT COUNT(*) FILTER (WHERE value <> 'x') AS located, COUNT(*) FILTER (WHERE value = 'x') AS failed,
  COUNT(*) FILTER (WHERE value IS NULL) AS pending, COUNT(*) AS total FROM o_locations l LEFT JOIN o_store s ON l.key = s.key""")
def _(t: Tables) -> DataFrame:
    return geo.coverage(t.centers, t.geo_store)


def _points(where: str = "TRUE") -> str:
    return f"""
WITH c AS (SELECT city, state, AVG(lat) AS clat, AVG(lng) AS clng FROM o_placed WHERE lat IS NOT NULL AND city <> '' GROUP BY 1, 2),
h AS (SELECT hub_id, AVG(lat) AS hlat, AVG(lng) AS hlng FROM o_placed WHERE lat IS NOT NULL AND hub_id IS NOT NULL GROUP BY 1),
points AS (SELECT center_id, center, COALESCE(lat, clat, hlat) AS lat, COALESCE(lng, clng, hlng) AS lng, register_devices AS devices,
  open_tickets, hub, p.hub_id, segment, p.state, CASE WHEN p.lat IS NULL THEN 1 ELSE 0 END AS approximate
FROM o_placed p LEFT JOIN c ON p.city = c.city AND p.state = c.state LEFT JOIN h ON p.hub_id = h.hub_id
WHERE COALESCE(p.lat, clat, hlat) IS NOT NULL AND {where})"""


@query("G4_map_points", _points() + " SELECT * FROM points")
def _(t: Tables) -> DataFrame:
    return geo.map_points(_located(t), None)


@query("G4_map_points_filtered", _points("segment = 'LE' AND status = 'ACTIVE'") + " SELECT * FROM points")
def _(t: Tables) -> DataFrame:
    return geo.map_points(_located(t), None, Filters(segments=("LE",), statuses=("ACTIVE",)))


@query("G5_located_devices", _points() + """
SELECT center_id, COALESCE(serial, '') AS serial FROM o_devices WHERE center_id IN (SELECT center_id FROM points)""")
def _(t: Tables) -> DataFrame:
    dimension = center_dimension(t.centers)
    return geo.located_devices(dv.device_index(t, TICKETS_AS_OF), geo.locate(dimension, t.geo_store, dimension))


@query("G6_telemetry_points", """
SELECT center_id, center, lat, lng, devices, online, low_battery, avg_csq, hub, hub_id, state FROM o_placed
WHERE lat IS NOT NULL AND status = 'ACTIVE'""")
def _(t: Tables) -> DataFrame:
    return geo.telemetry_points(_located(t), None, DEFAULT_FILTERS)


@query("G6_unlocated_centers", "SELECT COUNT(lat) AS located, COUNT(*) FILTER (WHERE lat IS NULL) AS unlocated FROM o_placed")
def _(t: Tables) -> DataFrame:
    return geo.unlocated_count(_located(t), None)
