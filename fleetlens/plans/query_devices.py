"""Device and telemetry queries."""

from __future__ import annotations

from pyspark.sql import DataFrame

from fleetlens.filters import DEFAULT_FILTERS, Filters
from fleetlens.operators import devices as dv
from fleetlens.plans.check_sql import SEEN_AS_OF, age_band, named, stamp, whole
from fleetlens.plans.registry import query
from fleetlens.sources.proxy import EVENTS_AS_OF, TICKETS_AS_OF
from fleetlens.sources.tables import Tables

DEVICE_CENTER = 13
DEVICES_SQL = """SELECT key, summary, serial, type, category, status, CAST(birthday AS VARCHAR) AS birthday, age_days, center_id,
  issuetype_name, status_name
FROM o_devices"""
CHOSEN = Filters(
    segments=("LE", "SME"), device_types=("Connector", "Printer", "UPS"), device_status_exclude=("Decommissioned",),
    date_from="1996-06-01", date_to="2001-01-31",
)
CHOSEN_SQL = """issuetype_name IN ('Connector', 'Printer', 'UPS') AND COALESCE(status_name <> 'Decommissioned', TRUE)
  AND birthday BETWEEN DATE '1996-06-01' AND DATE '2001-01-31'
  AND center_id IN (SELECT center_id FROM o_dimension WHERE segment IN ('LE', 'SME'))"""


@query("D1_device_index", DEVICES_SQL)
def _(t: Tables) -> DataFrame:
    return dv.device_index(t, TICKETS_AS_OF)


@query("D2_center_telemetry", f"""
SELECT center_id, devices, online, {stamp('last_seen')} AS last_seen, avg_csq, avg_battery, low_battery FROM o_telemetry""")
def _(t: Tables) -> DataFrame:
    return dv.center_telemetry(t.heartbeats, EVENTS_AS_OF)


def _fleet(where: str) -> str:
    return f"""
SELECT COUNT(*) AS total, CAST(ROUND(AVG(age_days), 0) AS BIGINT) AS avg_age_days, COUNT(age_days) AS aged_devices,
  COUNT(*) FILTER (WHERE age_days >= 5 * 365) AS past_life FROM o_devices WHERE {where}"""


@query("D3_fleet_stats", _fleet("TRUE"))
def _(t: Tables) -> DataFrame:
    return dv.fleet_stats(dv.filtered_devices(t, TICKETS_AS_OF))


@query("D3_fleet_stats_filtered", _fleet(CHOSEN_SQL))
def _(t: Tables) -> DataFrame:
    return dv.fleet_stats(dv.filtered_devices(t, TICKETS_AS_OF, CHOSEN))


@query("D3_fleet_status", f"SELECT {named('status', '(blank)')} AS k, COUNT(*) AS n FROM o_devices GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return dv.fleet_status(dv.filtered_devices(t, TICKETS_AS_OF))


@query("D3_fleet_age_bands", f"""
SELECT {age_band('age_days')} AS k, COUNT(*) AS n FROM o_devices WHERE age_days IS NOT NULL GROUP BY 1""")
def _(t: Tables) -> DataFrame:
    return dv.fleet_age_bands(dv.filtered_devices(t, TICKETS_AS_OF))


@query("D4_status_and_type_counts", f"""
SELECT 'status' AS dim, {named('status', '(blank)')} AS label, COUNT(*) AS cnt FROM o_devices GROUP BY 2
UNION ALL SELECT 'type', type, COUNT(*) FROM o_devices GROUP BY 2""")
def _(t: Tables) -> DataFrame:
    return dv.status_and_type_counts(dv.filtered_devices(t, TICKETS_AS_OF))


@query("D5_batch_cohorts", """
WITH d AS (SELECT YEAR(birthday) AS batch_year, f.*,
    CASE WHEN first_fail > birthday THEN CAST(FLOOR(date_diff('second', CAST(birthday AS TIMESTAMP), first_fail) / 86400) AS BIGINT) END AS ttff
  FROM o_devices LEFT JOIN o_center_failures f ON center_id = cid WHERE birthday IS NOT NULL),
top AS (SELECT batch_year, top_cat, ROW_NUMBER() OVER (PARTITION BY batch_year ORDER BY COUNT(*) DESC, top_cat) AS rn
  FROM d WHERE top_cat <> '' GROUP BY 1, 2)
SELECT d.batch_year, COUNT(*) AS devices, ROUND(COUNT(first_fail) / COUNT(*) * 100, 1) AS ftf_rate_pct,
  CAST(ROUND(quantile_cont(ttff, 0.5), 0) AS BIGINT) AS median_ttff_days, COUNT(*) FILTER (WHERE ttff < 7) AS early_fails,
  ROUND(CAST(COALESCE(SUM(n_fail), 0) AS DOUBLE) / COUNT(*), 2) AS avg_failures, COALESCE(MIN(t.top_cat), '') AS top_issue
FROM d LEFT JOIN top t ON d.batch_year = t.batch_year AND rn = 1 GROUP BY d.batch_year""")
def _(t: Tables) -> DataFrame:
    return dv.cohorts(t, TICKETS_AS_OF)


@query("D6_devices_per_center", """
SELECT center_id, COUNT(*) AS register_devices FROM o_devices WHERE center_id IS NOT NULL GROUP BY center_id""")
def _(t: Tables) -> DataFrame:
    return dv.per_center(dv.device_index(t, TICKETS_AS_OF))


_BATTERY = whole("CASE WHEN UPPER(BatteryLevel) <> 'CHARGING' THEN BatteryLevel END")
_SEEN, _LISTED = "NULLIF(TRIM(hardwareversion_clouddevices), '')", "NULLIF(TRIM(hardwareversion_devicestable), '')"


def _telemetry(where: str = "TRUE") -> str:
    return f"""
SELECT COUNT(*) AS total, COUNT(*) FILTER (WHERE LastTimeStamp >= {SEEN_AS_OF} - INTERVAL 24 HOUR) AS online,
  ROUND(AVG({whole('CSQ')}), 1) AS avg_csq, COUNT(*) FILTER (WHERE {_BATTERY} < 20) AS low_battery,
  ROUND(AVG(TRY_CAST(Latency AS DOUBLE)), 1) AS avg_latency, COUNT(TRY_CAST(Latency AS DOUBLE)) AS latency_reporting,
  ROUND(AVG({whole('Retries')}), 1) AS avg_retries, CAST(COALESCE(SUM({whole('UnsyncedData')}), 0) AS BIGINT) AS unsynced_total,
  ROUND(AVG(TRY_CAST(SpaceAvailable AS DOUBLE)), 0) AS avg_space, COUNT(TRY_CAST(SpaceAvailable AS DOUBLE)) AS space_reporting,
  COUNT(*) FILTER (WHERE {_SEEN} <> {_LISTED}) AS hw_mismatch,
  COUNT(*) FILTER (WHERE {_SEEN} IS NOT NULL AND {_LISTED} IS NOT NULL) AS hw_both_reporting
FROM heartbeats WHERE {where}"""


@query("D7_telemetry_kpis", _telemetry())
def _(t: Tables) -> DataFrame:
    return dv.telemetry_kpis(t, EVENTS_AS_OF)


@query("D7_telemetry_kpis_filtered", _telemetry(
    "CenterID IN (SELECT CenterID FROM center_details WHERE TRIM(Status) = 'ACTIVE')"))
def _(t: Tables) -> DataFrame:
    return dv.telemetry_kpis(t, EVENTS_AS_OF, DEFAULT_FILTERS)


@query("D8_signal_buckets", f"""
SELECT CASE WHEN c IS NULL THEN 'Unknown' WHEN c < 10 THEN 'Poor' WHEN c < 20 THEN 'Fair' WHEN c < 30 THEN 'Good' ELSE 'Excellent' END
  AS k, COUNT(*) AS n FROM (SELECT {whole('CSQ')} AS c FROM heartbeats) GROUP BY 1""")
def _(t: Tables) -> DataFrame:
    return dv.signal_buckets(t)


@query("D9_battery_buckets", f"""
SELECT CASE WHEN UPPER(COALESCE(BatteryLevel, '')) = 'CHARGING' THEN 'Charging' WHEN {whole('BatteryLevel')} IS NULL THEN 'Unknown'
  WHEN {whole('BatteryLevel')} < 20 THEN 'Low' ELSE 'Normal' END AS k, COUNT(*) AS n FROM heartbeats GROUP BY 1""")
def _(t: Tables) -> DataFrame:
    return dv.battery_buckets(t)


@query("D10_hardware_versions", f"""
SELECT {named('hardwareversion_clouddevices', 'Unknown')} AS hw, COUNT(*) AS devices FROM heartbeats GROUP BY 1
ORDER BY devices DESC, hw LIMIT 8""")
def _(t: Tables) -> DataFrame:
    return dv.hardware_versions(t)


@query("D11_counter_buckets", f"""
SELECT CASE WHEN c = 0 THEN '0' WHEN c <= 5 THEN '1-5' WHEN c <= 20 THEN '6-20' ELSE '21+' END AS k, COUNT(*) AS n
FROM (SELECT {whole('EcgCounter')} AS c FROM heartbeats) WHERE c IS NOT NULL GROUP BY 1""")
def _(t: Tables) -> DataFrame:
    return dv.counter_buckets(t)


RECENCY_SQL = f"""CASE WHEN LastTimeStamp IS NULL OR LastTimeStamp < TIMESTAMP '2000-01-01' THEN 'Never seen'
  WHEN LastTimeStamp >= {SEEN_AS_OF} - INTERVAL 1 HOUR THEN 'Live (<1h)'
  WHEN LastTimeStamp >= {SEEN_AS_OF} - INTERVAL 24 HOUR THEN 'Online (<24h)'
  WHEN LastTimeStamp >= {SEEN_AS_OF} - INTERVAL 7 DAY THEN 'Idle (1-7d)'
  WHEN LastTimeStamp >= {SEEN_AS_OF} - INTERVAL 30 DAY THEN 'Offline (7-30d)' ELSE 'Dark (>30d)' END"""
EXPLORED_SQL = f"""
SELECT DeviceID AS device, COALESCE(Centername, '') AS center, COALESCE(HubName, '') AS hub, {stamp('LastTimeStamp')} AS last_seen,
  COALESCE(BatteryLevel, '') AS battery, {whole('CSQ')} AS csq, TRY_CAST(Latency AS DOUBLE) AS latency,
  {whole('Retries')} AS retries, TRY_CAST(SpaceAvailable AS DOUBLE) AS space_avail, {whole('EcgCounter')} AS ecg,
  {whole('UnsyncedData')} AS unsynced, {named('hardwareversion_clouddevices', 'Unknown')} AS hardware,
  {named('hardwareversion_devicestable', '')} AS hardware_dt, {RECENCY_SQL} AS status"""
_TIES = ", ".join(f"{c} NULLS FIRST" for c in ("device", "last_seen", "csq", "battery", "latency", "retries"))


@query("D12_telemetry_explorer", f"""
WITH r AS ({EXPLORED_SQL}, LastTimeStamp AS ts FROM heartbeats)
SELECT * EXCLUDE (ts), (SELECT COUNT(*) FROM r) AS total_rows FROM r ORDER BY ts DESC NULLS LAST, {_TIES} LIMIT 15""")
def _(t: Tables) -> DataFrame:
    return dv.telemetry_explorer(t, EVENTS_AS_OF)


@query("D12_telemetry_explorer_search", f"""
WITH r AS ({EXPLORED_SQL}, {whole('BatteryLevel')} AS b FROM heartbeats WHERE LOWER(COALESCE(DeviceID, '')) LIKE '%7%'
  OR LOWER(COALESCE(Centername, '')) LIKE '%7%' OR LOWER(COALESCE(HubName, '')) LIKE '%7%')
SELECT * EXCLUDE (b), (SELECT COUNT(*) FROM r) AS total_rows FROM r ORDER BY b NULLS FIRST, {_TIES} LIMIT 40 OFFSET 40""")
def _(t: Tables) -> DataFrame:
    return dv.telemetry_explorer(t, EVENTS_AS_OF, search="7", sort_by="battery", sort_dir="asc", page=1, size=40)


@query("D13_center_devices", f"""{DEVICES_SQL} WHERE center_id = {DEVICE_CENTER} ORDER BY COALESCE(age_days, 0) DESC, key LIMIT 100""")
def _(t: Tables) -> DataFrame:
    return dv.center_devices(t, TICKETS_AS_OF, DEVICE_CENTER)


@query("D14_filtered_devices", f"{DEVICES_SQL} WHERE {CHOSEN_SQL}")
def _(t: Tables) -> DataFrame:
    return dv.filtered_devices(t, TICKETS_AS_OF, CHOSEN)


# 'Other' is what a device without a type is shown as; as a filter it means devices registered under that type.
@query("D14_filtered_devices_other", f"""{DEVICES_SQL}
WHERE issuetype_name IN ('Other', 'UPS') AND COALESCE(status_name NOT IN ('Deployed', 'Decommissioned'), TRUE)""")
def _(t: Tables) -> DataFrame:
    chosen = Filters(device_types=("Other", "UPS"), device_status_exclude=("Deployed", "Decommissioned"))
    return dv.filtered_devices(t, TICKETS_AS_OF, chosen)
