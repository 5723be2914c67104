"""Deterministic stand-ins for the service tables, derived from an order-processing star schema.

Each view is one SELECT in the dialect Spark SQL and DuckDB share; ``@name`` refers to a base table or
to another view. Together they hold the traps the metrics must survive: repeated rows, padded and blank
text, NULL keys, tickets closed before they were created, open tickets, overlapping intervals, numbers
kept as text, 1970 timestamps and serials that resolve to nothing.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from datetime import datetime
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from fleetlens.session import file_bytes as _file_bytes
from fleetlens.sources.tables import Tables

BASE_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

TICKETS_AS_OF = datetime(2001, 8, 2)
EVENTS_AS_OF = datetime(2024, 1, 31)


def _text(value: str) -> str:
    return f"CAST({value} AS STRING)"


def _padded(value: str, width: int) -> str:
    return f"LPAD({_text(value)}, {width}, '0')"


def _segment(k: str) -> str:
    return (
        f"CASE {k} % 9 WHEN 0 THEN 'Private - SME' WHEN 1 THEN 'LE - Cath Lab' WHEN 2 THEN 'le - diagnostic chain' "
        f"WHEN 3 THEN ' Government ' WHEN 4 THEN 'ECHO' WHEN 5 THEN '' WHEN 6 THEN NULL WHEN 7 THEN 'Project' "
        f"ELSE 'LE - Large Hospital' END"
    )


def _hub_id(k: str) -> str:
    return (
        f"CAST(CASE {k} % 100 WHEN 0 THEN 1837 WHEN 1 THEN 2133 WHEN 2 THEN 2314 WHEN 3 THEN 13246 WHEN 4 THEN 1684 "
        f"WHEN 5 THEN 10502 WHEN 6 THEN 50131 WHEN 7 THEN 36772 WHEN 8 THEN 3027 WHEN 9 THEN 1282 WHEN 10 THEN 995 "
        f"WHEN 11 THEN 48763 WHEN 12 THEN NULL ELSE 60000 + {k} % 100 END AS BIGINT)"
    )


def _hub(k: str) -> str:
    return (
        f"CASE WHEN {k} % 100 = 12 THEN ' ' WHEN {k} % 11 = 0 THEN '  Hub ' || {_text(f'{k} % 100')} || ' ' "
        f"ELSE 'Hub ' || {_text(f'{k} % 100')} END"
    )


def _state(k: str) -> str:
    return f"CASE WHEN {k} % 23 = 0 THEN '' WHEN {k} % 29 = 0 THEN NULL ELSE 'State ' || {_text(f'{k} % 17')} END"


def _city(k: str) -> str:
    return f"CASE WHEN {k} % 27 = 0 THEN NULL WHEN {k} % 8 = 3 THEN ' City 7' ELSE 'City ' || {_text(f'{k} % 61')} END"


def _days(later: str, earlier: str) -> str:
    return f"@@days({later}; {earlier})@@"


_CENTER = "c.c_custkey"
_LATEST_EVENT = """
  SELECT event_id, ts, user_id, event_type, value, props,
    user_id * 5 + CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2
      WHEN 'signup' THEN 3 ELSE 4 END AS n
  FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn
        FROM @events) e WHERE rn = 1"""
_CUSTOMERS = "(SELECT COUNT(*) FROM @customer)"

VIEWS = {
    "center_details": f"""
SELECT c.c_custkey AS CenterID,
  CASE WHEN {_CENTER} % 43 = 0 THEN NULL ELSE c.c_name END AS Centername,
  {_hub_id(_CENTER)} AS HubID, {_hub(_CENTER)} AS HubName,
  CASE WHEN c.copy = 1 AND {_CENTER} % 35 = 0 THEN 'City 99' ELSE {_city(_CENTER)} END AS City,
  {_state(_CENTER)} AS State,
  CASE WHEN {_CENTER} % 7 = 0 THEN NULL ELSE {_text(f'560000 + {_CENTER} % 211')} END AS PinCode,
  CASE WHEN {_CENTER} % 31 = 0 THEN NULL WHEN n.n_nationkey % 5 = 0 THEN g.r_name
    WHEN n.n_nationkey = 24 THEN 'Others' ELSE 'Land ' || {_text('n.n_nationkey % 6')} END AS hub_country,
  {_segment(_CENTER)} AS hub_master_segment,
  CASE WHEN {_CENTER} % 4 = 0 THEN 'INACTIVE' WHEN {_CENTER} % 13 = 0 THEN ' ACTIVE '
    WHEN {_CENTER} % 37 = 0 THEN NULL ELSE 'ACTIVE' END AS Status,
  CASE {_CENTER} % 3 WHEN 0 THEN 'YES' WHEN 1 THEN 'NO' ELSE NULL END AS Billable,
  CASE {_CENTER} % 5 WHEN 0 THEN 'Alpha' WHEN 1 THEN 'Beta ' WHEN 2 THEN 'Gamma' WHEN 3 THEN '' ELSE NULL END
    AS MachineType,
  CASE WHEN {_CENTER} % 3 = 0 THEN NULL ELSE 'D1-' || {_padded(_CENTER, 6)} END AS DeviceID,
  CASE WHEN {_CENTER} % 6 = 5 THEN '' ELSE 'm2-' || {_padded(_CENTER, 7)} END AS MacSerialID,
  CASE {_CENTER} % 4 WHEN 0 THEN 'Spoke' WHEN 1 THEN 'Hub' ELSE 'Center' END AS Type,
  CASE WHEN {_CENTER} % 6 = 0 THEN 'F2P_CENTER' ELSE 'PAID' END AS Spoke_Center_Segment,
  CASE WHEN {_CENTER} % 41 = 0 THEN NULL ELSE DATE '1995-01-01' + CAST({_CENTER} % 1500 AS INT) END AS deploymentdate,
  CASE WHEN {_CENTER} % 4 = 0 THEN DATE '2000-01-01' + CAST({_CENTER} % 300 AS INT) END AS deactivationdate
FROM (SELECT *, 0 AS copy FROM @customer UNION ALL SELECT *, 1 AS copy FROM @customer) c
JOIN @nation n ON c.c_nationkey = n.n_nationkey JOIN @region g ON n.n_regionkey = g.r_regionkey""",
    "support_tickets": f"""
SELECT CASE WHEN orderkey % 1009 = 7 THEN NULL ELSE orderkey * 10 + line END AS ticketNumber,
  CASE WHEN part % 997 = 5 THEN NULL ELSE k END AS CenterID, {_hub_id('k')} AS HubID, {_hub('k')} AS HubName,
  {_segment('k')} AS hub_master_segment,
  CASE WHEN part % 401 = 0 THEN NULL ELSE opened END AS CreatedAt,
  CASE WHEN NOT open_now THEN opened + (((part * 7 + quantity * 31) % 480) - 12) * INTERVAL '1' HOUR END AS ClosedAt,
  CASE WHEN open_now THEN CASE part % 5 WHEN 0 THEN 'Open' WHEN 1 THEN 'In Progress' WHEN 2 THEN 'On Hold'
      WHEN 3 THEN NULL ELSE 'Open' END
    WHEN part % 50 = 1 THEN 'Duplicate' WHEN part % 50 = 2 THEN 'Junk' ELSE 'Closed' END AS status,
  CASE part % 14 WHEN 0 THEN 'Battery' WHEN 1 THEN ' machine ISSUE ' WHEN 2 THEN 'Lead cable'
    WHEN 3 THEN 'Billing Query' WHEN 4 THEN 'Report Missing' WHEN 5 THEN 'Duplicate Ticket'
    WHEN 6 THEN 'Temporary swapping' WHEN 7 THEN 'Random Machine Explosion' WHEN 8 THEN 'Data Update Query'
    WHEN 9 THEN '' WHEN 10 THEN NULL WHEN 11 THEN 'Sim card Tray' WHEN 12 THEN 'Expansion Order'
    ELSE 'Product Enhancement/Data Request' END AS IssueCategory,
  CASE WHEN k % 10 = 0 THEN NULL WHEN supp % 40 = 0 THEN '  ' ELSE 'Agent ' || {_text('supp')} END AS assignee,
  CASE line % 4 WHEN 0 THEN 'High' WHEN 1 THEN 'Low' WHEN 2 THEN '' ELSE NULL END AS priority,
  CASE WHEN part % 9 = 0 THEN '' ELSE 'Part ' || {_text('part')} END AS subject,
  CASE WHEN part % 6 = 0 THEN NULL ELSE 'ticket/' || {_text('orderkey')} END AS TicketLink
FROM (SELECT l_orderkey AS orderkey, l_partkey AS part, l_suppkey AS supp, l_linenumber AS line, o_custkey AS k,
        CAST(l_quantity AS BIGINT) AS quantity,
        o_orderdate >= TIMESTAMP '2001-06-01 00:00:00' AND l_partkey % 3 = 0 AS open_now,
        o_orderdate + (l_partkey % 24) * INTERVAL '1' HOUR + (l_suppkey % 60) * INTERVAL '1' MINUTE AS opened
      FROM @lineitem JOIN @orders ON l_orderkey = o_orderkey) t""",
    "heartbeats": f"""
SELECT CASE WHEN n % 53 = 0 THEN NULL WHEN n % 9 = 0 THEN ' d1-' || {_padded('n', 6)} || ' '
    WHEN n % 4 = 1 THEN 'E9-' || {_padded('n', 6)} ELSE 'D1-' || {_padded('n', 6)} END AS DeviceID,
  CASE WHEN n % 20 = 0 THEN NULL ELSE (n * 3) % {_CUSTOMERS} END AS CenterID,
  CASE WHEN n % 14 = 0 THEN NULL ELSE 'Customer ' || {_text('n')} END AS Centername,
  {_hub_id('n')} AS HubID, {_hub('n')} AS HubName,
  CASE WHEN n % 17 = 3 THEN NULL WHEN n % 19 = 5 THEN TIMESTAMP '1970-01-01 05:30:00'
    ELSE ts + INTERVAL '330' MINUTE - ((n % 3) * (n % 45)) * INTERVAL '1' DAY - (n % 24) * INTERVAL '1' HOUR END
    AS LastTimeStamp,
  CASE WHEN n % 12 = 0 THEN 'n/a' WHEN n % 13 = 0 THEN NULL ELSE {_text('CAST(FLOOR(value) AS BIGINT) % 36')} END AS CSQ,
  CASE WHEN n % 6 = 0 THEN 'Charging' WHEN n % 15 = 4 THEN 'CHARGING' WHEN n % 11 = 2 THEN NULL WHEN n % 16 = 1 THEN ''
    ELSE {_text('event_id % 101')} END AS BatteryLevel,
  CASE WHEN n % 5 = 0 THEN NULL ELSE {_text('event_id % 700')} || '.5' END AS Latency,
  CASE WHEN n % 7 = 0 THEN 'none' ELSE {_text('event_id % 9')} END AS Retries,
  CASE WHEN n % 8 = 0 THEN NULL ELSE {_text('event_id % 40')} END AS UnsyncedData,
  CASE WHEN n % 9 = 1 THEN NULL ELSE {_text('1000 + event_id % 4000')} END AS SpaceAvailable,
  CASE WHEN n % 10 < 6 THEN NULL ELSE {_text('event_id % 30')} END AS EcgCounter,
  CASE WHEN n % 18 = 0 THEN ' ' ELSE 'hw-' || {_text('n % 11')} END AS hardwareversion_clouddevices,
  CASE WHEN n % 22 = 0 THEN NULL WHEN n % 10 = 3 THEN 'hw-x' ELSE 'hw-' || {_text('n % 11')} END
    AS hardwareversion_devicestable
FROM ({_LATEST_EVENT}) d""",
    "device_register": f"""
SELECT CASE WHEN p_partkey % 211 = 9 THEN NULL ELSE 'DEV-' || {_text('p_partkey')} END AS issue_key,
  CASE p_partkey % 6 WHEN 0 THEN 'Alpha - D1-' || {_padded(f'p_partkey % {_CUSTOMERS}', 6)}
    WHEN 1 THEN 'beta unit M2-' || {_padded(f'p_partkey % {_CUSTOMERS}', 7)}
    WHEN 2 THEN 'B2-' || {_padded('p_partkey', 7)} WHEN 3 THEN 'no serial here' WHEN 4 THEN NULL
    ELSE '  gamma e9-' || {_padded('p_partkey % 700', 6)} END AS summary,
  CASE WHEN p_partkey % 12 = 5 THEN 'Task' WHEN p_partkey % 18 = 7 THEN ' EPIC ' WHEN p_partkey % 33 = 0 THEN NULL
    WHEN p_type = 'ECONOMY' THEN 'Connector' WHEN p_type = 'PROMO' THEN 'ECG Machine'
    WHEN p_type = 'MEDIUM' THEN 'SIM Card' WHEN p_type = 'STANDARD' THEN 'Printer' ELSE 'UPS' END AS issuetype_name,
  CASE p_partkey % 8 WHEN 0 THEN 'Decommissioned' WHEN 1 THEN ' In Stock' WHEN 2 THEN '' WHEN 3 THEN NULL
    ELSE 'Deployed' END AS status_name,
  {_text('p_partkey % 300')} AS customerid,
  CASE WHEN p_partkey % 37 = 0 THEN NULL ELSE TIMESTAMP '1996-01-01 00:00:00'
    + (p_partkey % 2050) * INTERVAL '1' DAY + (p_partkey % 24) * INTERVAL '1' HOUR END AS ticket_created,
  'Author ' || {_text('l_suppkey')} AS author, l_returnflag AS field_changed, l_linestatus AS to_value
FROM @part LEFT JOIN @lineitem ON p_partkey = l_partkey""",
    "field_service": f"""
SELECT 'FS-' || {_text('o_orderkey')} AS ticket_id,
  CASE WHEN tat IS NULL THEN 'Open' WHEN o_orderkey % 90 = 0 THEN NULL ELSE 'Closed' END AS status,
  CASE o_orderkey % 7 WHEN 0 THEN 'OVERCALL_RESOLUTION' WHEN 1 THEN NULL WHEN 2 THEN ' ' WHEN 3 THEN 'PICKUP'
    ELSE 'CENTER_VISIT' END AS closure_type,
  CASE WHEN o_orderkey % 25 = 0 THEN '' ELSE o_orderpriority || ' ' || {_text('o_orderkey % 3')} END AS service_type,
  CASE WHEN o_orderkey % 26 = 0 THEN NULL ELSE 'Model ' || {_text('o_orderkey % 21')} END AS category,
  CASE WHEN o_custkey % 15 = 0 THEN ' ' ELSE 'Rep ' || {_text('o_custkey % 40')} END AS representative,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 'Product ' || {_text('o_orderkey % 6')} END AS product,
  'Territory ' || {_text('o_custkey % 12')} AS ticket_territory,
  CASE WHEN o_custkey % 21 = 0 THEN NULL ELSE 'Contact ' || {_text('o_custkey')} END AS contact_person_name,
  {_segment('o_custkey')} AS customer_category, {_state('o_custkey')} AS state, {_city('o_custkey')} AS city,
  CASE WHEN o_custkey % 13 = 0 THEN NULL WHEN o_orderkey % 10 = 0 THEN 'C-' || {_text('o_custkey')}
    WHEN o_orderkey % 11 = 0 THEN {_text('o_custkey + 9000000')} ELSE {_text('o_custkey')} END AS customer_id,
  CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE 'D1-' || {_padded('o_custkey', 6)} END AS serial_number,
  CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE '#' || {_text('o_orderkey')} || '-' || {_text('1 + o_orderkey % 8')} END
    AS zoho_ticket,
  CASE WHEN o_orderkey % 9 = 0 THEN 'BREAKDOWN' ELSE 'SERVICE' END AS ticket_type,
  o_orderdate AS created_on, o_orderdate + CAST(FLOOR(tat) AS BIGINT) * INTERVAL '1' DAY AS closed_date,
  CAST(tat AS DOUBLE) AS tat_days_
FROM (SELECT o.*, CASE WHEN o_orderkey % 8 <> 0 THEN {_days('first_ship', 'o_orderdate')} % 60
        + CASE WHEN o_orderkey % 4 = 1 THEN 0.5 ELSE 0.0 END END AS tat
      FROM @orders o LEFT JOIN (SELECT l_orderkey, MIN(l_shipdate) AS first_ship FROM @lineitem GROUP BY l_orderkey) s
        ON o_orderkey = l_orderkey) t""",
    "escalations": f"""
SELECT CASE WHEN user_id % 29 = 0 THEN NULL WHEN event_id % 31 = 0 THEN 'C' || {_text('user_id')}
    ELSE {_text('user_id * 7')} END AS center_id,
  CASE WHEN event_id % 17 = 0 THEN NULL ELSE 'Center ' || {_text('user_id')} END AS center_name,
  'Place ' || {_text('user_id % 30')} AS location,
  CASE WHEN event_id % 6 = 0 THEN NULL ELSE {_text('event_id')} || '-' || {_text('1 + event_id % 7')} END AS zoho_id,
  event_type || ' reported at ' || {_text('event_id % 97')} AS issue,
  CASE WHEN event_id % 23 = 0 THEN ' ' ELSE event_type || ' ' || {_text('event_id % 4')} END AS issue_type,
  CASE WHEN event_id % 19 = 0 THEN NULL ELSE 'Device ' || {_text('event_id % 14')} END AS machine_devicetype,
  CASE WHEN event_id % 15 = 0 THEN '' ELSE 'Reason ' || {_text('event_id % 18')} END AS reason,
  CASE WHEN event_id % 21 = 0 THEN NULL ELSE 'Team ' || {_text('user_id % 16')} END AS cs_team_name_service_team,
  CASE event_id % 8 WHEN 0 THEN 'Issue Resolved' WHEN 1 THEN ' Auto Resolved' WHEN 2 THEN 'Not resolved'
    WHEN 3 THEN 'No response' WHEN 4 THEN '' WHEN 5 THEN NULL WHEN 6 THEN 'Issue Resolved' ELSE 'Visit needed' END
    AS remarks,
  CASE WHEN event_id % 83 = 0 THEN NULL WHEN event_id % 47 = 0 THEN ts
    ELSE CAST(CAST(ts AS DATE) AS TIMESTAMP) END - (event_id % 300) * INTERVAL '1' DAY AS received_date,
  CASE WHEN event_id % 5 <> 0 THEN CAST(CAST(ts AS DATE) AS TIMESTAMP) + (event_id % 20 - 2 - event_id % 300) * INTERVAL '1' DAY
    END AS closed_date,
  CASE WHEN event_id % 5 <> 0 THEN event_id % 20 - 2 END AS tat_days_
FROM @events""",
    "deployments": f"""
SELECT CASE WHEN o_orderkey % 701 = 3 THEN NULL ELSE 'W-' || {_text('o_orderkey % 4001')} END AS deviceid,
  o_custkey AS centerid, {_hub_id('o_custkey')} AS hubid, 'Customer ' || {_text('o_custkey')} AS CenterName,
  {_hub('o_custkey')} AS hubname, {_city('o_custkey')} AS city, {_state('o_custkey')} AS state,
  {_text('560000 + o_custkey % 211')} AS pin, 'Land ' || {_text('o_custkey % 6')} AS country,
  CASE WHEN o_orderkey % 89 = 0 THEN NULL ELSE o_orderdate + (o_custkey % 24) * INTERVAL '1' HOUR END AS startdatetime,
  CASE WHEN o_orderkey % 4 <> 0 THEN o_orderdate + (o_orderkey % 900) * INTERVAL '1' DAY END AS enddatetime
FROM @orders""",
    "geo_store": """
SELECT DISTINCT CASE WHEN pin % 3 = 0 THEN 'old:' ELSE 'p:' END || PinCode || '|' || COALESCE(NULLIF(TRIM(hub_country), ''), 'India') AS key,
  CASE WHEN pin % 9 = 0 THEN 'x' ELSE CAST(8 + pin % 23 AS STRING) || '.25,' || CAST(70 + pin % 19 AS STRING) || '.5' END
    AS value
FROM (SELECT *, CAST(PinCode AS BIGINT) AS pin FROM @center_details WHERE PinCode IS NOT NULL) c""",
    # Sources of the tables above, as their builders read them.
    "source_centers": f"""
SELECT c_custkey AS CenterID, c_name AS Centername, c_custkey % 50 AS HubID, 'Hub ' || {_text('c_custkey % 50')} AS HubName,
  CASE c_custkey % 4 WHEN 0 THEN 'NETWORK_SPOKE' WHEN 1 THEN 'NETWORK_HUB' WHEN 2 THEN 'CENTER' ELSE 'LAB' END AS type,
  CASE WHEN c_custkey % 5 = 0 THEN 'INACTIVE' ELSE 'ACTIVE' END AS Status,
  CASE WHEN c_custkey % 6 = 0 THEN 'F2P_CENTER' WHEN c_custkey % 7 = 0 THEN NULL ELSE 'PAID' END AS Spoke_Center_Segment,
  CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE ' STATE ' || {_text('c_nationkey')} END AS state,
  {_text('560000 + c_custkey % 211')} AS pin, {_city('c_custkey')} AS city, 'Land ' || {_text('c_custkey % 6')} AS Country2,
  CASE WHEN c_custkey % 8 = 0 THEN 'No' ELSE 'Yes' END AS Billable,
  CASE WHEN c_custkey % 20 = 0 THEN DATE '2000-01-01' + CAST(c_custkey % 300 AS INT) END AS deactivationdate, c_custkey % 13 = 0 AS Suspended, c_custkey % 3 = 0 AS IS_PREPAID,
  DATE '1995-01-01' + CAST(c_custkey % 1500 AS INT) AS deploymentdate, c_acctbal AS Current_MRR,
  CASE WHEN c_custkey % 10 = 0 THEN NULL WHEN c_custkey % 33 = 0 THEN 'broken {{'
    ELSE '{{"Master Segment":' || CASE WHEN c_custkey % 3 = 0 THEN 'null' ELSE '"Seg ' || {_text('c_custkey % 5')} || '"' END
      || ',"Service Type":"Svc ' || {_text('c_custkey % 4')} || '","Webhook":' ||
      CASE c_custkey % 3 WHEN 0 THEN '"' || CHR(92) || '"hook' || {_text('c_custkey')} || CHR(92) || '""' WHEN 1 THEN '{{"url":"u"}}' ELSE '"plain text"' END
      || CASE WHEN c_custkey % 4 = 1 THEN '' ELSE ',"Hardware Type":"Own hw ' || {_text('c_custkey % 3')} || '","Hardware Sale Type":"Rent"' END
      || ',"Is Bulk Download Enable":"' || {_text('c_custkey % 2')} || '","Customer Status":"live","Webhook Meta":{{"a":1}},"Patient info hook":"p'
      || {_text('c_custkey % 8')} || '","Patient info hook meta":null,"Transformer Webhook":' || {_text('c_custkey % 6')}
      || ',"ECHO configuration":{{"mode":1}},"disable_rediagnosis":"' || {_text('c_custkey % 2')} || '"}}' END AS customfields
FROM @customer""",
    "source_usage": """
SELECT o_custkey AS CenterID, CAST(o_orderdate AS DATE) AS AcquiredDate, CAST(l_quantity AS BIGINT) AS Number_of_ECGs,
  'D-' || CAST(l_partkey AS STRING) AS DeviceID, 'M-' || CAST(l_suppkey AS STRING) AS MacSerialID,
  l_returnflag AS MachineType
FROM @lineitem JOIN @orders ON l_orderkey = o_orderkey""",
    "source_plans": "SELECT o_custkey AS centerid, CAST(o_orderdate AS DATE) AS startdate FROM @orders",
    "source_preferences": """
SELECT c_custkey AS centerid, CASE WHEN c_custkey % 12 = 0 THEN NULL ELSE '{"doNotAutoSuspend":"' ||
  CAST(c_custkey % 2 AS STRING) || '"' || CASE WHEN c_custkey % 4 = 0 THEN ',"criticalCall":"call ' ||
  CAST(c_custkey % 7 AS STRING) || '"' ELSE '' END || '}' END AS preferences
FROM @customer""",
    "source_config": """
SELECT c_custkey AS centerid, CASE WHEN (c_custkey + id) % 3 = 0 THEN 'UNUSED' ELSE name END AS name,
  CASE id WHEN 0 THEN '{"RESTING":"MODE ' || CAST(c_custkey % 3 AS STRING) || '"}' WHEN 1 THEN 'TYPE ' || CAST(c_custkey % 4 AS STRING)
    ELSE '{"value":"V' || CAST(c_custkey % 6 AS STRING) || '"}' END AS value
FROM (SELECT c_custkey, 0 AS id, 'CASE_SUBMISSION' AS name FROM @customer UNION ALL
  SELECT c_custkey, 1, 'ENABLE_CASES_TYPE' FROM @customer UNION ALL SELECT c_custkey, 2, 'PRODUCT_OFFERING' FROM @customer
  UNION ALL SELECT c_custkey, 3, 'REPORT_TEMPLATE' FROM @customer UNION ALL SELECT c_custkey, 4, 'UNUSED' FROM @customer) n""",
    "source_zones": "SELECT 'State ' || CAST(n_nationkey AS STRING) || ' ' AS state, r_name AS Zone FROM @nation JOIN @region ON n_regionkey = r_regionkey",
    "source_hub_sheet": "SELECT c_custkey AS hubid, 'Hub seg ' || CAST(c_custkey % 4 AS STRING) AS master_segment, 'Hub svc' AS service_type, 'Hub hw' AS hardware_type, 'Sold' AS hardware_sale_type FROM @customer",
    "source_spoke_sheet": "SELECT c_custkey AS centerid, 'Spoke seg ' || CAST(c_custkey % 6 AS STRING) AS master_segment, 'Spoke svc' AS service_type, 'Spoke hw' AS hardware_type FROM @customer",
    "source_hub_names": """
SELECT CASE WHEN s_suppkey % 9 = 0 THEN 'hub ' || CAST(s_suppkey AS STRING) ELSE CAST(s_suppkey AS STRING) END AS hub_id,
  s_name AS organization_name
FROM @supplier""",
    "source_heartbeats": f"""
SELECT 'D1-' || {_padded('n', 6)} AS DeviceID, {_text('CAST(FLOOR(value) AS BIGINT) % 36')} AS CSQ,
  CASE WHEN n % 12 = 0 THEN NULL ELSE SUBSTRING({_text('ts')}, 1, 19) END AS LastTimeStamp,
  CASE WHEN n % 21 = 0 THEN NULL ELSE '{{"BatteryLevel":' || CASE WHEN n % 6 = 0 THEN '"Charging"' ELSE {_text('n % 101')} END
    || ',"LastShutdown":"s' || {_text('n % 3')} || '","BatteryDischarging":"' || {_text('n % 2')} || '","SpaceAvailable":' || {_text('1000 + n')}
    || ',"EcgCounter":"' || {_text('n % 30')} || '","Retries":"' || {_text('n % 9')} || '","Latency":"' || {_text('n % 700')} || '"}}' END AS lastHeartbeatData,
  'imsi ' || {_text('n')} AS IMSI, CASE WHEN n % 5 = 0 THEN NULL ELSE 'net ' || {_text('n % 4')} END AS ServiceProvider,
  {_text('n % 90')} AS PreviousHBLatency, CASE WHEN n % 16 = 0 THEN NULL ELSE {_text('n % 40')} END AS UnsyncedData,
  'hw-' || {_text('n % 11')} AS hardwareversion, 'fw-' || {_text('n % 5')} AS FirmwareName
FROM ({_LATEST_EVENT}) d""",
    "source_devices": f"""
SELECT CASE WHEN n % 8 = 3 THEN 'X1-' ELSE 'D1-' END || {_padded('n', 6)} AS deviceid, CASE WHEN n % 14 = 0 THEN 'none' ELSE {_text(f'(n * 3) % {_CUSTOMERS}')} END AS centerid,
  'hw-' || {_text('n % 10')} AS hardwareversion
FROM ({_LATEST_EVENT}) d""",
    "source_issues": """
SELECT 'P' || CAST(p_partkey % 3 AS STRING) AS project_key, 'DEV-' || CAST(p_partkey AS STRING) AS issue_key,
  p_name AS summary, p_type AS issuetype_name
FROM @part""",
    "source_changelog": """
SELECT 'P' || CAST(l_partkey % 3 AS STRING) AS project_key,
  CASE WHEN l_partkey % 11 = 0 THEN 'OLD-' ELSE 'DEV-' END || CAST(l_partkey AS STRING) AS issue_key, 'Author ' || CAST(l_suppkey AS STRING) AS author, l_returnflag AS field_changed, l_linestatus AS to_value
FROM @lineitem""",
    "source_members": """
SELECT CASE WHEN s_suppkey % 7 = 0 THEN 'm' || CAST(s_suppkey AS STRING) ELSE CAST(s_suppkey AS STRING) END AS member_id,
  s_nationkey AS organization_id
FROM @supplier""",
    "source_organizations": "SELECT n_nationkey AS organization_id, 'Org ' || n_name AS organization_name FROM @nation",
    "source_managers": "SELECT CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE s_suppkey END AS hub_id, s_name AS account_manager, 'Grp ' || CAST(s_nationkey AS STRING) AS grp, 'Sales ' || CAST(s_nationkey AS STRING) AS sales_manager, 'Offer ' || CAST(s_suppkey % 4 AS STRING) AS offering, 'Sheet ' || CAST(s_suppkey % 2 AS STRING) AS segment, s_suppkey % 5 AS vcardia, s_suppkey % 6 AS mac, s_suppkey % 7 AS tr, s_suppkey % 18 AS total_units, s_suppkey % 4 AS inactive_units, s_suppkey % 14 AS active_units FROM @supplier",
}

_REFERENCE = re.compile(r"@([a-z_]+)")
_DAYS = re.compile(r"@@days\(([^;]+); ([^)]+)\)@@")


def dependencies(name: str) -> list[str]:
    """Views ``name`` rests on, itself last."""
    found: list[str] = []
    for inner in _REFERENCE.findall(_DAYS.sub("", VIEWS[name])):
        if inner in VIEWS:
            found += [d for d in dependencies(inner) if d not in found]
    return [*found, name]


def duckdb_view(name: str) -> str:
    text = _DAYS.sub(r"date_diff('day', CAST(\2 AS DATE), CAST(\1 AS DATE))", VIEWS[name])
    return _REFERENCE.sub(r"\1", text)


_SCHEMAS: dict[str, T.StructType] = {}


def _base_table(spark: SparkSession, path: str) -> DataFrame:
    """A test table. Its schema is looked up once per process, which saves a footer job per query."""
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


# Tickets are narrow until orders and lines are joined, and wide after: a task that joins the bytes a task usually gets
# would hold, and sort, many times as many. Above DEALT_FROM bytes of lines a task joins JOINED_BYTES of them.
JOINED_BYTES = 8 << 20
DEALT_FROM = 64 << 20
_JOINED_ON = {"support_tickets": {"lineitem": "l_orderkey", "orders": "o_orderkey"}}


def _loader(spark: SparkSession, folder: str) -> Callable[[str], DataFrame]:
    @cache
    def load(name: str) -> DataFrame:
        if name in BASE_TABLES:
            return _base_table(spark, f"{folder}/{name}.parquet")
        text = _DAYS.sub(r"datediff(\1, \2)", VIEWS[name])
        inputs = {n: load(n) for n in sorted(set(_REFERENCE.findall(text)))}
        keys = _JOINED_ON.get(name, {})
        joined = max((_file_bytes(spark, f"{folder}/{n}.parquet") for n in keys), default=0)
        if joined > DEALT_FROM:  # a number of parts of our own is one that adaptive execution leaves alone
            inputs |= {n: inputs[n].repartition(-(-joined // JOINED_BYTES), key) for n, key in keys.items()}
        return spark.sql(_REFERENCE.sub(r"{\1}", text.replace("{", "{{").replace("}", "}}")), **inputs)

    return load


def view(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A base table or one of the views, over the tables in ``folder``."""
    return _loader(spark, folder)(name)


def proxy_tables(spark: SparkSession, folder: str) -> Tables:
    """The logical tables over ``folder``; each base table is opened once."""
    return Tables(spark, _loader(spark, folder))
