"""Hand-computed results the metrics must reproduce."""

from __future__ import annotations

from datetime import date, datetime


from fleetlens.filters import Filters
from fleetlens.functions import classify as cl
from fleetlens.functions import time as tm
from fleetlens.functions.text import model_of
from fleetlens.operators import devices as dv
from fleetlens.operators import rollups
from fleetlens.operators import tickets as tk
from fleetlens.sources.tables import Tables
from helpers import CENTER_SCHEMA, HEARTBEAT_SCHEMA, REGISTER_SCHEMA, frame, rows

AS_OF = datetime(2026, 8, 1)


def test_status_and_type_counts(spark):
    devices = spark.createDataFrame(
        [("Open", "Connector")] * 3 + [("Closed", "ECG Machine")] * 2 + [("", "Other")], "status string, type string")
    assert rows(dv.status_and_type_counts(devices)) == sorted([
        ("status", "Open", 3), ("status", "Closed", 2), ("status", "(blank)", 1),
        ("type", "Connector", 3), ("type", "ECG Machine", 2), ("type", "Other", 1)])


def test_batch_cohort(spark):
    devices = spark.createDataFrame(
        [(date(2024, 1, 1), 1), (date(2024, 6, 15), 2), (None, 1)], "birthday date, center_id bigint")
    failures = spark.createDataFrame(
        [(1, datetime(2024, 1, 5), 3, "Battery")], "cid bigint, first_fail timestamp_ntz, n_fail bigint, top_cat string")
    assert [tuple(r) for r in dv.batch_cohorts(devices, failures).collect()] == [(2024, 2, 50.0, 4, 1, 1.5, "Battery")]


def test_cohort_failure_before_birth_counts_as_failed_only(spark):
    devices = spark.createDataFrame([(date(2024, 3, 1), 1)], "birthday date, center_id bigint")
    failures = spark.createDataFrame(
        [(1, datetime(2024, 1, 5), 2, "Display")], "cid bigint, first_fail timestamp_ntz, n_fail bigint, top_cat string")
    assert [tuple(r) for r in dv.batch_cohorts(devices, failures).collect()] == [(2024, 1, 100.0, None, 0, 2.0, "Display")]


def _register_tables(spark) -> Tables:
    def issue(key, summary, kind, created):
        return {"issue_key": key, "summary": summary, "issuetype_name": kind, "status_name": "Deployed",
                "ticket_created": datetime.fromisoformat(created)}

    register = frame(
        spark, REGISTER_SCHEMA,
        issue("D-1", "Alpha - A1-AAAAAA1", "Connector", "2026-03-10 09:00:00"),
        issue("D-1", "Alpha - A1-AAAAAA1", "Connector", "2026-03-10 09:00:00"),
        issue("D-2", "Alpha - B2-BBBBBB2", "ECG Machine", "2026-06-15 09:00:00"),
        issue("D-3", "no serial here", "Connector", "2026-06-20 09:00:00"),
        issue("T-9", "Alpha - C3-CCCCCC3", "Task", "2026-06-21 09:00:00"))
    heartbeats = frame(spark, HEARTBEAT_SCHEMA, {"DeviceID": " a1-aaaaaa1 ", "CenterID": 1}, {"DeviceID": "B2-BBBBBB2", "CenterID": 2})
    common = {"hub_country": "India"}
    centers = frame(
        spark, CENTER_SCHEMA,
        {"CenterID": 1, "hub_master_segment": "LE", "Status": "ACTIVE", "State": "Karnataka", "HubName": "H1", "City": "Bengaluru",
         "deploymentdate": date(2024, 1, 1), "DeviceID": "B2-BBBBBB2", **common},
        {"CenterID": 2, "hub_master_segment": "SME", "Status": "INACTIVE", "State": "Kerala", "HubName": "H2", "City": "Kochi",
         "deploymentdate": date(2024, 2, 1), "MacSerialID": "Z9-ZZZZZZ9", **common})
    return Tables.from_frames(spark, {"device_register": register, "heartbeats": heartbeats, "center_details": centers})


def _keys(t: Tables, **chosen) -> list[str]:
    return [k for (k,) in rows(dv.filtered_devices(t, AS_OF, Filters(**chosen)), "key")]


def test_device_filter_chain(spark):
    t = _register_tables(spark)
    assert _keys(t) == ["D-1", "D-2", "D-3"]
    assert _keys(t, segments=("LE",)) == ["D-1"]
    assert _keys(t, statuses=("INACTIVE",)) == ["D-2"]
    assert _keys(t, centers=("2",)) == ["D-2"]
    assert _keys(t, cities=("Kochi",), segments=("LE",)) == []
    assert _keys(t, device_types=("Connector",)) == ["D-1", "D-3"]
    assert _keys(t, device_status_exclude=("Deployed",)) == []
    assert _keys(t, device_types=("Other",)) == []
    assert _keys(t, date_from="2026-06-01") == ["D-2", "D-3"]
    assert _keys(t, date_from="2026-06-01", date_to="2026-06-15") == ["D-2"]


def test_device_filters_look_at_registered_values(spark):
    common = {"ticket_created": datetime(2026, 1, 1)}
    register = frame(
        spark, REGISTER_SCHEMA,
        {"issue_key": "D-1", "summary": "a", "issuetype_name": None, "status_name": "Deployed ", **common},
        {"issue_key": "D-2", "summary": "b", "issuetype_name": "Other", "status_name": None, **common},
        {"issue_key": "", "summary": "by summary", "issuetype_name": "Connector", "status_name": "Deployed", **common},
        {"issue_key": "", "summary": None, "issuetype_name": "Connector", "status_name": "Deployed", **common})
    t = Tables.from_frames(spark, {
        "device_register": register, "heartbeats": frame(spark, HEARTBEAT_SCHEMA), "center_details": frame(spark, CENTER_SCHEMA)})
    assert _keys(t) == ["D-1", "D-2", "by summary"]
    assert _keys(t, device_types=("Other",)) == ["D-2"]
    assert _keys(t, device_status_exclude=("Deployed",)) == ["D-1", "D-2"]


def test_serials_prefer_heartbeats(spark):
    t = _register_tables(spark)
    assert rows(dv.serial_map(t.heartbeats, t.centers)) == [("A1-AAAAAA1", 1), ("B2-BBBBBB2", 2), ("Z9-ZZZZZZ9", 2)]
    bare = t.centers.drop("MacSerialID", "DeviceID")
    assert rows(dv.serial_map(t.heartbeats, bare)) == [("A1-AAAAAA1", 1), ("B2-BBBBBB2", 2)]


def _mart(spark, *cells):
    schema = "center_id bigint, country string, segment string, city string, register_devices bigint, uptime_pct double, open_tickets bigint"
    return spark.createDataFrame(list(cells), schema)


def test_customers_tree(spark):
    mart = _mart(
        spark, (1, "India", "SME", "Pune", 10, 98.0, 1), (2, "India", "SME", "Pune", 8, 96.0, 0),
        (3, "India", "LE", "Mumbai", 40, 99.0, 3), (4, "Nepal", "Government", "Kathmandu", 5, 90.0, 0))
    tree = rows(rollups.customers_tree(mart), "level", "country", "segment", "value", "devices", "open_tickets", "uptime_pct", "top_city")
    assert tree == [
        (0, "", "", 4, 63, 4, 95.8, "Pune"), (1, "India", "", 3, 58, 4, 97.7, "Pune"), (1, "Nepal", "", 1, 5, 0, 90.0, "Kathmandu"),
        (2, "India", "LE", 1, 40, 3, 99.0, "Mumbai"), (2, "India", "SME", 2, 18, 1, 97.0, "Pune"),
        (2, "Nepal", "Government", 1, 5, 0, 90.0, "Kathmandu")]


def test_customers_tree_keeps_a_country_named_like_the_rest(spark):
    cells = [(i, c, "LE", "X", 0, None, 0) for i, c in enumerate(["Others"] * 9 + list("AABBCCDDEFG"))]
    tree = rows(rollups.customers_tree(_mart(spark, *cells)).filter("level = 1"), "country", "is_other", "value")
    assert ("Others", False, 9) in tree and ("Others", True, 3) in tree and len(tree) == 6


def test_devices_tree(spark):
    devices = spark.createDataFrame(
        [("Connector", 100), ("Connector", 800), ("ECG Machine", 2000), ("ECG Machine", 2100), ("ECG Machine", None)],
        "type string, age_days int")
    assert rows(rollups.devices_tree(devices)) == [
        (0, "", "", 5), (1, "Connector", "", 2), (1, "ECG Machine", "", 3),
        (2, "Connector", "2-3y", 1), (2, "Connector", "<1y", 1), (2, "ECG Machine", "5y+", 2)]


def test_age_band_edges(spark):
    df = spark.createDataFrame([(d,) for d in (100, 365, 400, 800, 1500, 2000, None)], "d int").select("d", cl.age_band("d").alias("b"))
    assert {r.d: r.b for r in df.collect()} == {
        100: "<1y", 365: "1-2y", 400: "1-2y", 800: "2-3y", 1500: "3-5y", 2000: "5y+", None: None}


def test_top_plus_others(spark):
    counts = spark.createDataFrame(
        [("India", 100), ("Nepal", 50), ("Bhutan", 40), ("Kenya", 30), ("UAE", 20), ("X", 5), ("Y", 1)], "key string, cnt bigint")
    got = {r.key: r.cnt for r in rollups.top_plus_others(counts, "key", "cnt").collect()}
    assert got == {"India": 100, "Nepal": 50, "Bhutan": 40, "Kenya": 30, "UAE": 20, "Others": 6}
    few = {r.key for r in rollups.top_plus_others(counts.filter("cnt > 15"), "key", "cnt").collect()}
    assert few == {"India", "Nepal", "Bhutan", "Kenya", "UAE"}
    assert rollups.top_plus_others(counts.filter("cnt < 0"), "key", "cnt").count() == 0


def test_sla_record(spark):
    categories = ["Doctor Signature/Qualification Request", "Some Totally Made Up Category", "Random Machine Explosion", None, " bAttEry "]
    df = tk.with_sla(spark.createDataFrame([(c,) for c in categories], "IssueCategory string"))
    got = {r.IssueCategory: (r.sla_days, r.is_tech, r.sla_matched) for r in df.collect()}
    assert got == {
        categories[0]: (2, False, True), categories[1]: (5, False, False), categories[2]: (5, True, False), None: (5, False, False),
        " bAttEry ": (6, True, True)}


def test_segment_merge(spark):
    values = ["Private - SME", "LE - Cath Lab", "LE - Diagnostic Chain", "LE - Large Hospital", "Government", "ECHO", "Project", "", None, "   "]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")
    got = [r.m for r in df.orderBy("i").select(cl.segment_group("s").alias("m")).collect()]
    assert got == ["SME", "LE", "LE", "LE", "Government", "ECHO", "Project", "(blank)", "(blank)", "(blank)"]
    assert df.filter("i = 8").select(cl.segment_group("s", "Unknown")).first()[0] == "Unknown"


def test_model_token(spark):
    df = spark.createDataFrame([("Alpha - B2-1234ABC",), ("B2-123456",), ("123456",), ("",), (None,)], "s string")
    assert [r[0] for r in df.select(model_of("s")).collect()] == ["ALPHA", "B2", "", "", ""]


def test_device_age(spark):
    df = spark.createDataFrame([(datetime(2027, 1, 1),), (datetime(2026, 7, 30, 1),), (None,)], "c timestamp_ntz")
    assert [r[0] for r in df.select(tm.whole_days_between("c", tm.moment(AS_OF))).collect()] == [0, 1, None]


def test_boundary_differences(spark):
    df = spark.createDataFrame(
        [(datetime(2001, 1, 1, 0, 59), datetime(2001, 1, 1, 1, 1)), (datetime(2024, 1, 31), datetime(2024, 2, 1)),
         (datetime(2001, 1, 1, 5, 1), datetime(2001, 1, 1, 3, 59))], "a timestamp_ntz, b timestamp_ntz")
    got = [tuple(r) for r in df.select(tm.hours_between("a", "b"), tm.months_between_starts("a", "b"), tm.days_between("a", "b")).collect()]
    assert got == [(1, 0, 0), (24, 1, 1), (-2, 0, 0)]


def test_tickets_tree(tables):
    tree = {(r.level, r.source, r.outcome): r.value for r in rollups.tickets_tree(tables).collect()}
    sources = {s: v for (level, s, _), v in tree.items() if level == 1}
    assert tree[(0, "", "")] == sum(sources.values())
    for source, total in sources.items():
        assert total == sum(v for (level, s, _), v in tree.items() if level == 2 and s == source)
    assert sources["Support"] == tables.cleaned().count()


def test_coordinates_prefer_own_unless_zero(spark):
    from fleetlens.operators.geo import with_coordinates

    rows_ = spark.createDataFrame(
        [(1, "560001", "P", "S", "", 12.5, 77.5), (2, "560001", "P", "S", "", 0.0, 0.0), (3, None, None, None, None, None, None),
         (4, "560002", "P", "S", "India", None, None)],
        "center_id bigint, pin string, city string, state string, country string, lat double, lng double")
    store = spark.createDataFrame([("p:560001|India", "10.5,70.25"), ("p:560002|India", "x")], "key string, value string")
    got = {r.center_id: (r.lat, r.lng) for r in with_coordinates(rows_, store).collect()}
    assert got == {1: (12.5, 77.5), 2: (10.5, 70.25), 3: (None, None), 4: (None, None)}
