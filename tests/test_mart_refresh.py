"""Refreshed marts equal marts built anew and rewrite touched partitions alone; versioned marts are built once and read."""

from __future__ import annotations

import glob
import os
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from fleetlens.filters import Filters
from fleetlens.operators import centers as ct
from fleetlens.operators import tickets as tk
from fleetlens.plans import marts as mt
from fleetlens.plans.registry import load
from fleetlens.sources.catalog import MartCatalog, input_version
from fleetlens.sources.proxy import EVENTS_AS_OF, TICKETS_AS_OF, proxy_tables
from helpers import CENTER_SCHEMA, HEARTBEAT_SCHEMA, REGISTER_SCHEMA, TICKET_SCHEMA, frame, rows, ticket

SMALL = "/root/testdata/sf0.001"
CENTER_MARTS = ("center_tickets", "center_360", "scores")


def files(marts, name):
    return {os.path.relpath(f, marts.path(name)) for f in glob.glob(f"{marts.path(name)}/**/*.parquet", recursive=True)}


def equal(a, b):
    b = b.select(a.columns)
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def actions(changes):
    return {c.mart: c.action for c in changes}


@pytest.fixture(scope="module")
def written(spark, tables, tmp_path_factory):
    """The test tables as Parquet, so that they have files of their own and can be read many times."""
    folder = str(tmp_path_factory.mktemp("tables"))
    names = ("center_details", "support_tickets", "heartbeats", "device_register", "field_service", "escalations", "geo_store")
    for name in names:
        tables.scan(name).write.parquet(f"{folder}/{name}")
    return tables.replacing({name: spark.read.parquet(f"{folder}/{name}") for name in names})


def test_refresh_writes_touched_partitions_alone(spark, written, tmp_path):
    marts = mt.MartFolder(spark, str(tmp_path / "marts"), ranges=40, buckets=16)
    first = marts.refresh(written, TICKETS_AS_OF, EVENTS_AS_OF)
    assert "kept" not in actions(first).values()
    again = marts.refresh(written, TICKETS_AS_OF, EVENTS_AS_OF)
    assert set(actions(again).values()) == {"kept"} and set(actions(again)) == set(marts.paths())

    # One in a hundred tickets changes: those of one range of numbers, as new and reopened tickets mostly are neighbours.
    numbers = [r[0] for r in written.tickets.select("ticketNumber").filter("ticketNumber IS NOT NULL").distinct().orderBy("ticketNumber").collect()]
    some = numbers[-len(numbers) // 100 :]
    before = {name: files(marts, name) for name in ("cleaned_tickets", *CENTER_MARTS)}
    changed_tickets = written.tickets.withColumn("status", F.when(F.col("ticketNumber").isin(some), "Closed").otherwise(F.col("status"))).filter(
        ~F.coalesce(F.col("ticketNumber") == some[0], F.lit(False)))
    changed = written.replacing({"support_tickets": changed_tickets})
    done = {c.mart: c for c in marts.refresh(changed, TICKETS_AS_OF, EVENTS_AS_OF)}
    assert done["device_index"].action == done["devices_tree"].action == "kept"
    for name in ("cleaned_tickets", *CENTER_MARTS):
        assert done[name].action == "partitions"
        folders = {f.split("=")[1].split("/")[0] for f in before[name] ^ files(marts, name)}
        assert folders <= {"__HIVE_DEFAULT_PARTITION__" if p is None else str(p) for p in done[name].partitions}
        assert before[name] & files(marts, name), f"{name} was written as a whole"
    whole = mt.build_marts(changed, TICKETS_AS_OF, str(tmp_path / "whole"), EVENTS_AS_OF)
    assert set(whole) == set(marts.paths())
    for name, path in whole.items():
        assert equal(spark.read.parquet(path), marts.mart(name)), name


def test_refresh_follows_every_kind_of_change(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(mt, "_DERIVED", {"sla_kpis": mt._DERIVED["sla_kpis"]})
    day = "2001-07-0{} 00:00:00".format
    base = [ticket(n, n % 5 + 1, day(n % 9 + 1), day(n % 9 + 1)[:-8] + "05:00:00" if n % 3 else None, "Closed" if n % 3 else "Open") for n in range(1, 200)]
    centers = [{"CenterID": i, "Centername": f"C{i}", "Status": "ACTIVE", "deploymentdate": (TICKETS_AS_OF - timedelta(days=900)).date(), "DeviceID": f"AA-00000{i}"} for i in range(1, 8)]
    register = [{"issue_key": f"D-{i}", "summary": f"AA-00000{i}", "issuetype_name": "Connector", "status_name": "Deployed"} for i in range(1, 6)]
    beats = "DeviceID string, CenterID bigint, LastTimeStamp timestamp_ntz, CSQ string, BatteryLevel string"
    empty = {
        "field_service": spark.createDataFrame([], "closure_type string, customer_category string, state string, city string, created_on timestamp_ntz"),
        "escalations": spark.createDataFrame([], "remarks string, center_id string, received_date timestamp_ntz"), "geo_store": spark.createDataFrame([("c:x", "1,2")], "key string, value string"),
    }

    def tables(tickets=base, centers=centers, register=register, heartbeats=()):
        from fleetlens.sources.tables import Tables

        return Tables.from_frames(spark, empty | {
            "support_tickets": frame(spark, TICKET_SCHEMA, *tickets), "center_details": frame(spark, CENTER_SCHEMA, *centers),
            "device_register": frame(spark, REGISTER_SCHEMA, *register), "heartbeats": spark.createDataFrame(list(heartbeats), beats),
        })

    moved = [dict(t, CenterID=7) if t["ticketNumber"] == 30 else t for t in base]
    steps = {
        "a ticket that moves, a newer copy in another center and month, a center without tickets any more, lone and repeated rows, unknown center and time": tables([
            *(t for t in moved if t["CenterID"] != 2), ticket(20, 6, "2001-08-01 00:00:00"), ticket(None, 1), ticket(None, 1), base[0], ticket(500, None), ticket(501, 3, None)]),
        "centers renamed, gone and new, a device and a heartbeat": tables(
            centers=[dict(centers[0], Centername="New"), *centers[2:], dict(centers[1], CenterID=99)], register=register[1:], heartbeats=[("AA-000009", 3, EVENTS_AS_OF, "10", "5")]),
        "no tickets at all": tables([]),
    }
    marts = mt.MartFolder(spark, str(tmp_path / "marts"), ranges=20, buckets=4)
    marts.refresh(tables(), TICKETS_AS_OF, EVENTS_AS_OF, Filters())
    for step, now in steps.items():
        marts.refresh(now, TICKETS_AS_OF, EVENTS_AS_OF, Filters())
        assert equal(now.cleaned(*mt.TICKET_EXTRAS), marts.mart("cleaned_tickets")), step
        assert equal(ct.center_360(now, TICKETS_AS_OF, EVENTS_AS_OF), marts.mart("center_360")), step
        assert rows(tk.sla_kpis(now, TICKETS_AS_OF)) == rows(marts.mart("sla_kpis")), step


def test_refresh_after_one_that_broke_off_and_at_another_moment(spark, written, tmp_path, monkeypatch):
    monkeypatch.setattr(mt, "_DERIVED", {})
    marts = mt.MartFolder(spark, str(tmp_path / "marts"), ranges=20, buckets=4)
    marts.refresh(written, TICKETS_AS_OF, EVENTS_AS_OF)
    changed = written.replacing({"support_tickets": written.tickets.filter("coalesce(ticketNumber, 0) % 50 <> 1")})
    with monkeypatch.context() as m:
        m.setattr(mt.MartFolder, "_refresh_centers", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            marts.refresh(changed, TICKETS_AS_OF, EVENTS_AS_OF)
    marts.refresh(changed, TICKETS_AS_OF, EVENTS_AS_OF)
    assert equal(ct.center_360(changed, TICKETS_AS_OF, EVENTS_AS_OF), marts.mart("center_360"))
    later = TICKETS_AS_OF + timedelta(days=40)
    done = {c.mart: c for c in marts.refresh(changed, later, EVENTS_AS_OF)}
    assert done["cleaned_tickets"].action == "kept" and done["center_360"].partitions == (0, 1, 2, 3)
    assert equal(ct.center_360(changed, later, EVENTS_AS_OF), marts.mart("center_360"))


def test_catalog_builds_a_version_once(spark, written, tmp_path):
    catalog, built = MartCatalog(spark, str(tmp_path / "catalog")), []

    def build():
        built.append(1)
        return written.centers.select("CenterID")

    version = input_version(spark, written.inputs("center_details"), as_of=1)
    first = catalog.resolve("some", version, build)
    assert rows(catalog.resolve("some", version, build)) == rows(first) and built == [1]
    from fleetlens.sources import catalog as module

    module._KNOWN.clear()  # as in another session
    assert MartCatalog(spark, str(tmp_path / "catalog")).path("some", version) and catalog.entries("some", version).first()["row_count"] == first.count()
    assert input_version(spark, written.inputs("center_details"), as_of=2) != version
    more = str(tmp_path / "more")
    written.centers.limit(3).write.parquet(more)
    old = input_version(spark, {"a": spark.read.parquet(more)})
    written.centers.limit(1).write.mode("append").parquet(more)
    assert input_version(spark, {"a": spark.read.parquet(more)}) != old
    # What has no files has no version, and is never taken from a mart.
    assert input_version(spark, {"a": spark.range(3), "b": written.centers}) is None
    for _ in range(2):
        catalog.resolve("unknown", None, build)
    assert len(built) == 3


MART_QUERIES = (
    "N12_center_explorer", "R2_node_stats", "R3_customers_tree", "R6_accounts", "R6_account_totals", "G4_map_points", "G6_telemetry_points", "G6_unlocated_centers",
)


@pytest.mark.parametrize("name", MART_QUERIES)
def test_queries_read_marts_not_tickets(spark, name):
    tickets = set(proxy_tables(spark, SMALL).tickets.inputFiles())
    read = load()[name].run(spark, SMALL).inputFiles()
    assert read and not tickets & set(read) and all("/mart-catalog/" in f or "customer" in f for f in read)


def test_date_filters_read_their_months_alone(spark, written, tmp_path):
    t = mt.with_ticket_marts(written, MartCatalog(spark, str(tmp_path / "catalog")))
    narrow = Filters(date_from="1997-03-05", date_to="1997-05-20", segments=("LE",))
    plan = tk.sla_kpis(t, TICKETS_AS_OF, narrow)._jdf.queryExecution().executedPlan().toString()
    pruned = next(x for x in plan.splitlines() if "PartitionFilters" in x and "created_month" in x)
    assert f">= {1997 * 12 + 2})" in pruned and f"<= {1997 * 12 + 4})" in pruned
    read = tk.scope(t, Filters(date_from="1997-03-05", date_to="1997-05-20")).select(F.input_file_name().alias("f")).distinct().collect()
    assert {r.f.split("created_month=")[1].split("/")[0] for r in read} <= {str(1997 * 12 + m) for m in (2, 3, 4)}
    assert rows(tk.sla_kpis(t, TICKETS_AS_OF, narrow)) == rows(tk.sla_kpis(written, TICKETS_AS_OF, narrow))


def test_crossing_hours_answer_for_every_moment(spark, written, tmp_path):
    t = mt.with_ticket_marts(written, MartCatalog(spark, str(tmp_path / "catalog")))
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    plan = tk.worklist_rows(t, TICKETS_AS_OF, risk="breached")._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "PushedFilters" in plan and "LessThanOrEqual(at_risk_at," in plan and "LessThanOrEqual(breach_at," in plan
    for hours in (0, 1, 24 * 30, 24 * 400, 24 * 1200 + 7):
        as_of = TICKETS_AS_OF - timedelta(hours=hours)
        measured = tk.measured(tk.scope(written), as_of).filter("is_open AND CreatedAt IS NOT NULL AND (breached OR at_risk)")
        got = tk.critical(t, as_of)
        assert rows(got, "ticketNumber", "CenterID", "breached") == rows(measured, "ticketNumber", "CenterID", "breached")
        band = tk.critical(t, as_of, risk="atrisk")
        assert band.count() == measured.filter("at_risk").count()
