"""What a refresh of the marts leaves on disk, and that working in parts changes no row."""

from __future__ import annotations

import glob
import time
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from fleetlens.plans import marts as mt
from fleetlens.plans import query_basics as qb
from fleetlens.plans.registry import QUERIES
from fleetlens.session import SPARING, sparing_disk
from fleetlens.sources.cleaned import cleaned_tickets
from fleetlens.sources.proxy import EVENTS_AS_OF, TICKETS_AS_OF
from fleetlens.sources.tables import Tables
from helpers import CENTER_SCHEMA, REGISTER_SCHEMA, TICKET_SCHEMA, frame, rows, ticket

NOTHING = {
    "field_service": "closure_type string, customer_category string, state string, city string, created_on timestamp_ntz",
    "escalations": "remarks string, center_id string, received_date timestamp_ntz", "geo_store": "key string, value string",
    "heartbeats": "DeviceID string, CenterID bigint, LastTimeStamp timestamp_ntz, CSQ string, BatteryLevel string",
}


def months_of_tickets():
    """Two copies of each number, in two months; tickets without a number, some of them twice, and without a time or a center."""
    kept = [ticket(n, n % 5 + 1, f"2001-{(n + c) % 6 + 1:02}-0{n % 9 + 1} 00:00:00", None, "Open" if c else "Closed", subject=str(c)) for n in range(1, 61) for c in (0, 1)]
    lone = [ticket(None, n % 3 + 1, f"2001-07-0{n % 4 + 1} 00:00:00") for n in range(12)]
    return [*kept, *lone, ticket(70, None), ticket(71, 2, None), ticket(72, 2, assignee=" ")]


@pytest.fixture
def tables(spark):
    centers = [{"CenterID": i, "Centername": f"C{i}", "Status": "ACTIVE", "deploymentdate": (TICKETS_AS_OF - timedelta(days=900)).date()} for i in range(1, 8)]
    rest = {name: spark.createDataFrame([], schema) for name, schema in NOTHING.items()}
    return Tables.from_frames(spark, rest | {
        "support_tickets": frame(spark, TICKET_SCHEMA, *months_of_tickets()), "center_details": frame(spark, CENTER_SCHEMA, *centers),
        "device_register": frame(spark, REGISTER_SCHEMA, {"issue_key": "D-1", "summary": "AA-000001", "issuetype_name": "Connector"}),
    })


def shuffle_files(spark) -> int:
    found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum(1 for i in range(found.size()) if found.apply(i).getName().endswith(".data"))


def test_parts_hold_all_copies_of_a_ticket_and_every_row(spark, tables):
    whole, parts = cleaned_tickets(tables.tickets, *mt.TICKET_EXTRAS), list(mt._cleaned_parts(tables.tickets, 4))
    joined = parts[0].unionAll(parts[1]).unionAll(parts[2]).unionAll(parts[3])
    assert rows(qb.row_differences(whole, joined)) == [(0, 0)] and whole.count() == 60 + 12 + 2
    assert sum(not df.isEmpty() for df in parts) > 1


@pytest.mark.parametrize("months, parts, want", [([3, None, 1, 2], 2, [[None, 1], [2, 3]]), ([5], 4, [[5]]), ([], 3, []), ([1, 2, 3], 1, [[1, 2, 3]])])
def test_months_are_dealt_in_turn(months, parts, want):
    assert mt._in_turn(months, parts) == want


def test_a_refresh_in_parts_equals_a_whole_build_and_leaves_nothing_written_apart(spark, tables, tmp_path, monkeypatch):
    monkeypatch.setattr(mt, "_DERIVED", {})
    folder = mt.MartFolder(spark, str(tmp_path / "marts"), ranges=6, buckets=4, parts=3)
    folder.refresh(tables, TICKETS_AS_OF, EVENTS_AS_OF)
    number = F.col("ticketNumber")
    steps = {
        "a month and a center without tickets any more, closed ones": tables.tickets.filter("CreatedAt IS NULL OR (month(CreatedAt) <> 3 AND CenterID <> 4)").withColumn("status", F.when(number < 20, "Closed").otherwise(F.col("status"))),
        "every range changed": tables.tickets.withColumn("subject", F.lit("x")),
        "an unassigned ticket alone": tables.tickets.withColumn("subject", F.when(number == 72, "y").otherwise(F.lit("x"))),
        "no tickets": tables.tickets.limit(0),
    }
    for i, (step, tickets) in enumerate(steps.items()):
        now = tables.replacing({"support_tickets": tickets})
        folder.refresh(now, TICKETS_AS_OF, EVENTS_AS_OF)
        built = mt.build_marts(now, TICKETS_AS_OF, str(tmp_path / f"whole{i}"), EVENTS_AS_OF, parts=3) if i < 2 else {}
        for name, path in built.items():
            wanted = spark.read.parquet(path)
            assert rows(qb.row_differences(wanted, folder.mart(name).select(wanted.columns))) == [(0, 0)], (step, name)
        assert rows(qb.row_differences(cleaned_tickets(tickets, *mt.TICKET_EXTRAS), folder.mart("cleaned_tickets").select(*mt.TICKET_CORE, *sorted(mt.TICKET_EXTRAS)))) == [(0, 0)], step
        assert len(glob.glob(str(tmp_path / "marts/_staged/*"))) == 2, "the sums of ranges and of centers are all that the next refresh needs"


def test_differences_by_part_add_up(spark):
    built = spark.createDataFrame([(1, "a"), (1, "a"), (None, "b"), (2, None), (7, "z")], "n bigint, s string")
    kept = spark.createDataFrame([(1, "a"), (None, "b"), (None, "b"), (3, None), (3, None), (7, "z")], "n bigint, s string")
    found = [qb.row_differences(built, kept, part, 3).first() for part in range(3)]
    assert (sum(r["missing"] for r in found), sum(r["surplus"] for r in found)) == tuple(qb.row_differences(built, kept).first()) == (2, 3)


def test_the_refresh_report_holds_no_shuffle_files_of_steps_that_ended(spark, tables, monkeypatch, tmp_path):
    monkeypatch.setattr(mt, "_DERIVED", {})
    monkeypatch.setattr(mt, "PART_BYTES", 2000)
    folders, seen, parts = [], [], []
    monkeypatch.setattr(qb, "new_folder", lambda _: folders.append(str(tmp_path / f"f{len(folders)}")) or folders[-1])
    monkeypatch.setattr(qb, "one_percent_changed", lambda t: t.replacing({"support_tickets": t.tickets.filter("coalesce(ticketNumber, 0) % 7 <> 1")}))
    built = mt.build_marts

    def remembered(*a, **k):
        parts.append(k.get("parts"))
        seen.append(shuffle_files(spark))
        return built(*a, **k)

    monkeypatch.setattr(qb, "build_marts", remembered)
    settings, before = {key: spark.conf.get(key) for key in SPARING}, shuffle_files(spark)
    report = rows(QUERIES["S8_refreshed_marts"].build(tables))
    assert report == [(name, 0, 0) for name in ("center_360", "center_tickets", "cleaned_tickets", "scores")]
    assert parts[0] > 1 and seen[0] <= before + 20, "the shuffle files of two refreshes lie on disk"
    assert {key: spark.conf.get(key) for key in SPARING} == settings
    assert not glob.glob(f"{folders[0]}/*"), "the stored tickets are left"


def test_shuffle_files_go_with_the_write_they_served(spark, tmp_path):
    before = shuffle_files(spark)
    with sparing_disk(spark):
        spark.range(1000).repartition(4, "id").write.parquet(str(tmp_path / "a"))
        assert spark.read.parquet(str(tmp_path / "a")).groupBy("id").count().count() == 1000
    for _ in range(100):
        if shuffle_files(spark) <= before:
            break
        time.sleep(0.1)
    assert shuffle_files(spark) <= before
