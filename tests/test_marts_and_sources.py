from __future__ import annotations

import csv
import glob
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from fleetlens.filters import DEFAULT_FILTERS, Filters
from fleetlens.operators import centers as ct
from fleetlens.operators import devices as dv
from fleetlens.operators import explore as ex
from fleetlens.operators import lineage
from fleetlens.operators import profile as pf
from fleetlens.operators import tickets as tk
from fleetlens.operators import uptime as up
from fleetlens.plans import pages
from fleetlens.plans.query_lineage import center_details
from fleetlens.plans.marts import build_marts, shared_folder
from fleetlens.sources.proxy import EVENTS_AS_OF, TICKETS_AS_OF
from fleetlens.sources.tables import Tables
from helpers import rows


def test_marts_hold_what_the_queries_return(spark, tables, tmp_path):
    paths = build_marts(tables, TICKETS_AS_OF, str(tmp_path), EVENTS_AS_OF, Filters())
    mart = spark.read.parquet(paths["center_360"])
    fresh = ct.center_360(tables, TICKETS_AS_OF, EVENTS_AS_OF)
    assert mart.exceptAll(fresh).count() == 0 and fresh.exceptAll(mart).count() == 0
    assert rows(spark.read.parquet(paths["fleet_uptime"])) == rows(up.fleet(up.scored(tables, TICKETS_AS_OF)))
    reliability = spark.read.parquet(paths["reliability"])
    assert reliability.filter("center LIKE 'Center #%'").count() > 0
    found = ct.explorer(mart, DEFAULT_FILTERS, sort_by="open_tickets").collect()
    assert [r.open_tickets for r in found] == sorted((r.open_tickets for r in found), reverse=True)


def test_shared_folder_follows_the_session():
    class Session:
        class conf:
            get = staticmethod({"spark.checkpoint.dir": "hdfs://shared/place"}.get)

    assert shared_folder(Session) == "hdfs://shared/place"

    class Unset:
        class conf:
            get = staticmethod({}.get)

        class sparkContext:
            master = "local[2]"

    assert shared_folder(Unset).startswith("/")
    Unset.sparkContext.master = "spark://somewhere:7077"
    with pytest.raises(ValueError):
        shared_folder(Unset)


def test_pages_honour_their_size_and_bounds_that_are_no_days(tables):
    assert ex.raw_page(tables, "center_details", size=1).count() == 1
    total = tables.centers.count()
    assert ex.raw_page(tables, "center_details", size=10 * total).count() == total
    with pytest.raises(ValueError):
        ex.raw_page(tables, "center_details", size=0)
    assert ex.raw_rows(tables, "center_details", Filters(date_from="2001-02-30")).count() == total


def test_export_reports_its_cap(tables, tmp_path):
    total = tables.centers.count()
    capped = ex.raw_export(tables, "center_details", str(tmp_path / "a"), max_rows=10)
    assert capped == {"total_rows": total, "truncated": True}
    whole = ex.raw_export(tables, "center_details", str(tmp_path / "b"))
    assert whole == {"total_rows": total, "truncated": False}
    lines = [r for f in glob.glob(str(tmp_path / "a" / "*.csv")) for r in list(csv.DictReader(open(f)))]
    assert len(lines) == 10 and lines[0]["CenterID"] == "0"


def test_bounded_export_equals_the_plain_one(spark, tables, tmp_path):
    t = tables.replacing({"support_tickets": tables.tickets})
    ex.raw_export(t, "support_tickets", str(tmp_path / "c"), max_rows=500)
    plain = ex.raw_export_rows(t, "support_tickets", max_rows=500)
    written = spark.read.option("header", True).csv(str(tmp_path / "c"))
    assert written.count() == 500
    assert rows(written.selectExpr("cast(ticketNumber AS bigint) AS n", "cast(CenterID AS bigint) AS c").fillna(-1)) == rows(
        plain.selectExpr("ticketNumber AS n", "CenterID AS c").fillna(-1))


def test_deep_pages_read_their_ranges_alone(spark, tmp_path):
    hot = spark.range(20_000).selectExpr("IF(id % 3 = 0, 7, id % 1000) AS k", "CAST(id % 50 AS STRING) AS name", "IF(id % 11 = 0, NULL, id) AS v")
    order = [F.col("k").desc_nulls_last(), F.col("name").asc_nulls_first()]
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        want = [tuple(r) for r in hot.orderBy(*ex.total_order(hot, order)).collect()]
        written = ex.ordered(hot, order, str(tmp_path))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert written.total == len(want)
    sizes = [b - a for a, b in zip(written.before, [*written.before[1:], written.total])]
    assert max(sizes) <= 3 * written.total / len(sizes) or len(sizes) == 1
    for start, end in ((0, 10), (18_000, 18_500), (19_990, 20_010), (30_000, 30_010), (6_000, 14_000)):
        assert [tuple(r) for r in written.rows(start, end).collect()] == want[start:end]
    shallow, deep = ex.page_of(hot, order, 90, 200), ex.page_of(hot, order, 90, 200, prefix_rows=100, folder=str(tmp_path))
    assert [tuple(r) for r in shallow.collect()] == [tuple(r) for r in deep.collect()] and shallow.columns == deep.columns
    assert ex.page_of(hot.limit(0), order, 5, 10, prefix_rows=1, folder=str(tmp_path)).count() == 0


def test_raw_tickets_keep_their_copies(tables):
    assert ex.raw_rows(tables, "support_tickets").count() == tables.tickets.count() > tables.cleaned().count()


def test_tables_from_folder_with_own_names(spark, tables, tmp_path):
    tables.geo_store.write.parquet(str(tmp_path / "places"))
    t = Tables.from_parquet(spark, str(tmp_path), {"geo_store": "places"})
    assert rows(t.geo_store) == rows(tables.geo_store)


def test_profile_estimates_distinct_values(tables):
    got = {r.column_name: r.distinct_values for r in pf.column_profile(tables.service).collect()}
    exact = tables.service.select("ticket_id").distinct().count()
    assert abs(got["ticket_id"] - exact) <= 0.15 * exact and got["ticket_type"] == 2


def test_center_counts_are_consistent(tables):
    kpis = ct.kpis(tables).first()
    assert kpis.active_deployments <= kpis.centers and kpis.centers_with_open_tickets <= kpis.centers
    assert sum(r.devices for r in ct.by_state(tables, limit=1000).collect()) <= kpis.centers
    chosen = ct.totals(tables, Filters(hubs=("Hub 11",))).first().centers
    assert chosen == tables.centers.filter("trim(HubName) = 'Hub 11'").select("CenterID").distinct().count()
    assert tables.centers.filter("HubName != trim(HubName) AND trim(HubName) = 'Hub 11'").count() > 0


def test_every_page_result_runs(spark, tables, tmp_path):
    paths = build_marts(tables, TICKETS_AS_OF, str(tmp_path), EVENTS_AS_OF)
    mart = spark.read.parquet(paths["center_360"])
    t = tables.replacing({"cleaned_tickets": spark.read.parquet(paths["cleaned_tickets"])})
    now, f = TICKETS_AS_OF, DEFAULT_FILTERS
    shown = {
        "dashboard": pages.dashboard(t, now, f, mart), "numbers": pages.numbers(t, now, f), "overview": pages.overview(t, now, f, mart),
        "map": pages.site_map(t, now, f, mart), "telemetry": pages.telemetry(t, datetime(2024, 1, 31), f, mart),
        "service": pages.service(t, f), "escalations": pages.escalations(t, f), "accounts": pages.accounts(t, now, f, mart),
        "detail": pages.center_detail(t, now, 59),
    }
    for page in shown.values():
        for df in page.values():
            assert df.columns
    assert shown["dashboard"]["sla_kpis"].first().resolved_n > 0
    assert shown["accounts"]["totals"].first().customers == 22


def test_built_tables_feed_the_queries(tables):
    t = tables
    built = t.replacing({
        "support_tickets": lineage.build_support_tickets(t.tickets, *(t.scan(f"source_{n}") for n in ("centers", "members", "organizations", "managers"))),
        "heartbeats": lineage.build_heartbeats(*(t.scan(f"source_{n}") for n in ("heartbeats", "devices", "centers"))),
        "center_details": center_details(t),
    })
    known = built.tickets.filter("trim(assignee) <> '' AND ticketNumber IS NOT NULL").select("ticketNumber").distinct().count()
    assert built.cleaned().filter("ticketNumber IS NOT NULL").count() == known > 0
    assert tk.sla_kpis(built, TICKETS_AS_OF).first().resolved_n > 0
    assert dv.telemetry_kpis(built, EVENTS_AS_OF).first().unsynced_total > 0
    kpis = ct.kpis(built).first()
    assert kpis.centers == t.scan("source_centers").count() > kpis.active_deployments > 0
