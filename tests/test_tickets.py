from __future__ import annotations

from datetime import datetime

from fleetlens.filters import Filters
from fleetlens.operators import tickets as tk
from fleetlens.sources.cleaned import cleaned_tickets
from fleetlens.sources.proxy import TICKETS_AS_OF
from fleetlens.sources.reference_data import account_group_rows, sla_catalog_rows
from fleetlens.sources.tables import Tables
from helpers import TICKET_SCHEMA, frame, rows, ticket


def test_reference_lists():
    catalog = sla_catalog_rows()
    assert len(catalog) == 117 and len({n for n, _, _ in catalog}) == 117
    groups = account_group_rows()
    hubs = [h for _, _, listed in groups for h in listed]
    assert len(groups) == 22 and len(hubs) == 75 and len(set(hubs)) == 75


def test_cleaned_keeps_latest_copy_and_every_unnumbered_row(spark):
    raw = frame(
        spark, TICKET_SCHEMA,
        ticket(1, created="2001-01-01 00:00:00", status="Open"), ticket(1, created="2001-01-02 00:00:00", status="Closed"),
        ticket(1, created="2001-01-02 00:00:00", status="Closed"), ticket(2, assignee="  "), ticket(3, assignee=None),
        ticket(None), ticket(None), ticket(4, created=None), ticket(4, created="1999-01-01 00:00:00", status="Junk"))
    got = sorted((r.ticketNumber or 0, r.status) for r in cleaned_tickets(raw).collect())
    assert got == [(0, "Open"), (0, "Open"), (1, "Closed"), (4, "Junk")]


def test_cleaned_does_not_depend_on_partitioning(spark, tables):
    one = rows(cleaned_tickets(tables.tickets.coalesce(1), "priority").selectExpr("sum(cast(xxhash64(*) as decimal(38,0)))", "count(*)"))
    other = rows(cleaned_tickets(tables.tickets.repartition(13, "subject"), "priority").selectExpr("sum(cast(xxhash64(*) as decimal(38,0)))", "count(*)"))
    assert one == other


def test_copies_of_one_ticket_are_reduced_before_the_shuffle(spark, tables):
    plan = cleaned_tickets(tables.tickets)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_scan_reads_only_what_the_metric_needs(spark, tmp_path, tables):
    path = str(tmp_path / "support_tickets")
    tables.tickets.write.parquet(path)
    t = Tables.from_parquet(spark, str(tmp_path))
    plan = tk.kpis(t, TICKETS_AS_OF)._jdf.queryExecution().executedPlan().toString()
    assert "TicketLink" not in plan and "subject" not in plan and "PushedFilters" in plan


def test_one_hot_ticket_survives(spark):
    many = spark.range(0, 20000).selectExpr(
        "if(id % 3 = 0, 7L, id) AS ticketNumber", "1L AS CenterID", "timestamp_ntz'2001-01-01 00:00:00' + id * interval '1' minute AS CreatedAt",
        "cast(null AS timestamp_ntz) AS ClosedAt", "'Open' AS status", "'Battery' AS IssueCategory", "'A' AS assignee")
    kept = cleaned_tickets(many)
    assert kept.count() == kept.select("ticketNumber").distinct().count()
    assert kept.filter("ticketNumber = 7").first().CreatedAt == datetime(2001, 1, 14, 21, 18)


def test_worklist_reconciles_with_headline(tables):
    headline = tk.sla_kpis(tables, TICKETS_AS_OF).first()
    assert tk.worklist_rows(tables, TICKETS_AS_OF).count() == headline.breached_open + headline.atrisk_open
    risk = tk.open_risk_by_category(tables, TICKETS_AS_OF, limit=1000).collect()
    assert sum(r.breached for r in risk) == headline.breached_open and sum(r.atrisk for r in risk) == headline.atrisk_open


def test_zero_day_target_breaches_at_any_age(spark):
    raw = frame(spark, TICKET_SCHEMA, ticket(1, created="2001-01-01 10:00:00", category="Duplicate Ticket"),
                ticket(2, created="2001-01-01 12:30:00", category="Duplicate Ticket"))
    t = Tables.from_frames(spark, {"support_tickets": raw})
    got = rows(tk.worklist_rows(t, datetime(2001, 1, 1, 12)), "ticket", "risk", "days_over")
    assert got == [(1, "BREACHED", 0.1)]


def test_pages_cover_the_worklist_once(tables):
    total = tk.worklist_rows(tables, TICKETS_AS_OF).count()
    seen = []
    for page in range(3):
        shown = tk.worklist(tables, TICKETS_AS_OF, page=page, size=10).collect()
        assert all(r.total_rows == total for r in shown)
        seen += [(r.ticket, r.center_id, r.created) for r in shown]
    assert len(seen) == min(30, total) and len(set(seen)) == len(seen)


def test_search_is_literal_and_needs_two_characters(spark):
    raw = frame(spark, TICKET_SCHEMA, ticket(1, created="2000-01-01 00:00:00", category="50% off"),
                ticket(2, created="2000-01-01 00:00:00", category="500 off"))
    t = Tables.from_frames(spark, {"support_tickets": raw})
    found = lambda q: sorted(r.ticket for r in tk.worklist(t, TICKETS_AS_OF, search=q).collect())
    assert found("50%") == [1] and found("%") == [1, 2] and found("OFF") == [1, 2] and found("zz") == []


def test_filters_only_narrow(tables):
    everything = tk.kpis(tables, TICKETS_AS_OF).first()
    dated = tk.kpis(tables, TICKETS_AS_OF, Filters(date_from="1997-01-01", date_to="1999-12-31")).first()
    assert 0 < dated.total_tickets < everything.total_tickets
    malformed = tk.kpis(tables, TICKETS_AS_OF, Filters(date_from="1997/01/01")).first()
    assert malformed == everything


def test_two_segments_are_the_sum_of_each(tables):
    def total(*segments):
        return tk.totals(tables, Filters(segments=segments)).first().total

    assert total("LE", "SME") == total("LE") + total("SME") > 0


def test_null_status_is_neither_open_nor_closed(spark):
    raw = frame(spark, TICKET_SCHEMA, ticket(1, status=None), ticket(2), ticket(3, status="Closed"))
    got = tk.kpis(Tables.from_frames(spark, {"support_tickets": raw}), TICKETS_AS_OF).first()
    assert (got.total_tickets, got.open_tickets) == (3, 1)


def test_failures_by_center_breaks_ties_by_name(spark):
    raw = frame(spark, TICKET_SCHEMA, ticket(1, category="Display"), ticket(2, category="Antenna", created="2000-05-01 00:00:00"),
                ticket(3, category="Billing Query"), ticket(4, center=None))
    got = tk.failures_by_center(Tables.from_frames(spark, {"support_tickets": raw})).collect()
    assert [tuple(r) for r in got] == [(1, datetime(2000, 5, 1), 2, "Antenna")]
