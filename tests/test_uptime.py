from __future__ import annotations

import random
from datetime import date, datetime, timedelta

from pyspark.sql import functions as F

from fleetlens.operators import tickets as tk
from fleetlens.operators import uptime as up
from fleetlens.sources.proxy import TICKETS_AS_OF
from fleetlens.sources.tables import Tables
from helpers import CENTER_SCHEMA, TICKET_SCHEMA, frame, rows, ticket

START = datetime(2001, 1, 1)


def _random_intervals(n: int = 600, centers: int = 5, seed: int = 3) -> list[tuple[int, datetime, datetime]]:
    pick = random.Random(seed)
    out = []
    for _ in range(n):
        s = START + timedelta(minutes=pick.randrange(0, 60 * 24 * 40))
        out.append((1 if pick.random() < 0.4 else pick.randrange(2, centers + 1), s, s + timedelta(minutes=pick.randrange(-90, 600))))
    return out


def _union(intervals):
    """Islands by brute force. Intervals with one start are one; a backward one joins what is there or stands alone."""
    result = {}
    for key in {k for k, _, _ in intervals}:
        merged: list[list] = []
        latest: dict = {}
        for s, e in ((s, e) for k, s, e in intervals if k == key):
            latest[s] = max(latest.get(s, e), e)
        for s, e in sorted(latest.items()):
            if merged and s <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([s, e])
        result[key] = [tuple(m) for m in merged]
    return result


def _hours(s: datetime, e: datetime) -> int:
    def floor(t):
        return t.replace(minute=0, second=0)

    return int((floor(e) - floor(s)).total_seconds() // 3600)


def test_merge_matches_brute_force(spark):
    data = _random_intervals()
    df = spark.createDataFrame(data, "center_id bigint, start timestamp_ntz, end timestamp_ntz")
    islands = up.merge_intervals(df, "center_id")
    want = _union(data)
    assert rows(islands, "center_id", "start", "end") == sorted((k, s, e) for k, parts in want.items() for s, e in parts)
    assert islands.agg(F.sum("n")).first()[0] == len(data)


def test_merge_is_idempotent_and_order_independent(spark):
    data = _random_intervals(seed=9)
    schema = "center_id bigint, start timestamp_ntz, end timestamp_ntz"
    once = up.merge_intervals(spark.createDataFrame(data, schema), "center_id").select("center_id", "start", "end")
    again = up.merge_intervals(once, "center_id").select("center_id", "start", "end")
    shuffled = up.merge_intervals(spark.createDataFrame(data[::-1], schema).repartition(7), "center_id")
    assert rows(once) == rows(again) == rows(shuffled, "center_id", "start", "end")


def test_touching_intervals_merge_and_backward_ones_count_without_downtime(spark):
    h = lambda n: START + timedelta(hours=n)
    df = spark.createDataFrame([(1, h(0), h(2)), (1, h(2), h(3)), (1, h(1), h(0)), (1, h(5), h(4)), (1, h(8), h(8)), (1, h(30), h(60))],
                               "center_id bigint, start timestamp_ntz, end timestamp_ntz")
    islands = up.merge_intervals(df, "center_id")
    assert rows(islands, "start", "end", "n") == [(h(0), h(3), 3), (h(5), h(4), 1), (h(8), h(8), 1), (h(30), h(60), 1)]
    assert rows(up.island_downtime(islands), "islands", "downtime_hrs") == [(4, 33)]


def test_hourly_reduction_gives_the_downtime_of_the_islands(spark):
    data = _random_intervals(n=900, seed=21)
    raw = frame(spark, TICKET_SCHEMA, *(
        ticket(i, center=k, created=str(s), closed=str(e), status="Closed") for i, (k, s, e) in enumerate(data)))
    t = Tables.from_frames(spark, {"support_tickets": raw})
    stats = rows(tk.center_ticket_stats(t.cleaned(), TICKETS_AS_OF), "center_id", "failures", "downtime_hrs")
    want = {k: sum(max(0, _hours(s, e)) for s, e in parts) for k, parts in _union(data).items()}
    assert stats == sorted((k, sum(c == k for c, _, _ in data), d) for k, d in want.items())


def test_downtime_never_exceeds_the_raw_intervals(tables):
    raw = up.failure_intervals(tables, TICKETS_AS_OF).filter("end >= start").groupBy("center_id").agg(
        F.sum((F.unix_timestamp(F.col("end").cast("timestamp")) - F.unix_timestamp(F.col("start").cast("timestamp"))) / 3600 + 1).alias("raw"))
    merged = up.island_downtime(up.merge_intervals(up.failure_intervals(tables, TICKETS_AS_OF), "center_id"))
    joined = merged.join(raw, "center_id")
    assert joined.count() > 50 and joined.filter("downtime_hrs < 0 OR downtime_hrs > raw").count() == 0


def _scores(spark, tickets, centers, as_of):
    t = Tables.from_frames(spark, {
        "support_tickets": frame(spark, TICKET_SCHEMA, *tickets), "center_details": frame(spark, CENTER_SCHEMA, *centers)})
    return {r.center_id: r for r in up.scored(t, as_of).collect()}


def test_scores_by_hand(spark):
    as_of = datetime(2001, 4, 11)  # 100 days after the start
    born = {"deploymentdate": date(2001, 1, 1)}
    got = _scores(
        spark,
        [ticket(1, 1, "2001-02-01 00:00:00", "2001-02-02 00:00:00", "Closed"), ticket(2, 1, "2001-02-01 12:00:00", "2001-02-03 00:00:00", "Closed"),
         ticket(3, 2, "2001-04-10 00:00:00", None, "Open"), ticket(4, 3, "2001-03-01 00:00:00", "2001-02-01 00:00:00", "Closed"),
         ticket(5, 3, "2001-03-01 00:00:00", category="Billing Query"), ticket(6, 9, "2001-03-01 00:00:00")],
        [{"CenterID": 1, **born}, {"CenterID": 1, "deploymentdate": date(2001, 3, 1)}, {"CenterID": 2, **born}, {"CenterID": 3, **born},
         {"CenterID": 4, **born}, {"CenterID": 5}],
        as_of)
    assert sorted(got) == [1, 2, 3, 4]  # every born center, none without a birth
    assert (got[1].life_hrs, got[1].downtime_hrs, got[1].failures, got[1].uptime_pct, got[1].mtbf_hrs) == (2400, 48, 2, 98.0, 1176.0)
    assert got[1].health_score == 94.0  # 49 + 30 + 15
    assert (got[2].downtime_hrs, got[2].failures, got[2].uptime_pct, got[2].mtbf_hrs, got[2].health_score) == (24, 1, 99.0, None, 85.0)
    assert (got[3].downtime_hrs, got[3].failures, got[3].uptime_pct) == (0, 1, 100.0)  # closed before it was created
    assert (got[4].failures, got[4].uptime_pct, got[4].health_score) == (0, 100.0, 100.0)


def test_life_of_zero_hours_has_no_uptime(spark):
    got = _scores(spark, [ticket(1, 1)], [{"CenterID": 1, "deploymentdate": date(2001, 1, 1)}], START)
    assert got[1].uptime_pct is None and got[1].health_score is None


def test_percentages_stay_in_range(tables):
    scores = up.scored(tables, TICKETS_AS_OF)
    assert scores.filter("uptime_pct < 0 OR uptime_pct > 100 OR health_score < 0 OR health_score > 100").count() == 0
    assert scores.count() == tables.centers.filter("deploymentdate IS NOT NULL").select("CenterID").distinct().count()


def test_a_busy_center_is_reduced_before_the_window(spark):
    busy = spark.range(0, 30000).selectExpr(
        "id AS ticketNumber", "if(id % 3 = 0, 1L, id) AS CenterID",
        "timestamp_ntz'2001-01-01 00:00:00' + (id % 100) * interval '1' hour AS CreatedAt",
        "timestamp_ntz'2001-01-01 00:00:00' + (id % 100 + 2) * interval '1' hour AS ClosedAt", "'Closed' AS status", "'Battery' AS IssueCategory")
    stats = tk.center_ticket_stats(busy, TICKETS_AS_OF)
    hot = stats.filter("center_id = 1").first()
    assert (hot.failures, hot.downtime_hrs) == (10001, 101)
    plan = stats._jdf.queryExecution().executedPlan().toString()
    window = plan.index("Window ")
    assert "partial_count" in plan[window:] and "HashAggregate" in plan[window:]
