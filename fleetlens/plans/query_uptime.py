"""Uptime queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.operators import sketches
from fleetlens.operators import uptime as up
from fleetlens.plans.check_sql import stamp
from fleetlens.plans.registry import query
from fleetlens.sources.proxy import TICKETS_AS_OF
from fleetlens.sources.tables import Tables


@query("U1_failure_intervals", f"SELECT center_id, {stamp('s')} AS start, {stamp('e')} AS \"end\" FROM o_failures")
def _(t: Tables) -> DataFrame:
    return up.failure_intervals(t, TICKETS_AS_OF)


@query("U2_merged_intervals", f"""
SELECT center_id, {stamp('ss')} AS start, {stamp('se')} AS "end", CAST(n AS BIGINT) AS n FROM o_islands""")
def _(t: Tables) -> DataFrame:
    return up.merge_intervals(up.failure_intervals(t, TICKETS_AS_OF), "center_id")


@query("U3_downtime", """
SELECT center_id, COUNT(*) AS islands, CAST(SUM(GREATEST(0, date_diff('hour', ss, se))) AS BIGINT) AS downtime_hrs
FROM o_islands GROUP BY center_id""")
def _(t: Tables) -> DataFrame:
    return up.island_downtime(up.merge_intervals(up.failure_intervals(t, TICKETS_AS_OF), "center_id"))


@query("U3_downtime_by_words", """
SELECT center_id, CAST(SUM(GREATEST(0, date_diff('hour', ss, se))) AS BIGINT) AS downtime_hrs FROM o_islands GROUP BY center_id""")
def _(t: Tables) -> DataFrame:
    return sketches.word_downtime(sketches.downtime_parts(up.failure_intervals(t, TICKETS_AS_OF)))


@query("U4_births", f"SELECT center_id, {stamp('birth')} AS birth FROM o_births")
def _(t: Tables) -> DataFrame:
    return up.births(t)


@query("U5_uptime_mtbf", "SELECT center_id, life_hrs, downtime_hrs, failures, uptime_pct, mtbf_hrs FROM o_scored")
def _(t: Tables) -> DataFrame:
    return up.scored(t, TICKETS_AS_OF).drop("health_score")


@query("U6_health_score", "SELECT center_id, health_score FROM o_scored")
def _(t: Tables) -> DataFrame:
    return up.scored(t, TICKETS_AS_OF).select("center_id", "health_score")


def _reliability(scores: str, tail: str = "") -> str:
    return f"""
FROM {scores} SELECT center_id AS centerid, failures, uptime_pct, ROUND(100 - uptime_pct, 1) AS downtime_pct,
  ROUND(life_hrs / 24.0) AS life_days ORDER BY uptime_pct NULLS FIRST, center_id {tail}"""


@query("U7_reliability", _reliability("o_scored"))
def _(t: Tables) -> DataFrame:
    return up.reliability(up.scored(t, TICKETS_AS_OF))


def _fleet(scores: str) -> str:
    return f"""
WITH m AS (
  SELECT COUNT(*) AS scored, AVG(uptime_pct) AS up, AVG(mtbf_hrs) / 24 AS apart, AVG(health_score) AS health, AVG(life_hrs) / 24 AS days,
    AVG(downtime_hrs) / 24 AS down, AVG(COALESCE(uptime_pct >= 99, FALSE)::INT) * 100 AS up99,
    AVG(COALESCE(health_score >= 80, FALSE)::INT) * 100 AS well
  FROM {scores})
SELECT scored, ROUND(up, 1) AS avg_uptime, ROUND(up99, 1) AS pct99, ROUND(apart, 1) AS avg_mtbf_days, ROUND(health, 1) AS avg_health,
  ROUND(well, 1) AS pct_healthy, ROUND(days / 365, 1) AS avg_life_years, ROUND(down, 1) AS avg_downtime_days FROM m"""


@query("U8_fleet_uptime", _fleet("o_scored"))
def _(t: Tables) -> DataFrame:
    return up.fleet(up.scored(t, TICKETS_AS_OF))


def _watchlist(scores: str, tail: str = "") -> str:
    return f"""
FROM {scores} SELECT health_score, failures, mtbf_hrs, uptime_pct, center_id AS centerid
ORDER BY health_score NULLS FIRST, center_id {tail}"""


@query("U9_health_watchlist", _watchlist("o_scored"))
def _(t: Tables) -> DataFrame:
    return up.health_watchlist(up.scored(t, TICKETS_AS_OF))


@query("U10_lifecycle", """
SELECT center_id, ROUND(life_hrs / 24 / 365, 2) AS lifecycle_years, ROUND(downtime_hrs / 24, 1) AS downtime_days, uptime_pct,
  mtbf_hrs, failures FROM o_scored""")
def _(t: Tables) -> DataFrame:
    return up.lifecycle(up.scored(t, TICKETS_AS_OF))


@query("U11_window_fleet", _fleet("o_window_scored"))
def _(t: Tables) -> DataFrame:
    return up.fleet(up.scored_by_window(t, TICKETS_AS_OF))


@query("U11_window_reliability", _reliability("o_window_scored", "LIMIT 12"))
def _(t: Tables) -> DataFrame:
    return up.reliability(up.scored_by_window(t, TICKETS_AS_OF), 12)


@query("U11_window_watchlist", _watchlist("o_window_scored", "LIMIT 12"))
def _(t: Tables) -> DataFrame:
    return up.health_watchlist(up.scored_by_window(t, TICKETS_AS_OF), 12)
