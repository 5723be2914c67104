"""Uptime, time between failures and health of centers, from merged failure intervals."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.filters import Filters, where
from fleetlens.functions import time as tm
from fleetlens.operators.tickets import center_ticket_stats, failure_tickets
from fleetlens.sources.tables import Tables


def failure_intervals(tables: Tables, as_of: datetime) -> DataFrame:
    """One interval per failure ticket; an open ticket lasts until ``as_of``."""
    return failure_tickets(tables.cleaned()).select(
        F.col("CenterID").alias("center_id"),
        F.col("CreatedAt").alias("start"),
        F.coalesce("ClosedAt", tm.moment(as_of)).alias("end"),
    )


def _merge(intervals: DataFrame, keys: Sequence[str]) -> DataFrame:
    ordered = Window.partitionBy(*keys).orderBy("start")
    earlier = F.max("end").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.col("_earlier").isNull() | (F.col("start") > F.col("_earlier"))
    island = F.sum(F.col("_begins").cast("int")).over(ordered.rowsBetween(Window.unboundedPreceding, 0))
    return (
        intervals.withColumn("_earlier", earlier)
        .withColumn("_begins", begins)
        .withColumn("_island", island)
        .groupBy(*keys, "_island")
        .agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n").alias("n"))
        .drop("_island")
    )


def merge_intervals(intervals: DataFrame, key: str) -> DataFrame:
    """Union of the intervals of each key as disjoint islands; touching intervals merge.

    ``n`` counts the intervals in an island. An interval that ends before it starts covers nothing, yet counts:
    in the island its start lies in, else as an island of its own. The union is taken in steps, so no task ever sorts all intervals of a busy key: intervals with
    one start collapse in the map side, then each day of starts merges on its own, then the few islands left.
    """
    collapsed = (
        intervals.groupBy(key, "start")
        .agg(F.max("end").alias("end"), F.count("*").alias("n"))
        .withColumn("_day", F.col("start").cast("date"))
    )
    return _merge(_merge(collapsed, [key, "_day"]).drop("_day"), [key])


def island_downtime(islands: DataFrame) -> DataFrame:
    """Downtime hours per center as the sum over its islands."""
    hours = F.greatest(F.lit(0).cast("bigint"), tm.hours_between("start", "end"))
    return islands.groupBy("center_id").agg(F.count("*").alias("islands"), F.sum(hours).alias("downtime_hrs"))


def births(tables: Tables, filters: Filters = Filters()) -> DataFrame:
    """First deployment of each center that passes the filters."""
    dated = where(
        tables.centers.filter("deploymentdate IS NOT NULL"), filters.center(), filters.dates("deploymentdate")
    )
    return dated.groupBy(F.col("CenterID").alias("center_id")).agg(
        F.min("deploymentdate").cast("timestamp_ntz").alias("birth")
    )


def window_births(tables: Tables) -> DataFrame:
    """First start of each center in the deployment windows."""
    return (
        tables.deployments.filter("startdatetime IS NOT NULL")
        .groupBy(F.col("centerid").alias("center_id"))
        .agg(F.min("startdatetime").alias("birth"))
    )


def uptime_percent(life: Column, down: Column) -> Column:
    share = F.least(F.lit(100.0), F.greatest(F.lit(0.0), (life - down) / life * 100))
    return F.when(life != 0, F.round(share, 2))


def mtbf_hours(life: Column, down: Column, failures: Column) -> Column:
    up = F.greatest(F.lit(0).cast("bigint"), life - down)
    return F.when(failures >= 2, F.round(up / failures, 1))


def health_score(uptime: Column, mtbf: Column, failures: Column) -> Column:
    """Half the uptime, plus a tier for time between failures, plus a tier for the number of failures."""
    spacing = (
        F.when(failures == 0, 30).when(failures == 1, 20).when(mtbf > 720, 30).when(mtbf >= 168, 20).otherwise(5)
    )
    count = F.when(failures == 0, 20).when(failures <= 2, 15).when(failures <= 5, 10).otherwise(5)
    return F.round(0.5 * uptime + spacing + count, 0)


def with_scores(rows: DataFrame, as_of: datetime) -> DataFrame:
    """Add the scores to rows that carry birth, downtime_hrs and failures; without a birth they are NULL."""
    life, down, failures = F.col("life_hrs"), F.col("downtime_hrs"), F.col("failures")
    zero = F.lit(0).cast("bigint")
    born = F.col("birth").isNotNull()
    return (
        rows.withColumns({
            "life_hrs": tm.hours_between("birth", tm.moment(as_of)),
            "downtime_hrs": F.when(born, F.coalesce(down, zero)),
            "failures": F.when(born, F.coalesce(failures, zero)),
        })
        .withColumns({"uptime_pct": uptime_percent(life, down), "mtbf_hrs": mtbf_hours(life, down, failures)})
        .withColumn("health_score", health_score(F.col("uptime_pct"), F.col("mtbf_hrs"), failures))
    )


def score(born: DataFrame, stats: DataFrame, as_of: datetime) -> DataFrame:
    """Score every born center; one without failures has been up all its life."""
    joined = born.join(stats.select("center_id", "downtime_hrs", "failures"), "center_id", "left")
    return with_scores(joined, as_of).drop("birth")


def scored(
    tables: Tables, as_of: datetime, filters: Filters = Filters(), stats: DataFrame | None = None
) -> DataFrame:
    """Scores of the centers that pass the filters; ``stats`` are per-center ticket statistics, if at hand."""
    known = center_ticket_stats(tables.cleaned(), as_of) if stats is None else stats
    return score(births(tables, filters), known, as_of)


def scored_by_window(tables: Tables, as_of: datetime) -> DataFrame:
    """The same scores with the birth taken from deployment windows."""
    return score(window_births(tables), center_ticket_stats(tables.cleaned(), as_of), as_of)


def worst_first() -> list[Column]:
    """The order of the reliability list."""
    return [F.col("uptime_pct").asc_nulls_first(), F.col("centerid").asc_nulls_first()]


def reliability(scores: DataFrame, limit: int | None = None) -> DataFrame:
    """Lowest uptime first."""
    rows = scores.select(
        F.col("center_id").alias("centerid"),
        "uptime_pct",
        F.round(100 - F.col("uptime_pct"), 1).alias("downtime_pct"),
        "failures",
        F.round(F.col("life_hrs") / 24, 0).alias("life_days"),
    ).orderBy(*worst_first())
    return rows.limit(limit) if limit else rows


def fleet(scores: DataFrame) -> DataFrame:
    uptime, health = F.col("uptime_pct"), F.col("health_score")
    return scores.agg(
        F.count("*").alias("scored"),
        F.round(F.avg(uptime), 1).alias("avg_uptime"),
        F.round(F.try_divide(F.count_if(uptime >= 99), F.count("*")) * 100, 1).alias("pct99"),
        F.round(F.avg("mtbf_hrs") / 24, 1).alias("avg_mtbf_days"),
        F.round(F.avg(health), 1).alias("avg_health"),
        F.round(F.try_divide(F.count_if(health >= 80), F.count("*")) * 100, 1).alias("pct_healthy"),
        F.round(F.avg("life_hrs") / 24 / 365, 1).alias("avg_life_years"),
        F.round(F.avg("downtime_hrs") / 24, 1).alias("avg_downtime_days"),
    )


def health_watchlist(scores: DataFrame, limit: int | None = None) -> DataFrame:
    """Lowest health first."""
    rows = scores.select(
        F.col("center_id").alias("centerid"), "uptime_pct", "mtbf_hrs", "failures", "health_score"
    ).orderBy(F.col("health_score").asc_nulls_first(), "centerid")
    return rows.limit(limit) if limit else rows


def lifecycle_columns() -> list[Column]:
    return [
        F.round(F.col("life_hrs") / 24 / 365, 2).alias("lifecycle_years"),
        F.round(F.col("downtime_hrs") / 24, 1).alias("downtime_days"),
        F.col("uptime_pct"),
        F.col("mtbf_hrs"),
    ]


def lifecycle(scores: DataFrame) -> DataFrame:
    return scores.select("center_id", *lifecycle_columns(), "failures")
