"""Cleaned views over the raw tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.functions.classify import segment_group
from fleetlens.functions.text import blank_to_null, clean

# Columns every metric may rest on. They decide, in this order, between copies created at the same time.
TICKET_CORE = ("ticketNumber", "CenterID", "CreatedAt", "ClosedAt", "status", "IssueCategory")

# Column the mart of cleaned tickets is partitioned by: months since year 0 of the creation time.
TICKET_MONTH = "created_month"


def cleaned_tickets(tickets: DataFrame, *extra: str) -> DataFrame:
    """Assigned tickets, latest copy per ticket number; tickets without a number never merge.

    Only the core columns and ``extra`` are read. Copies that tie on creation time are ordered by the
    core columns, then by ``extra``, so the surviving row does not depend on partitioning. The rank
    filter is pushed into the map side as a group limit, so a ticket with very many copies is reduced
    before the shuffle. A ticket without a number gets the number of its row as a key of its own: it stays,
    its exact copies too, such tickets spread over all partitions, and the table is scanned once.
    """
    extras = sorted(set(extra) - set(TICKET_CORE))
    assigned = tickets.filter(blank_to_null("assignee").isNotNull()).select(*TICKET_CORE, *extras)
    order = [
        F.col("CreatedAt").desc_nulls_last(),
        F.col("ClosedAt").desc_nulls_last(),
        *(F.col(c).asc_nulls_first() for c in ("status", "IssueCategory", "CenterID", *extras)),
    ]
    lone = F.when(F.col("ticketNumber").isNull(), F.monotonically_increasing_id())
    copies = Window.partitionBy("ticketNumber", "_lone").orderBy(*order)
    return (
        assigned.withColumn("_lone", lone)
        .withColumn("_copy", F.row_number().over(copies))
        .filter(F.col("_copy") == 1)
        .drop("_lone", "_copy")
    )


def register_devices(register: DataFrame) -> DataFrame:
    """One row per register entry: the changelog fan-out collapsed."""
    return (
        register.filter(F.col("issue_key").isNotNull())
        .groupBy("issue_key")
        .agg(
            *(F.min(c).alias(c) for c in ("summary", "customerid", "status_name", "issuetype_name")),
            F.min("ticket_created").alias("ticket_created"),
        )
    )


def center_dimension(centers: DataFrame) -> DataFrame:
    """Distinct centers with normalised attributes.

    A center whose rows differ keeps one row per distinct set of attributes.
    """
    return centers.select(
        F.col("CenterID").alias("center_id"),
        F.col("Centername").alias("center"),
        F.col("HubID").alias("hub_id"),
        clean("HubName").alias("hub"),
        clean("City").alias("city"),
        clean("State").alias("state"),
        F.col("PinCode").alias("pin"),
        clean("hub_country").alias("country"),
        segment_group("hub_master_segment").alias("segment"),
        clean("Status").alias("status"),
        clean("Billable").alias("billable"),
        clean("MachineType").alias("machine_type"),
        clean("DeviceID").alias("device_id"),
        clean("MacSerialID").alias("mac_serial_id"),
        F.col("deploymentdate").cast("date").alias("deployment_date"),
    ).distinct()


def one_row_per_center(dimension: DataFrame) -> DataFrame:
    """The dimension reduced to one row per center: the first one in column order."""
    columns = [c for c in dimension.columns if c != "center_id"]
    first = F.min(F.struct(*columns)).alias("r")
    return dimension.groupBy("center_id").agg(first).select("center_id", "r.*")
