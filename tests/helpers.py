from __future__ import annotations

from datetime import datetime

TICKET_SCHEMA = (
    "ticketNumber bigint, CenterID bigint, HubID bigint, HubName string, hub_master_segment string, CreatedAt timestamp_ntz, "
    "ClosedAt timestamp_ntz, status string, IssueCategory string, assignee string, priority string, subject string, TicketLink string"
)
CENTER_SCHEMA = (
    "CenterID bigint, Centername string, HubID bigint, HubName string, City string, State string, PinCode string, hub_country string, "
    "hub_master_segment string, Status string, Billable string, MachineType string, DeviceID string, MacSerialID string, Type string, "
    "Spoke_Center_Segment string, deploymentdate date, deactivationdate date"
)
REGISTER_SCHEMA = "issue_key string, summary string, customerid string, status_name string, issuetype_name string, ticket_created timestamp_ntz"
HEARTBEAT_SCHEMA = "DeviceID string, CenterID bigint"


def names(schema: str) -> list[str]:
    return [part.split()[0] for part in schema.split(",")]


def frame(spark, schema: str, *rows: dict):
    """A DataFrame of ``schema`` from partial rows; missing columns are NULL."""
    columns = names(schema)
    return spark.createDataFrame([tuple(r.get(c) for c in columns) for r in rows], schema)


def ticket(number, center=1, created="2001-01-01 00:00:00", closed=None, status="Open", category="Battery", assignee="A", **more):
    def at(text):
        return datetime.fromisoformat(text) if text else None

    return {"ticketNumber": number, "CenterID": center, "CreatedAt": at(created), "ClosedAt": at(closed), "status": status,
            "IssueCategory": category, "assignee": assignee, **more}


def rows(df, *columns):
    return sorted(tuple(r) for r in (df.select(*columns) if columns else df).collect())
