"""Materialised marts: built once, refreshed where their inputs changed, and read in place of what they are built from.

``build_marts`` writes all marts under a folder. ``refresh_marts`` compares stored hashes with those of the inputs and
writes only what differs:

* Tickets are hashed by ranges of ticket numbers (all copies of a ticket share one). Only changed ranges are cleaned
  again, and of the cleaned tickets only the months are rewritten in which rows came, went or changed.
* A center's inputs are its cleaned tickets and its rows of the other tables. Centers whose hash differs name the buckets
  of the center marts that are computed again, from these buckets' rows alone.
* A small mart is written again when one of the marts it is read from was, or when its own inputs changed.

Partitions are replaced by dynamic partition overwrite; those that lost their last row are removed. A refresh that did not
end leaves a mark, and the next one then recomputes all center buckets. One refresh of a folder runs at a time, and readers
that must not see partitions change use ``center_mart`` and its like, whose versions stay as they are.

Where disk is short, tickets are cleaned and months rewritten in ``parts``, one after another, so that the shuffle files of
one part lie on disk at a time (see ``sparing_disk``). Every part reads the tickets anew: give a table, not a view that
joins. What a refresh writes apart is deleted when it ends.
"""

from __future__ import annotations

import hashlib
import json
import math
import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import asdict, dataclass, field
from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.filters import DEFAULT_FILTERS, Filters
from fleetlens.functions import time as tm
from fleetlens.operators import centers as ct
from fleetlens.operators import devices as dv
from fleetlens.operators import geo, rollups
from fleetlens.operators import tickets as tk
from fleetlens.operators import uptime as up
from fleetlens.session import file_bytes, remove, shared_folder
from fleetlens.sources.catalog import MartCatalog, input_version
from fleetlens.sources.cleaned import TICKET_CORE, TICKET_MONTH, cleaned_tickets
from fleetlens.sources.tables import Tables

# Ticket columns the queries show or filter on, beyond the core ones.
TICKET_EXTRAS = ("HubID", "HubName", "TicketLink", "assignee", "hub_master_segment", "priority", "subject")
TICKET_RANGES = 512  # ranges of ticket numbers at the first build
LONE_RANGES = 64  # ranges of tickets without a number, by hash
CENTER_BUCKETS = 64
PART_BYTES = 32 << 20  # of ticket files that are cleaned in one part, in MOST_PARTS parts at most, as each reads all of them
MOST_PARTS = 8
BUCKET = "center_bucket"
_RANGE = "ticket_range"
CENTER_INPUTS = ("center_details", "heartbeats", "device_register", "support_tickets")


# Marts by version, for queries


def center_mart(tables: Tables, as_of: datetime, heartbeats_as_of: datetime | None = None, catalog: MartCatalog | None = None) -> DataFrame:
    """The center mart, read; it is built when these inputs and moments are first asked for."""
    given = tables.mart("center_360")
    if given is not None:
        return given
    catalog = catalog or MartCatalog(tables.spark)
    version = input_version(tables.spark, tables.inputs(*CENTER_INPUTS), as_of=as_of, seen=heartbeats_as_of)
    return catalog.resolve("center_360", version, lambda: ct.center_360(tables, as_of, heartbeats_as_of))


def located_mart(tables: Tables, as_of: datetime, heartbeats_as_of: datetime | None = None, catalog: MartCatalog | None = None) -> DataFrame:
    """The center mart with coordinates: every row is placed once, whoever asks."""
    given = tables.mart("located_centers")
    if given is not None:
        return given
    catalog = catalog or MartCatalog(tables.spark)
    version = input_version(tables.spark, tables.inputs(*CENTER_INPUTS, "geo_store"), as_of=as_of, seen=heartbeats_as_of)
    return catalog.resolve(
        "located_centers", version, lambda: geo.with_coordinates(center_mart(tables, as_of, heartbeats_as_of, catalog), tables.geo_store)
    )


def with_ticket_marts(tables: Tables, catalog: MartCatalog | None = None) -> Tables:
    """The tables with cleaned tickets by month and open tickets by the hour they turn critical; neither depends on a moment."""
    if tables.mart("open_tickets") is not None and tables.mart("cleaned_tickets") is not None:
        return tables
    catalog = catalog or MartCatalog(tables.spark)
    version = input_version(tables.spark, tables.inputs("support_tickets"))
    cleaned = catalog.resolve("cleaned_tickets", version, lambda: by_month(tables.cleaned(*TICKET_EXTRAS)), partition=TICKET_MONTH)
    known = tables.replacing({"cleaned_tickets": cleaned})
    opened = catalog.resolve("open_tickets", version, lambda: tk.open_tickets(known))
    return known.replacing({"open_tickets": opened})


def by_month(cleaned: DataFrame) -> DataFrame:
    """Cleaned tickets ready to be written by month of creation, each file a range of centers."""
    order = [TICKET_MONTH, "CenterID", "CreatedAt"]
    return cleaned.withColumn(TICKET_MONTH, tm.month_number("CreatedAt")).repartitionByRange(*order).sortWithinPartitions(*order)


# A folder of marts, refreshed


@dataclass(frozen=True)
class Change:
    """What a refresh did to a mart: ``kept``, ``partitions`` (some of them written again) or ``written`` as a whole."""

    mart: str
    action: str
    partitions: tuple = ()


@dataclass
class _State:
    """What the marts in a folder were built from."""

    complete: bool = False
    width: int = 0
    tokens: dict[str, str] = field(default_factory=dict)
    schemas: dict[str, str] = field(default_factory=dict)  # a mart without rows has no file to tell its columns


def _row_hash(columns: Sequence[str], salt: str = "") -> Column:
    return F.xxhash64(F.lit(salt), *(F.col(f"`{c}`") for c in columns))


def _hash_sums(h: Column) -> list[Column]:
    """Number of rows and two sums that any changed, added or removed row alters, in whatever order rows come."""
    return [
        F.count("*").alias("n"), F.sum(h.bitwiseAND(0xFFFFFFFF)).alias("low"), F.sum(F.shiftrightunsigned(h, 32)).alias("high"),
    ]


def _tokens(frames: dict[str, DataFrame]) -> dict[str, str]:
    """The content of each frame as one text, from one pass over all of them."""
    sums = None
    for name, df in frames.items():
        own = df.agg(*_hash_sums(_row_hash(sorted(df.columns)))).select(F.lit(name).alias("name"), "n", "low", "high")
        sums = own if sums is None else sums.unionAll(own)
    return {r["name"]: str((r["n"], r["low"], r["high"])) for r in sums.collect()}


def _differing(before: DataFrame | None, now: DataFrame, key: str) -> DataFrame:
    """Keys whose sums are not the same on both sides, or that one side lacks."""
    if before is None:
        return now.select(key)
    old = before.select(F.col(key).alias("_old"), *(F.col(c).alias(f"_{c}") for c in ("n", "low", "high")))
    same = F.col(key).eqNullSafe(F.col("_old")) & (F.col("n") == F.col("_n")) & (F.col("low") == F.col("_low")) & (F.col("high") == F.col("_high"))
    joined = now.join(old, F.col(key).eqNullSafe(F.col("_old")), "full_outer")
    return joined.filter(~F.coalesce(same, F.lit(False))).select(F.coalesce(key, "_old").alias(key))


def _one_of(column: str, values: Sequence) -> Column:
    known = [v for v in values if v is not None]
    found = F.col(column).isin(known)
    return found | F.col(column).isNull() if len(known) < len(values) else found


def ticket_parts(spark: SparkSession, path: str) -> int:
    """In how many parts the tickets written under ``path`` are cleaned."""
    return max(1, min(MOST_PARTS, -(-file_bytes(spark, path) // PART_BYTES)))


def _cleaned_parts(tickets: DataFrame, parts: int) -> Iterator[DataFrame]:
    """Cleaned tickets as so many frames: all copies of a ticket are in one, tickets without a number are dealt by content."""
    number = F.col("ticketNumber")
    dealt = F.pmod(F.when(number.isNull(), _row_hash(sorted({*TICKET_CORE, *TICKET_EXTRAS}))).otherwise(F.xxhash64(number)), F.lit(parts))
    for part in range(parts):
        yield cleaned_tickets(tickets.filter(dealt == part) if parts > 1 else tickets, *TICKET_EXTRAS)


def _in_turn(values: Sequence, parts: int) -> list[list]:
    """``values`` in order, as at most so many lists of about one length."""
    ordered = sorted(values, key=lambda v: (v is not None, v))
    size = max(1, -(-len(ordered) // parts))
    return [ordered[i : i + size] for i in range(0, len(ordered), size)]


# Marts that are read from others: name -> (what their content depends on, how they are built). ``m`` holds the marts.
_DERIVED: dict[str, tuple[tuple[str, ...], Callable]] = {
    "devices": (("index", "center_details"), lambda m, t, a, f: dv.filtered_devices(t, a, f, m("device_index"))),
    "reliability": (("tickets", "centers"), lambda m, t, a, f: ct.named(up.reliability(m("scores")), m("center_360"))),
    "fleet_uptime": (("tickets", "centers"), lambda m, t, a, f: up.fleet(m("scores"))),
    "sla_kpis": (("tickets", "center_details"), lambda m, t, a, f: tk.sla_kpis(t, a, f)),
    "customers_tree": (("tickets", "centers"), lambda m, t, a, f: rollups.customers_tree(m("center_360"), f)),
    "devices_tree": (("index", "center_details"), lambda m, t, a, f: rollups.devices_tree(m("devices"))),
    "tickets_tree": (("tickets", "center_details", "field_service", "escalations"), lambda m, t, a, f: rollups.tickets_tree(t, f)),
    "map_points": (("tickets", "centers", "geo_store"), lambda m, t, a, f: geo.map_points(m("center_360"), t.geo_store, f)),
    "accounts": (("tickets", "centers", "geo_store"), lambda m, t, a, f: rollups.accounts(m("center_360"), t.geo_store, f)),
}


def build_marts(
    tables: Tables, as_of: datetime, folder: str, heartbeats_as_of: datetime | None = None, filters: Filters = DEFAULT_FILTERS, parts: int = 1,
) -> dict[str, str]:
    """Write every mart as plain Parquet under ``folder`` and return their paths; tickets are cleaned in ``parts``."""
    spark = tables.spark
    paths: dict[str, str] = {}

    def write(name: str, *frames: DataFrame) -> DataFrame:
        paths[name] = f"{folder}/{name}"
        for i, df in enumerate(frames):
            df.write.mode("append" if i else "overwrite").parquet(paths[name])
        return spark.read.parquet(paths[name])

    # Copies are collapsed once; everything about tickets reads the result.
    # Ranges of center and time let a reader skip to one center, and split a center that holds very many rows.
    ranges = ["CenterID", "CreatedAt"]
    known = tables.mart("cleaned_tickets")
    found = _cleaned_parts(tables.tickets, parts) if known is None else [tables.cleaned(*TICKET_EXTRAS)]
    cleaned = write("cleaned_tickets", *(df.repartitionByRange(*ranges).sortWithinPartitions(*ranges) for df in found))
    tables = tables.replacing({"cleaned_tickets": cleaned})
    stats = write("center_tickets", tk.center_ticket_stats(cleaned, as_of))
    index = write("device_index", dv.device_index(tables, as_of))
    write("center_360", ct.center_360(tables, as_of, heartbeats_as_of, stats=stats, devices=index))
    write("scores", up.scored(tables, as_of, filters, stats))
    # Centers are placed once for the marts that show coordinates; this table is theirs and no mart of its own.
    placed = f"{folder}/_located"
    geo.with_coordinates(spark.read.parquet(paths["center_360"]), tables.geo_store).write.mode("overwrite").parquet(placed)
    whole = (tables, dict(paths))
    on_map = (tables.replacing({"geo_store": None}), paths | {"center_360": placed})
    for name, (sources, build) in _DERIVED.items():
        known, places = on_map if "geo_store" in sources else whole
        write(name, build(lambda mart, places=places: spark.read.parquet({**paths, **places}[mart]), known, as_of, filters))
    return paths


class MartFolder:
    """Marts under one folder, with the hashes of what they were built from."""

    def __init__(self, spark: SparkSession, folder: str, ranges: int = TICKET_RANGES, buckets: int = CENTER_BUCKETS, parts: int = 1):
        self.spark, self.folder, self.ranges, self.buckets, self.parts = spark, folder.rstrip("/"), ranges, buckets, parts
        self.changes: list[Change] = []
        self._passing: list[str] = []  # what was written apart, until the refresh ends
        self._schemas: dict[str, str] | None = None

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def read(self, name: str) -> DataFrame:
        if self._schemas is None:
            self._schemas = self._state().schemas
        return self.spark.read.schema(T.StructType.fromJson(json.loads(self._schemas[name]))).parquet(self.path(name))

    def _holds(self, name: str, df: DataFrame) -> None:
        if self._schemas is None:
            self._schemas = self._state().schemas
        self._schemas[name] = df.schema.json()

    def _state(self) -> _State:
        try:
            return _State(**json.loads(self.spark.read.text(self.path("_state")).first()[0]))
        except AnalysisException:
            return _State()

    def _keep_state(self, state: _State) -> None:
        self.spark.range(1).select(F.lit(json.dumps(asdict(state))).alias("value")).write.mode("overwrite").text(self.path("_state"))

    def _write(self, name: str, df: DataFrame) -> None:
        self._holds(name, df)
        df.write.mode("overwrite").parquet(self.path(name))
        self.changes.append(Change(name, "written"))

    def _stored(self, *frames: DataFrame) -> tuple[DataFrame, str]:
        path = self.path(f"_staged/{uuid.uuid4().hex}")
        for df in frames:
            df.write.mode("append").parquet(path)
        return self.spark.read.schema(frames[0].schema).parquet(path), path

    def _staged(self, *frames: DataFrame) -> DataFrame:
        """Frames written apart, one after another: they may rest on the very partitions that are to be replaced."""
        df, path = self._stored(*frames)
        self._passing.append(path)
        return df

    def _replace(self, name: str, df: DataFrame, column: str, values: Sequence) -> DataFrame:
        """Write the partitions ``values`` of a mart anew; one that has no rows any more is removed."""
        staged = self._staged(df)
        self._holds(name, staged)
        fresh = {r[0] for r in staged.select(column).distinct().collect()}
        staged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(column).parquet(self.path(name))
        for value in set(values) - fresh:
            self._drop_partition(name, column, value)
        self.changes.append(Change(name, "partitions", tuple(sorted(values, key=str))))
        return staged.drop(column)

    def _drop_partition(self, name: str, column: str, value: object) -> None:
        remove(self.spark, f"{self.path(name)}/{column}={'__HIVE_DEFAULT_PARTITION__' if value is None else value}")

    def mart(self, name: str) -> DataFrame:
        """A mart as its builder returned it, without the columns that only place its rows."""
        return self.read(name).drop(BUCKET, _RANGE)

    def paths(self) -> dict[str, str]:
        return {name: self.path(name) for name in ("cleaned_tickets", "center_tickets", "device_index", "center_360", "scores", *_DERIVED)}

    def refresh(self, tables: Tables, as_of: datetime, heartbeats_as_of: datetime | None = None, filters: Filters = DEFAULT_FILTERS) -> list[Change]:
        """Bring all marts to what ``tables`` hold now; what was done to each."""
        self.changes, self._passing = [], []
        before = self._state()
        if not before.complete:
            before = _State()
        self._keep_state(_State())  # until this ends, no mart can be relied upon
        tokens = _tokens(tables.inputs("center_details", "heartbeats", "device_register", "field_service", "escalations", "geo_store"))
        tokens["settings"] = str((as_of, heartbeats_as_of, filters, self.ranges, self.buckets))
        same_settings = tokens["settings"] == before.tokens.get("settings")

        width, moved = self._refresh_tickets(tables.tickets, before, tokens)
        cleaned = self.read("cleaned_tickets")
        known = tables.replacing({"cleaned_tickets": cleaned})
        tokens["index"] = "|".join(tokens[t] for t in ("device_register", "heartbeats", "center_details", "settings"))
        if tokens["index"] == before.tokens.get("index"):
            self.changes.append(Change("device_index", "kept"))
        else:
            self._write("device_index", dv.device_index(known, as_of))
        index = self.read("device_index")
        changed = self._changed_centers(known, index, before, tokens)
        changed = moved.unionAll(changed) if moved is not None else changed

        bucket = self._bucket("center_id")
        touched = [r[0] for r in changed.select(bucket.alias("b")).distinct().collect()] if same_settings else list(range(self.buckets))
        self._refresh_centers(known, index, touched, as_of, heartbeats_as_of, filters)
        for name, (sources, build) in _DERIVED.items():
            token = hashlib.sha256("|".join(tokens[s] for s in (*sources, "settings")).encode()).hexdigest()
            if token == before.tokens.get(name):
                self.changes.append(Change(name, "kept"))
            else:
                self._write(name, build(self.mart, known, as_of, filters))
            tokens[name] = token
        self._keep_state(_State(True, width, tokens, self._schemas))
        for path in (*self._passing, *(before.tokens[sums] for sums in ("ranges", "center_sums") if sums in before.tokens)):
            remove(self.spark, path)
        return self.changes

    def _bucket(self, c: str) -> Column:
        return F.pmod(F.xxhash64(F.col(c).cast("bigint")), F.lit(self.buckets)).cast("int")

    def _refresh_tickets(self, tickets: DataFrame, before: _State, tokens: dict[str, str]) -> tuple[int, DataFrame | None]:
        """Clean changed ranges of ticket numbers again and rewrite the months that differ. The range width, and the
        centers whose cleaned tickets changed (None where there was nothing before)."""
        columns = sorted({"ticketNumber", "CenterID", "CreatedAt", "ClosedAt", "status", "IssueCategory", *TICKET_EXTRAS})
        tickets = tickets.select(*columns)
        width = before.width
        if not width:
            least, most = tickets.agg(F.min("ticketNumber"), F.max("ticketNumber")).first()
            width = max(1, -(-((most or 0) - (least or 0) + 1) // self.ranges))
        lone = -1 - F.pmod(_row_hash(columns), F.lit(LONE_RANGES))
        place = F.when(F.col("ticketNumber").isNull(), lone).otherwise(F.floor(F.col("ticketNumber") / width)).cast("bigint")
        ranged = tickets.withColumn(_RANGE, place)
        sums, tokens["ranges"] = self._stored(ranged.groupBy(_RANGE).agg(*_hash_sums(_row_hash(columns))))
        tokens |= _tokens({"tickets": sums})
        old_sums = self.spark.read.schema(sums.schema).parquet(before.tokens["ranges"]) if "ranges" in before.tokens else None
        if old_sums is None:
            for i, part in enumerate(_cleaned_parts(tickets, self.parts)):
                cleaned = by_month(part.withColumn(_RANGE, place))
                self._holds("cleaned_tickets", cleaned)
                cleaned.write.mode("append" if i else "overwrite").partitionBy(TICKET_MONTH).parquet(self.path("cleaned_tickets"))
            self.changes.append(Change("cleaned_tickets", "written"))
            return width, None
        touched = [r[0] for r in _differing(old_sums, sums, _RANGE).collect()]
        if not touched:
            self.changes.append(Change("cleaned_tickets", "kept"))
            return width, None
        again, share = ranged.filter(F.col(_RANGE).isin(touched)).select(*columns), min(1, len(touched) / max(1, sums.count()))
        fresh = self._staged(*(
            part.withColumn(_RANGE, place).withColumn(TICKET_MONTH, tm.month_number("CreatedAt"))
            for part in _cleaned_parts(again, math.ceil(self.parts * share))
        ))
        whole = self.read("cleaned_tickets").select(fresh.columns)
        stale = whole.filter(F.col(_RANGE).isin(touched))
        by = lambda rows, key: rows.groupBy(key).agg(*_hash_sums(_row_hash(columns)))
        months = [r[0] for r in _differing(by(stale, TICKET_MONTH), by(fresh, TICKET_MONTH), TICKET_MONTH).collect()]
        named = F.col("CenterID").alias("center_id")
        moved = self._staged(_differing(by(stale.withColumn("center_id", named), "center_id"), by(fresh.withColumn("center_id", named), "center_id"), "center_id"))
        for some in _in_turn(months, self.parts):
            self._replace_months(some, touched, fresh)
        self.changes.append(Change("cleaned_tickets", "partitions", tuple(sorted(months, key=str))))
        return width, moved

    def _replace_months(self, months: Sequence, touched: Sequence[int], fresh: DataFrame) -> None:
        """Write months of the cleaned tickets anew, from their rows of untouched ranges and the ``fresh`` ones. Spark replaces
        partitions when all tasks have ended, so they are read and replaced in one job, and no copy of them is written apart."""
        name, order, these = "cleaned_tickets", [TICKET_MONTH, "CenterID", "CreatedAt"], _one_of(TICKET_MONTH, months)
        kept = self.read(name).select(fresh.columns).filter(these & ~F.col(_RANGE).isin(touched))
        rows = kept.unionByName(fresh.filter(these))
        left = {r[0] for r in rows.select(TICKET_MONTH).distinct().collect()}
        if left:
            parts = rows.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            parts.partitionBy(TICKET_MONTH).parquet(self.path(name))
        for month in set(months) - left:
            self._drop_partition(name, TICKET_MONTH, month)

    def _changed_centers(self, tables: Tables, index: DataFrame, before: _State, tokens: dict[str, str]) -> DataFrame:
        """Centers whose own rows, heartbeats or devices are not what they were."""
        parts = (("c", tables.centers, "CenterID"), ("h", tables.heartbeats, "CenterID"), ("d", index, "center_id"))
        rows = None
        for salt, df, key in parts:
            part = df.select(F.col(key).cast("bigint").alias("center_id"), _row_hash(sorted(df.columns), salt).alias("h"))
            rows = part if rows is None else rows.unionAll(part)
        sums, tokens["center_sums"] = self._stored(rows.groupBy("center_id").agg(*_hash_sums(F.col("h"))))
        tokens |= _tokens({"centers": sums})
        old = self.spark.read.schema(sums.schema).parquet(before.tokens["center_sums"]) if "center_sums" in before.tokens else None
        return _differing(old, sums, "center_id")

    def _refresh_centers(self, tables: Tables, index: DataFrame, touched: list[int], as_of: datetime, heartbeats_as_of: datetime | None, filters: Filters) -> None:
        """The marts with rows per center, for the buckets ``touched`` alone."""
        names = ("center_tickets", "center_360", "scores")
        if not touched:
            self.changes += [Change(name, "kept") for name in names]
            return
        whole = len(touched) == self.buckets

        def part(df: DataFrame, key: str) -> DataFrame:
            return df if whole else df.filter(self._bucket(key).isin(touched))

        def replace(name: str, df: DataFrame) -> DataFrame:
            return self._replace(name, df.withColumn(BUCKET, self._bucket("center_id")).repartition(BUCKET), BUCKET, touched)

        mine = tables.replacing({
            "center_details": part(tables.centers, "CenterID"), "heartbeats": part(tables.heartbeats, "CenterID"),
            "cleaned_tickets": part(tables.cleaned(), "CenterID"),
        })
        stats = replace("center_tickets", tk.center_ticket_stats(mine.cleaned(), as_of))
        replace("center_360", ct.center_360(mine, as_of, heartbeats_as_of, stats=stats, devices=part(index, "center_id")))
        replace("scores", up.scored(mine, as_of, filters, stats))


def refresh_marts(tables: Tables, as_of: datetime, folder: str, heartbeats_as_of: datetime | None = None, filters: Filters = DEFAULT_FILTERS) -> list[Change]:
    """Build the marts under ``folder``, or bring them up to date where they were built before."""
    return MartFolder(tables.spark, folder).refresh(tables, as_of, heartbeats_as_of, filters)


def mart_sizes(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    sizes = [
        spark.read.parquet(path).agg(F.count("*").alias("row_count")).select(F.lit(name).alias("mart"), "row_count")
        for name, path in paths.items()
    ]
    report = sizes[0]
    for more in sizes[1:]:
        report = report.unionByName(more)
    return report


def new_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/marts-{uuid.uuid4().hex}"
