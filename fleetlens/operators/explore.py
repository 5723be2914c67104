"""Explorer building blocks: sort whitelists, pages, ranked counts, raw listings and exports."""

from __future__ import annotations

import uuid
from bisect import bisect_right
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from fleetlens.filters import Filters, by_center, where
from fleetlens.functions.text import col, label
from fleetlens.operators.search import TextIndex
from fleetlens.session import shared_folder
from fleetlens.sources.tables import Tables


def sort_order(
    keys: Mapping[str, Column | str], key: str, direction: str, default: str, ties: Sequence[Column]
) -> list[Column]:
    """Whitelisted sort; an unknown key falls back to ``default``. NULLs are smallest."""
    c = col(keys.get(key, keys[default]))
    primary = c.asc_nulls_first() if direction.lower() == "asc" else c.desc_nulls_last()
    return [primary, *ties]


def empties_last(c: Column | str, direction: str, is_text: bool = False) -> Column:
    """Sort key that puts NULL and empty text last in both directions."""
    value = F.nullif(col(c), F.lit("")) if is_text else col(c)
    return value.asc_nulls_last() if direction.lower() == "asc" else value.desc_nulls_last()


# Rows that a page may keep in one task on its way: those before it and its own.
PREFIX_ROWS = 100_000
_PLACE_BITS = 33  # of monotonically_increasing_id: the row's place in its partition


def total_order(df: DataFrame, order: Sequence[Column]) -> list[Column]:
    """``order``, then all columns: only equal rows still tie."""
    return [*order, *(F.col(f"`{c}`").asc_nulls_first() for c in df.columns)]


@dataclass(frozen=True)
class Ordered:
    """A table written in order. ``_row`` grows with the order; ``first`` and ``before`` hold, for each range that one task
    wrote, its first ``_row`` and the number of rows before it."""

    table: DataFrame
    first: list[int]
    before: list[int]
    total: int

    def _row_at(self, place: int) -> int:
        found = bisect_right(self.before, place) - 1
        return self.first[found] + place - self.before[found]

    def rows(self, start: int, end: int) -> DataFrame:
        """The rows at places ``start`` to ``end`` - 1, in order. Only files that hold some of them are read."""
        end = min(end, self.total)
        wanted = F.col("_row").between(self._row_at(start), self._row_at(end - 1)) if start < end else F.lit(False)
        return self.table.filter(wanted).orderBy("_row").drop("_row")


def ordered(df: DataFrame, order: Sequence[Column], folder: str | None = None) -> Ordered:
    """``df`` written once in order to the shared folder (or to ``folder``); serves as many pages as are wanted.

    Every task writes one range of the order and reports one row about it.
    """
    spark = df.sparkSession
    path = f"{(folder or shared_folder(spark)).rstrip('/')}/ordered-{uuid.uuid4().hex}"
    df.orderBy(*total_order(df, order)).withColumn("_row", F.monotonically_increasing_id()).write.parquet(path)
    table = spark.read.parquet(path)
    ranges = table.groupBy(F.shiftright("_row", _PLACE_BITS).alias("range")).agg(F.count("*").alias("n"), F.min("_row").alias("first"))
    found = ranges.orderBy("range").collect()
    ends = list(accumulate((r["n"] for r in found), initial=0))
    return Ordered(table, [r["first"] for r in found], ends[:-1], ends[-1])


def page_of(
    df: DataFrame, order: Sequence[Column], page: int, size: int, counted: DataFrame | None = None,
    prefix_rows: int = PREFIX_ROWS, folder: str | None = None,
) -> DataFrame:
    """One page of ``size`` rows plus the total number of rows. Rows that tie go by all their columns.

    The total is an aggregate of its own: a window over everything would put all rows in one task. It counts
    ``counted`` instead where a cheaper frame has as many rows. Every task keeps the rows up to the page's end; where
    these are more than ``prefix_rows``, the rows are ordered by all tasks and written (see ``ordered``) instead.
    """
    if size < 1 or page < 0:
        raise ValueError("a page holds a row at least, and pages count from 0")
    if (page + 1) * size > prefix_rows:
        written = ordered(df, order, folder)
        return written.rows(page * size, (page + 1) * size).withColumn("total_rows", F.lit(written.total).cast("long"))
    rows = df.orderBy(*total_order(df, order)).offset(page * size).limit(size)
    return rows.withColumn("total_rows", (df if counted is None else counted).agg(F.count("*")).scalar())


@dataclass(frozen=True)
class SortKey:
    """A column to sort by. NULLs come first when ascending and last when descending, unless told otherwise."""

    column: str
    descending: bool = False
    nulls_last: bool | None = None

    def _last(self) -> bool:
        return self.descending if self.nulls_last is None else self.nulls_last

    def order(self) -> Column:
        c = F.col(f"`{self.column}`")
        if self.descending:
            return c.desc_nulls_last() if self._last() else c.desc_nulls_first()
        return c.asc_nulls_last() if self._last() else c.asc_nulls_first()

    def beyond(self, value: object) -> Column:
        """Rows that sort after ``value``."""
        c = F.col(f"`{self.column}`")
        if value is None:
            return F.lit(False) if self._last() else c.isNotNull()
        later = c < F.lit(value) if self.descending else c > F.lit(value)
        later = F.coalesce(later, F.lit(False))
        return later | c.isNull() if self._last() else later


@dataclass(frozen=True)
class Cursor:
    """Where a page ended: its last row in the order of the sort keys, and how many rows equal to it were shown."""

    values: tuple
    shown: int


def _all_keys(df: DataFrame, keys: Sequence[SortKey]) -> list[SortKey]:
    named = {k.column for k in keys}
    return [*keys, *(SortKey(c) for c in df.columns if c not in named)]


def seek_page(df: DataFrame, keys: Sequence[SortKey], size: int, after: Cursor | None = None) -> DataFrame:
    """The ``size`` rows that follow a cursor, or the first ones. Ties go by all other columns.

    The same plan at every depth: a condition on the sort keys and a top-k of the page per task. No page before it is
    read again, nothing is written, and building it starts no job.
    """
    if size < 1:
        raise ValueError("a page holds a row at least")
    keys = _all_keys(df, keys)
    order = [k.order() for k in keys]
    if after is None:
        return df.orderBy(*order).limit(size)
    wanted = F.lit(True)  # the row itself: others equal to it may follow
    for key, value in zip(reversed(keys), reversed(after.values), strict=True):
        wanted = key.beyond(value) | (F.col(f"`{key.column}`").eqNullSafe(F.lit(value)) & wanted)
    return df.filter(wanted).orderBy(*order).offset(after.shown).limit(size)


def cursor_of(df: DataFrame, keys: Sequence[SortKey], page: Sequence[Row], before: Cursor | None = None) -> Cursor | None:
    """Where a page of ``seek_page`` ended; ``before`` if it is empty."""
    if not page:
        return before
    columns = [k.column for k in _all_keys(df, keys)]
    rows = [tuple(r[c] for c in columns) for r in page]
    shown = next((i for i, r in enumerate(reversed(rows)) if r != rows[-1]), len(rows))
    if shown == len(rows) and before is not None and before.values == rows[-1]:
        shown += before.shown
    return Cursor(rows[-1], shown)


def rank_counts(
    df: DataFrame, c: Column | str, default: str, limit: int | None = None,
    name: str = "label", count: str = "cnt", distinct: str | None = None,
) -> DataFrame:
    """Rows (or distinct values of ``distinct``) per label, largest first."""
    n = F.countDistinct(distinct) if distinct else F.count("*")
    ranked = (
        df.groupBy(label(c, default).alias(name)).agg(n.alias(count)).orderBy(F.col(count).desc(), F.col(name).asc())
    )
    return ranked.limit(limit) if limit else ranked


def side_by_side(*one_row: DataFrame) -> DataFrame:
    """Several one-row results as one row."""
    rows = one_row[0]
    for more in one_row[1:]:
        rows = rows.unionByName(more, allowMissingColumns=True)
    return rows.agg(*(F.max(c).alias(c) for c in rows.columns))


def options(df: DataFrame, c: str, name: str) -> DataFrame:
    """Distinct non-blank values of a column, sorted."""
    return df.select(label(c, "").alias(name)).filter(F.col(name) != "").distinct().orderBy(name)


@dataclass(frozen=True)
class RawSource:
    title: str
    table: str
    order_key: str


RAW_SOURCES = {
    "center_details": RawSource("Center details", "center_details", "CenterID"),
    "heartbeats": RawSource("Heartbeats", "heartbeats", "DeviceID"),
    "support_tickets": RawSource("Support tickets", "support_tickets", "ticketNumber"),
    "device_register": RawSource("Device register", "device_register", "issue_key"),
}


def raw_rows(tables: Tables, source: str, filters: Filters = Filters()) -> DataFrame:
    """A raw source with the filters its own columns can express; tickets keep their duplicates."""
    df = tables.scan(RAW_SOURCES[source].table)
    if source == "center_details":
        return where(df, filters.center(), filters.dates("deploymentdate"))
    if source == "heartbeats":
        return by_center(df, tables, filters)
    if source == "support_tickets":
        return where(by_center(df, tables, filters), filters.dates("CreatedAt"))
    return where(df, filters.register())


def raw_order(df: DataFrame, source: str) -> list[Column]:
    """The source's key, then every other column, so that a page is stable."""
    key = RAW_SOURCES[source].order_key
    return [F.col(c).asc_nulls_first() for c in (key, *(c for c in df.columns if c != key))]


def raw_page(tables: Tables, source: str, filters: Filters = Filters(), page: int = 0, size: int = 25) -> DataFrame:
    df = raw_rows(tables, source, filters)
    return page_of(df, raw_order(df, source), page, size)


def raw_export_rows(
    tables: Tables, source: str, filters: Filters = Filters(), max_rows: int | None = None
) -> DataFrame:
    """All rows of the export in order, or the first ``max_rows`` where the caller wants a cap."""
    df = raw_rows(tables, source, filters)
    rows = df.orderBy(*raw_order(df, source))
    return rows if max_rows is None else rows.limit(max_rows)


def raw_export(
    tables: Tables, source: str, path: str, filters: Filters = Filters(), max_rows: int | None = None
) -> dict[str, object]:
    """Write the export as CSV with a header; report the total and whether the caller's cap was reached.

    Without a cap every task writes its own range of the order; with one, the ordered table is written first and the rows
    under the cap are taken from its ranges, so that no task holds them all.
    """
    df = raw_rows(tables, source, filters)
    if max_rows is None:
        total, rows = df.count(), raw_export_rows(tables, source, filters)
    else:
        written = ordered(df, raw_order(df, source))
        total, rows = written.total, written.rows(0, max_rows)
    rows.write.mode("overwrite").option("header", True).csv(path)
    return {"total_rows": total, "truncated": max_rows is not None and total > max_rows}


def top_values(centers: DataFrame, c: str, name: str, limit: int = 50) -> DataFrame:
    """Most common values of a center attribute by number of centers."""
    return rank_counts(
        centers.filter(label(c, "") != ""), c, "", limit, name=name, count="centers", distinct="CenterID"
    )


def find_values(centers: DataFrame | TextIndex, c: str, name: str, query: str, also: str | None = None, limit: int = 50) -> DataFrame:
    """Distinct values of a center attribute that contain ``query`` (or whose ``also`` column does), from the rows or
    from their index."""
    value = label(c, "")
    if isinstance(centers, TextIndex):
        found = centers.search(query, [c, also] if also else [c], min_length=1)
    else:
        hit = F.lower(value).contains(query.lower())
        if also:
            hit = hit | F.col(also).cast("string").contains(query.lower())
        found = centers.filter(hit)
    return found.filter(value != "").select(value.alias(name)).distinct().orderBy(name).limit(limit)


def find_centers(centers: DataFrame | TextIndex, query: str = "", limit: int = 50) -> DataFrame:
    """Centers whose name or id contains ``query``, from the rows or from their index; a query under two characters
    lists by id."""
    ident = F.col("CenterID").cast("string")
    if isinstance(centers, TextIndex):
        df = centers.search(query, ["Centername", "CenterID"])
    else:
        df = centers
        if len(query) >= 2:
            df = df.filter(F.lower(label("Centername", "")).contains(query.lower()) | ident.contains(query.lower()))
    df = df.filter(F.col("CenterID").isNotNull())
    return (
        df.groupBy("CenterID", "Centername").agg(F.lit(1).alias("_"))
        .orderBy("CenterID", F.col("Centername").asc_nulls_first())
        .limit(limit)
        .select(
            ident.alias("value"),
            F.concat(label("Centername", "Center"), F.lit(" · #"), ident).alias("label"),
        )
    )
