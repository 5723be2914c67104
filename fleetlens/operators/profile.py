"""Table profiling, key resolution and reconciliation checks."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.functions import time as tm
from fleetlens.functions.text import digits_only
from fleetlens.operators import tickets as tk
from fleetlens.operators.explore import RAW_SOURCES, raw_rows, side_by_side
from fleetlens.operators.sketches import values_sketch
from fleetlens.sources.tables import Tables

_NESTED = (T.StructType, T.ArrayType, T.MapType, T.VariantType, T.BinaryType)
_ORDERED = (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType)


def _profiled(df: DataFrame) -> list[T.StructField]:
    return [f for f in df.schema.fields if not isinstance(f.dataType, _NESTED)]


def _is_ordered(f: T.StructField) -> bool:
    return isinstance(f.dataType, _ORDERED)


def column_profile(df: DataFrame, distinct: bool = True) -> DataFrame:
    """One row per column from one pass: its type, rows, NULL share, approximate distinct values, range of ordered types."""
    fields = _profiled(df)
    text = F.lit(None).cast("string")

    def stats(f: T.StructField) -> Column:
        c = F.col(f"`{f.name}`")
        ordered = _is_ordered(f)
        parts = [
            F.lit(f.name).alias("column_name"),
            F.lit(f.dataType.simpleString()).alias("type"),
            F.count("*").alias("row_count"),
            F.count_if(c.isNull()).alias("nulls"),
            (F.min(c).cast("string") if ordered else text).alias("min_value"),
            (F.max(c).cast("string") if ordered else text).alias("max_value"),
        ]
        if distinct:
            parts.append(F.approx_count_distinct(c).alias("distinct_values"))
        return F.struct(*parts)

    one_row = df.agg(F.array(*(stats(f) for f in fields)).alias("s"))
    share = F.round(F.coalesce(F.try_divide("nulls", "row_count"), F.lit(0.0)) * 100, 1)
    return one_row.select(F.inline("s")).select(
        "column_name", "type", "row_count", share.alias("null_pct"), *(["distinct_values"] if distinct else []), "min_value", "max_value"
    )


TRACKED = 1024  # items a frequent-items sketch holds; up to three quarters of that it is exact


def frequent_items(df: DataFrame, columns: list[str], part: Column | None = None) -> DataFrame:
    """(part, column_name, sketch, values) of the most frequent values of each column and of how many there are; both
    sketches merge over parts."""
    sketch = "approx_top_k_accumulate(CAST(`{c}` AS STRING), {n})"
    each = F.array(*(
        F.struct(
            F.lit(c).alias("column_name"), F.expr(sketch.format(c=c, n=TRACKED)).alias("sketch"),
            values_sketch(c).alias("values"),
        ) for c in columns
    ))
    keyed = df.groupBy((F.lit(0) if part is None else part).alias("part"))
    return keyed.agg(each.alias("s")).select("part", F.inline("s"))


def possible_categories(sketches: DataFrame, most: int = 25) -> DataFrame:
    """Columns whose merged sketches show no more than ``most`` values. None that has 1 to ``most`` is missing: of so few
    values the first sketch is exact and the second one's estimate nowhere near twice as high. A full first sketch may
    show few of very many values; the second one tells."""
    shown = F.expr(f"approx_top_k_estimate(approx_top_k_combine(sketch, {TRACKED}), {most + 2})")
    merged = sketches.groupBy("column_name").agg(
        F.size(F.filter(shown, lambda x: x["item"].isNotNull())).alias("n"), F.hll_sketch_estimate(F.hll_union_agg("values")).alias("values")
    )
    return merged.filter((F.col("n") <= most) & (F.col("values") <= 2 * most)).select("column_name")


def top_values(df: DataFrame, most: int = 25, sketches: DataFrame | None = None) -> DataFrame:
    """Values and counts of every category column: one of unordered type with 1 to ``most`` distinct values.

    A first pass keeps a sketch of frequent values per column, or takes stored ones; columns that show more than ``most``
    leave there, and only values of the others are sent and counted, exactly.
    """
    names = [f.name for f in _profiled(df) if not _is_ordered(f)]
    if not names:
        return df.limit(0).select(F.lit("").alias("column_name"), F.lit("").alias("value"), F.lit(0).cast("bigint").alias("n"))
    wanted = possible_categories(frequent_items(df, names) if sketches is None else sketches, most).agg(F.collect_set("column_name")).scalar()
    pairs = F.array(*(F.struct(F.lit(n).alias("column_name"), F.col(f"`{n}`").cast("string").alias("value")) for n in names))
    kept = F.filter(pairs, lambda p: F.array_contains(F.col("_wanted"), p["column_name"]))
    counts = df.withColumn("_wanted", wanted).select(F.explode(kept).alias("p")).groupBy("p.column_name", "p.value").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("column_name").orderBy(F.desc("n"), F.col("value").asc_nulls_first()))
    seen = counts.withColumn("_place", place).filter(F.col("_place") <= most + 2)
    known = seen.withColumn("_values", F.count("value").over(Window.partitionBy("column_name")))
    return known.filter(F.col("_values").between(1, most) & (F.col("_place") <= most)).drop("_place", "_values")


def key_resolution(facts: DataFrame, key: str, known: DataFrame, known_key: str) -> DataFrame:
    """How many rows carry the key, how many look numeric, how many resolve, and to how many distinct keys.

    Counted per key value first, so a key that dominates the table stays one row in the join.
    """
    by_key = facts.groupBy(F.col(key).cast("string").alias("k")).agg(F.count("*").alias("n"))
    targets = known.select(F.col(known_key).cast("string").alias("k"), F.lit(True).alias("hit")).filter("k IS NOT NULL").distinct()
    n, hit = F.col("n"), F.coalesce("hit", F.lit(False))
    return by_key.join(targets, "k", "left").agg(
        F.coalesce(F.sum(n), F.lit(0)).alias("row_count"),
        F.coalesce(F.sum(F.when(F.col("k").isNotNull(), n)), F.lit(0)).alias("has_key"),
        F.coalesce(F.sum(F.when(F.col("k").rlike("^[0-9]+$"), n)), F.lit(0)).alias("numeric_looking"),
        F.coalesce(F.sum(F.when(hit, n)), F.lit(0)).alias("resolves"),
        F.count_if(hit).alias("distinct_hits"),
    )


def digits_resolution(facts: DataFrame, key: str, tables: Tables) -> DataFrame:
    """Rows whose reference, reduced to digits, names a known ticket."""
    reference = facts.select(F.col(key).alias("raw"), digits_only(key).alias("k"))
    by_key = reference.groupBy("k").agg(F.count("*").alias("n"), F.count("raw").alias("given"))
    known = tables.cleaned().select(F.col("ticketNumber").cast("string").alias("k"), F.lit(True).alias("hit"))
    return by_key.join(known.filter("k IS NOT NULL").distinct(), "k", "left").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"),
        F.coalesce(F.sum("given"), F.lit(0)).alias("has_reference"),
        F.coalesce(F.sum(F.when(F.col("hit"), F.col("n"))), F.lit(0)).alias("resolves"),
    )


def time_sanity(df: DataFrame, opened: str, closed: str = "closed_date", tat: str = "tat_days_") -> DataFrame:
    """Whether timestamps carry a time of day, and rows that run backwards. The median is exact."""

    by_tat = df.groupBy(tat).agg(
        F.count("*").alias("n"),
        F.count_if(tm.has_time_of_day(opened)).alias("opened_has_time"),
        F.count_if(tm.has_time_of_day(closed)).alias("closed_has_time"),
        F.count_if(F.col(closed) < F.col(opened)).alias("closed_before_opened"),
    )
    value, n = F.col(tat), F.col("n")
    return by_tat.agg(
        F.coalesce(F.sum(n), F.lit(0)).alias("n"),
        *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("opened_has_time", "closed_has_time", "closed_before_opened")),
        F.coalesce(F.sum(F.when(value < 0, n)), F.lit(0)).alias("negative_tat"),
        F.round(F.try_divide(F.sum(value * n), F.sum(F.when(value.isNotNull(), n))), 2).alias("avg_tat_days"),
        F.round(F.expr(f"percentile({tat}, 0.5, n)"), 2).alias("median_tat_days"),
    )


def yearly_service(tables: Tables) -> DataFrame:
    """Field-service tickets per year, breakdowns, and breakdowns of a known center."""
    breakdown = F.count_if(F.col("ticket_type") == "BREAKDOWN")
    by_key = tables.service.groupBy(F.year("created_on").alias("yr"), F.col("customer_id").alias("k")).agg(
        F.count("*").alias("n"), breakdown.alias("b")
    )
    known = tables.centers.select(F.col("CenterID").cast("string").alias("k"), F.lit(True).alias("hit")).filter("k IS NOT NULL").distinct()
    return by_key.join(known, "k", "left").groupBy("yr").agg(
        F.sum("n").alias("all_tickets"),
        F.sum("b").alias("breakdown"),
        F.coalesce(F.sum(F.when(F.col("hit"), F.col("b"))), F.lit(0)).alias("breakdown_with_center"),
    )


def yearly_support(tables: Tables) -> DataFrame:
    """Support tickets per year, technical ones, and centers."""
    dated = tk.with_sla(tables.cleaned().filter("CreatedAt IS NOT NULL"))
    return dated.groupBy(F.year("CreatedAt").alias("yr")).agg(
        F.count("*").alias("tickets"),
        F.count_if("is_tech").alias("tech_failure_tickets"),
        F.countDistinct("CenterID").alias("centers"),
    )


def worklist_check(tables: Tables, as_of: datetime) -> DataFrame:
    """The worklist holds exactly the breached and at-risk tickets of the headline figures."""
    risk = F.col("risk")
    listed = tk.worklist_rows(tables, as_of).agg(
        F.count("*").alias("worklist"),
        F.count_if(risk == "BREACHED").alias("worklist_breached"),
        F.count_if(risk == "AT_RISK").alias("worklist_atrisk"),
    )
    headline = tk.sla_kpis(tables, as_of).select("breached_open", "atrisk_open")
    expected = F.col("breached_open") + F.col("atrisk_open")
    bands = F.col("worklist_breached") + F.col("worklist_atrisk")
    return side_by_side(listed, headline).select(
        "*", (F.col("worklist") == expected).alias("totals_match"), (F.col("worklist") == bands).alias("bands_match")
    )


def source_health(tables: Tables) -> DataFrame:
    """Row count of every raw source."""
    counts = [
        raw_rows(tables, s).agg(F.count("*").alias("row_count")).select(F.lit(s).alias("source"), "row_count") for s in RAW_SOURCES
    ]
    report = counts[0]
    for more in counts[1:]:
        report = report.unionByName(more)
    return report
