"""Aggregates that merge: kept per part of a table (a month, a day), they answer for any set of parts.

* distinct values of every column by HyperLogLog sketches, within a few hundredths;
* quantiles by KLL sketches, within a bounded error of rank;
* exact distinct counts of numbered things (centers, hubs) by bitmaps of their numbers;
* exact downtime by bits of hours, 64 to a word, of which a late ticket changes those it covers.

Each has a ``..._parts`` function, whose rows are written once a part, and one that merges such rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions import time as tm

HLL_BITS = 14  # registers of a sketch as a power of two: a standard error of 0.8 %
KLL_SIZE = 400  # error of rank under 0.01
WORD = 64  # hours
WORD_TASKS = 256  # tasks at least over which centers are dealt before their hours are spread to words


# Distinct values of every column


def values_sketch(c: str) -> Column:
    """The sketch of a column's values. Sketches pass over empty text, which is a value here, so all are marked."""
    return F.hll_sketch_agg(F.concat(F.lit("="), F.col(f"`{c}`").cast("string")), F.lit(HLL_BITS))


def distinct_parts(df: DataFrame, columns: Sequence[str], part: Column) -> DataFrame:
    """(part, column_name, sketch) from one pass over the rows."""
    sketches = F.array(*(F.struct(F.lit(c).alias("column_name"), values_sketch(c).alias("sketch")) for c in columns))
    return df.groupBy(part.alias("part")).agg(sketches.alias("s")).select("part", F.inline("s"))


def distinct_estimates(parts: DataFrame) -> DataFrame:
    """(column_name, distinct_values) over all parts given."""
    return parts.groupBy("column_name").agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("distinct_values"))


# Quantiles


def quantile_parts(df: DataFrame, value: Column, part: Column) -> DataFrame:
    """(part, sketch) of the values that are not NULL; a part without any has no row."""
    known = df.select(part.alias("part"), value.cast("double").alias("value")).filter("value IS NOT NULL")
    return known.groupBy("part").agg(F.kll_sketch_agg_double("value", F.lit(KLL_SIZE)).alias("sketch"))


def quantile(parts: DataFrame, share: float = 0.5) -> DataFrame:
    """One row, ``value``: the value at this share of the ranks of all parts given; NULL where there are none."""
    merged = parts.agg(F.kll_merge_agg_double("sketch").alias("sketch"), F.count("*").alias("n"))
    return merged.select(F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("sketch", F.lit(share))).alias("value"))


# Distinct counts of numbered things


def bitmap_parts(df: DataFrame, keys: Sequence[str], entities: Sequence[str], part: Column) -> DataFrame:
    """(keys, part, entity, bucket, bits): the numbers met in each part, 32,768 to a bitmap. NULL is no number."""
    each = F.explode(F.array(*(F.struct(F.lit(e).alias("entity"), F.col(e).cast("bigint").alias("number")) for e in entities)))
    rows = df.select(*keys, part.alias("part"), each.alias("e")).select(*keys, "part", "e.entity", "e.number").filter("number IS NOT NULL")
    return rows.groupBy(*keys, "part", "entity", F.bitmap_bucket_number("number").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("bits"))


def bitmap_counts(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, entity, n): exact distinct numbers over all parts given."""
    merged = parts.groupBy(*keys, "entity", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
    return merged.groupBy(*keys, "entity").agg(F.sum(F.bitmap_count("bits")).alias("n"))


# Downtime


def downtime_words(intervals: DataFrame) -> DataFrame:
    """(center_id, word, mask): the hours in which a center was down, 64 to a word. Intervals that end before they start
    or within the hour cover none, yet their center has a row.

    Intervals are dealt by center before they are spread: a task holds the words of its own centers, in a number of tasks
    that adaptive execution leaves alone. Words compress so well that those of a task of usual size would fill its memory.
    """
    start, end = tm.hour_number("start"), F.greatest(tm.hour_number("end"), tm.hour_number("start"))
    tasks = max(WORD_TASKS, int(intervals.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    hours = intervals.select("center_id", start.alias("s"), end.alias("e")).repartition(tasks, "center_id")
    first, last = F.floor(F.col("s") / WORD), F.floor(F.greatest(F.col("e") - 1, F.col("s")) / WORD)
    spread = hours.select("center_id", "s", "e", F.explode(F.sequence(first, last)).alias("word"))
    low = F.greatest(F.col("s") - F.col("word") * WORD, F.lit(0))
    n = F.least(F.col("e") - F.col("word") * WORD, F.lit(WORD)) - low
    mask = F.when(n > 0, F.expr("shiftleft(shiftrightunsigned(-1L, CAST(64 - n AS INT)), CAST(low AS INT))")).otherwise(F.lit(0))
    masked = spread.withColumns({"low": low, "n": n}).select("center_id", "word", mask.cast("bigint").alias("mask"))
    return masked.groupBy("center_id", "word").agg(F.bit_or("mask").alias("mask"))


def downtime_parts(intervals: DataFrame) -> DataFrame:
    """The words with the month they begin in: a table by month of which a late ticket changes the months it covers."""
    day = F.date_from_unix_date(F.floor(F.col("word") * WORD / 24).cast("int"))
    return downtime_words(intervals).withColumn("month", tm.month_number(day))


def word_downtime(parts: DataFrame) -> DataFrame:
    """Downtime hours per center over all words given, from one or several builds of them."""
    merged = parts.groupBy("center_id", "word").agg(F.bit_or("mask").alias("mask"))
    return merged.groupBy("center_id").agg(F.sum(F.bit_count("mask")).cast("bigint").alias("downtime_hrs"))
