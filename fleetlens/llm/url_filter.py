"""URL filters by a sort-merge range join.

A host is keyed by its labels in reverse (``www.example.org`` -> ``org.example.www.``), which turns "this host and all
below it" into an interval of keys; so does a path rule with its prefix. Intervals made from prefixes nest. Keys and
interval bounds are sorted together and swept once: every bound carries the stack of rules active behind it, and a key
takes the stack of the last bound before it. The first sweep finds the rule hosts around a URL's host, the second,
under each of those hosts, the innermost path rule. Equal sorted ranges go to each task, whatever host they hold;
what is active at a range's start is carried over from the ranges before.

The longest fitting rule (host and path together) wins; of equally long ones that with the longer host. Rules that
repeat a host and path count once, and block if any of them blocks.

Defined results: a NULL url, or one without ``://``, has empty host and path and no rule; NULL or repeated ids are
rows like any other; no rules, or empty tables, give the default verdict or no rows. Only built-in functions are used.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.llm.common import ascii_lower, cut

PARTS = "(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, PARTS, 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, "\\.", -1)), "."), F.lit("."))


def rule_table(spark, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Rules (verdict, host, path) as a table."""
    return spark.createDataFrame(list(rules), "verdict string, host string, path string")


def _bounds(prefixes: DataFrame) -> DataFrame:
    """Start and end of each prefix's interval, with the prefixes active from there on, outermost first.

    ``prefixes`` holds distinct strings ``p``. The end sorts after every string that begins with p: no UTF-8 text
    has the byte FF.
    """
    shorter = prefixes.select("p", F.explode(F.sequence(F.lit(1), F.length("p"))).alias("n")).select("p", F.substring("p", F.lit(1), F.col("n")).alias("q"))
    around = shorter.join(prefixes.select(F.col("p").alias("q")), "q").groupBy("p").agg(F.sort_array(F.collect_list(F.struct(F.length("q").alias("n"), "q"))).alias("s"))
    stack = F.transform("s", lambda x: x["q"])
    key = F.col("p").cast("binary")
    opens = around.select(key.alias("key"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("row"), stack.alias("stack"))
    closes = around.select(F.concat(key, F.expr("X'FF'")).alias("key"), F.lit(2).alias("kind"), F.lit(None).cast("long").alias("row"), F.slice(stack, 1, F.greatest(F.size(stack) - 1, F.lit(0))).alias("stack"))
    return opens.unionAll(closes)


def sweep(keys: DataFrame, prefixes: DataFrame) -> DataFrame:
    """(row, stack) for each of ``keys`` (row, key string): the prefixes ``p`` of its key, outermost first."""
    probes = keys.select(F.col("key").cast("binary").alias("key"), F.lit(1).alias("kind"), "row", F.lit(None).cast("array<string>").alias("stack"))
    ranges = probes.unionAll(_bounds(prefixes)).repartitionByRange("key", "kind", "row").withColumn("range", F.spark_partition_id())
    ranges = cut(ranges, "url-sweep")
    latest = F.max_by("stack", F.struct("key", "kind"))
    # Of bounds at one key the last to count is the outermost end, the one with the shortest stack; ends at one key cannot meet,
    # as each ends in FF behind its own prefix.
    tails = ranges.groupBy("range").agg(F.max_by("stack", F.when(F.col("stack").isNotNull(), F.struct("key", "kind"))).alias("tail"))
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    carried = tails.select("range", F.last("tail", ignorenulls=True).over(earlier).alias("carried"))
    order = Window.partitionBy("range").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = ranges.withColumn("active", F.last("stack", ignorenulls=True).over(order)).filter("kind = 1").join(carried, "range")
    return swept.select("row", F.coalesce("active", "carried", F.array().cast("array<string>")).alias("stack"))


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """Per page ``id``, ``host``, ``path``, ``rule`` (host and path of the winning one, else NULL) and ``verdict``."""
    urls = cut(
        pages.select(F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path")).withColumn("row", F.monotonically_increasing_id()),
        "urls",
    )
    known = rules.filter("host IS NOT NULL AND path IS NOT NULL").groupBy(ascii_lower(F.col("host")).alias("host"), "path").agg(F.max("verdict").alias("verdict"))
    known = known.withColumn("hk", host_key(F.col("host"))).withColumn("full", F.concat("hk", F.lit("|"), "path"))
    hosts = sweep(urls.select("row", host_key(F.col("host")).alias("key")), known.select(F.col("hk").alias("p")).distinct())
    # One probe for each rule host around the URL's host; a key ends before "|", which no path rule of another host can pass.
    probes = urls.select("row", "path").join(hosts, "row").select("row", "path", F.explode("stack").alias("hk"))
    probes = probes.select("row", F.concat("hk", F.lit("|"), "path").alias("key"))
    fits = sweep(probes, known.select(F.col("full").alias("p")).distinct()).filter(F.size("stack") > 0).select("row", F.try_element_at("stack", F.lit(-1)).alias("full"))
    best = fits.join(known, "full").groupBy("row").agg(
        F.max_by(F.struct(F.concat("host", "path").alias("rule"), "verdict"), F.struct(F.length("host") + F.length("path"), F.length("host"))).alias("best")
    )
    judged = urls.join(best, "row", "left")
    return judged.select("id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
