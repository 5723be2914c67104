"""Aggregates that merge over parts equal, or come near, those over all rows."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from fleetlens.operators import profile as pf
from fleetlens.operators import sketches as sk
from fleetlens.operators import uptime as up
from helpers import rows

START = datetime(2000, 12, 25)


def intervals(spark, seed, n=400):
    r, found = random.Random(seed), []
    for _ in range(n):
        start = START + timedelta(minutes=r.randrange(60 * 24 * 200))
        end = start + timedelta(minutes=r.choice((-500, 0, 20, 61, 60 * 64, 60 * 200, 60 * 3000)))
        found.append((r.choice((1, 1, 2, 3)), start, end))
    return spark.createDataFrame(found, "center_id bigint, start timestamp_ntz, end timestamp_ntz")


def test_downtime_words(spark):
    known, late = intervals(spark, 1), intervals(spark, 2, 5)
    want = lambda df: rows(up.island_downtime(up.merge_intervals(df, "center_id")), "center_id", "downtime_hrs")
    parts = sk.downtime_parts(known)
    assert rows(sk.word_downtime(parts)) == want(known)
    # Late tickets are OR-ed in; only the months they cover have new bits.
    more = sk.downtime_parts(late)
    assert rows(sk.word_downtime(parts.unionAll(more))) == want(known.unionAll(late))
    months = late.filter("end > start").selectExpr("explode(sequence(CAST(start AS DATE), CAST(end AS DATE))) AS d").select((F.year("d") * 12 + F.month("d") - 1).alias("m"))
    assert {r.month for r in more.filter("mask <> 0").collect()} <= {r.m + k for r in months.distinct().collect() for k in (-1, 0)}
    assert sk.word_downtime(sk.downtime_parts(known.limit(0))).count() == 0


def test_distinct_sketches_merge(spark):
    df = spark.range(60_000).selectExpr("id", "IF(id % 3 = 0, 7, id % 9000) AS hot", "CAST(NULL AS STRING) AS none", "id % 11 AS few", "IF(id % 2 = 0, '', 'x') AS blank", "id % 13 AS part")
    names = ["id", "hot", "none", "few", "blank"]
    parts = sk.distinct_parts(df, names, F.col("part"))
    assert parts.count() == 13 * 5
    got = dict(rows(sk.distinct_estimates(parts)))
    assert got["none"] == 0 and got["few"] == 11 and got["blank"] == 2 and abs(got["id"] - 60_000) <= 3000 and abs(got["hot"] - 6001) <= 300
    some = dict(rows(sk.distinct_estimates(parts.filter("part < 3"))))
    exact = df.filter("part < 3").select("hot").distinct().count()
    assert abs(some["hot"] - exact) <= 0.05 * exact


def test_quantiles_merge(spark):
    df = spark.range(50_000).selectExpr("id % 7 AS part", "IF(id % 3 = 0, 5.0D, CAST(pmod(hash(id), 1000) AS DOUBLE)) AS v")
    parts = sk.quantile_parts(df, F.when(F.col("part") != 6, F.col("v")), F.col("part"))
    assert parts.count() == 6
    value = sk.quantile(parts, 0.5).first().value
    below, upto = df.filter("part <> 6").agg(F.avg((F.col("v") < value).cast("int")), F.avg((F.col("v") <= value).cast("int"))).first()
    assert below <= 0.51 and upto >= 0.49
    assert sk.quantile(parts.limit(0)).first().value is None


def test_bitmap_counts_merge(spark):
    df = spark.range(20_000).selectExpr("id % 4 AS k", "IF(id % 3 = 0, 1, id * 7) AS a", "IF(id % 2 = 0, NULL, id % 500) AS b", "id % 10 AS day")
    parts = sk.bitmap_parts(df, ["k"], ["a", "b"], F.col("day"))
    exact = df.groupBy("k").agg(F.countDistinct("a").alias("a"), F.countDistinct("b").alias("b"))
    assert rows(sk.bitmap_counts(parts, ["k"]), "k", "entity", "n") == sorted((r.k, e, r[e]) for r in exact.collect() for e in "ab" if r[e])
    some = df.filter("day IN (2, 3)").groupBy("k").agg(F.countDistinct("a").alias("a"), F.countDistinct("b").alias("b"))
    got = rows(sk.bitmap_counts(parts.filter("part IN (2, 3)"), ["k"]), "k", "entity", "n")
    assert got == sorted((r.k, e, r[e]) for r in some.collect() for e in "ab" if r[e])


def test_columns_of_many_values_leave_after_the_sketch_pass(spark):
    df = spark.range(30_000).selectExpr(
        "CAST(id AS STRING) AS every", "IF(id % 3 = 0, 'hot', CAST(id % 4000 AS STRING)) AS many", "CAST(id % 26 AS STRING) AS over",
        "IF(id % 25 = 3, NULL, CAST(id % 25 AS STRING)) AS few", "CAST(NULL AS STRING) AS none", "IF(id = 77, 'once', 'x') AS rare", "id % 5 AS part")
    names = ["every", "many", "over", "few", "none", "rare"]
    stored = pf.frequent_items(df, names, F.col("part"))
    kept = {r.column_name for r in pf.possible_categories(stored).collect()}
    assert {"few", "rare"} <= kept and not {"many", "over"} & kept
    exact = {(n, r[n], r["count"]) for n in ("few", "rare") for r in df.groupBy(n).count().collect()}
    for found in (pf.top_values(df.drop("part")), pf.top_values(df.drop("part"), sketches=stored)):
        assert {tuple(r) for r in found.select("column_name", "value", "n").collect()} == exact
    assert pf.top_values(df.select("part")).count() == 0
