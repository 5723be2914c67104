"""Steps whose tasks must stay small when the tables grow."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from fleetlens.plans import query_basics
from fleetlens.plans.query_basics import one_percent_changed, row_differences, value_at_share
from fleetlens.sources import proxy
from fleetlens.sources.proxy import proxy_tables
from helpers import rows


@pytest.mark.parametrize("numbers", [[5], [3, 3, 3], list(range(-70, 131)), [1, None, 9, 9, 2, 10**15], [7, 7, 8] * 33 + [2] * 2, list(range(101))])
@pytest.mark.parametrize("cells", [2, 65_536])
def test_a_value_at_a_share_bounds_the_rows_an_exact_percentile_bounds(spark, numbers, cells):
    df = spark.createDataFrame([(n,) for n in numbers], "v bigint")
    exact = df.agg(F.percentile("v", 0.99)).first()[0]
    found = value_at_share(df, "v", 0.99, cells)
    assert sorted(n for n in numbers if n is not None and n >= found) == sorted(n for n in numbers if n is not None and n >= exact)


def test_a_share_of_no_values_is_none(spark):
    assert value_at_share(spark.createDataFrame([(None,)], "v bigint"), "v", 0.99) is None


def test_the_changed_hundredth_is_found_without_a_percentile_of_all_numbers(tables, monkeypatch):
    def refused(*_):
        raise AssertionError("one task would hold every ticket number")

    monkeypatch.setattr(query_basics.F, "percentile", refused)
    assert one_percent_changed(tables).tickets.count() < tables.tickets.count()


def test_row_differences_count_as_except_all(spark):
    built = spark.createDataFrame([(1, "a"), (1, "a"), (None, "b"), (2, None)], "side bigint, n string")
    kept = spark.createDataFrame([(1, "a"), (None, "b"), (None, "b"), (3, None), (3, None)], "side bigint, n string")
    want = (built.exceptAll(kept).count(), kept.exceptAll(built).count())
    assert rows(row_differences(built, kept)) == [want] == [(2, 3)]
    assert rows(row_differences(built, built)) == [(0, 0)]
    plan = row_differences(built, kept)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and plan.count("Aggregate") == 2


def test_lines_and_orders_of_large_tables_are_dealt_to_small_tasks(spark, tables, monkeypatch):
    monkeypatch.setattr(proxy, "DEALT_FROM", 0)
    monkeypatch.setattr(proxy, "JOINED_BYTES", 1 << 14)
    dealt = proxy_tables(spark, SMALL).tickets
    parts = -(-proxy._file_bytes(spark, f"{SMALL}/lineitem.parquet") // (1 << 14))
    assert parts > 2
    plan = dealt._jdf.queryExecution().executedPlan().toString()
    assert plan.count(f", {parts}), REPARTITION_BY_NUM") == 2
    assert dealt.exceptAll(tables.tickets).count() == 0 and tables.tickets.exceptAll(dealt).count() == 0


@pytest.mark.parametrize("name", ["R6_account_totals", "P8_section_health"])
def test_the_center_mart_reads_the_cleaned_tickets_at_hand(tables, monkeypatch, name):
    from fleetlens.plans import marts, query_profile, query_rollups
    from fleetlens.plans.registry import load

    asked = []

    def remembered(t, *_):
        asked.append(t.mart("cleaned_tickets") is not None)
        return marts.located_mart(t, *_)

    monkeypatch.setattr(query_rollups, "located_mart", remembered)
    monkeypatch.setattr(query_profile, "located_mart", remembered)
    load()[name].build(tables)
    assert asked == [True]


def test_custom_fields_are_parsed_once_by_tasks_of_few_centers(spark):
    from fleetlens.operators import lineage

    texts = ['{"Master Segment":"A","Webhook":"{\\"url\\":\\"u\\"}"}', '{"Master Segment":null,"Service Type":{"a":1},"Webhook":"\\"hook\\""}', "broken {", None]
    centers = spark.createDataFrame([(i, 7, x) for i, x in enumerate(texts * 2)], "CenterID bigint, HubID bigint, customfields string")
    found = lineage.custom_fields(centers)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in plan and plan.count("parseJson") < 6
    assert rows(found, "CenterID", "master_segment", "webhook")[:2] == [(0, "A", None), (1, None, "hook")]
    sheets = spark.createDataFrame([], "centerid bigint, hubid bigint, master_segment string, service_type string, hardware_type string, hardware_sale_type string")
    chosen = lineage.segment_overrides(centers.withColumn("HubID", (F.col("CenterID") * 0)), sheets, sheets)
    assert chosen.filter("hub_master_segment = 'A'").count() == 8 and chosen.filter("spk_master_segment = 'A'").count() == 2


def test_postings_are_grouped_by_one_number(spark):
    from fleetlens.operators import search

    rows = search.numbered_rows(spark.createDataFrame([("aé",), ("AÉ aé",), ("b",)], "t string").coalesce(1)).persist()
    lists = search.postings(rows, {"n": F.lit(None).cast("string"), "t": F.col("t")})
    assert "Aggregate [number#" in lists._jdf.queryExecution().optimizedPlan().toString()
    found = {(r["field"], r["gram"]): r["places"] for r in lists.collect()}
    assert found["t", "aé".encode().decode("latin-1")] == [0, 1] and found["t", "b\x00\x00"] == [2] and not any(f == "n" for f, _ in found)
    index = search.TextIndex(rows, lists, {"t": F.col("t")})
    assert sorted(r["t"] for r in index.search("é", min_length=1).collect()) == ["AÉ aé", "aé"]
    rows.unpersist()


def test_intervals_are_dealt_by_center_before_they_are_spread_to_words(spark):
    from fleetlens.operators import sketches

    intervals = spark.sql("SELECT id % 5 AS center_id, TIMESTAMP_NTZ '2000-01-01 00:00:00' + (id * 50) * INTERVAL '1' HOUR AS start, "
                          "TIMESTAMP_NTZ '2000-01-01 00:00:00' + (id * 50 + 300) * INTERVAL '1' HOUR AS `end` FROM range(40)")
    found = sketches.word_downtime(sketches.downtime_parts(intervals))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "hashpartitioning(center_id#" in plan and f", {sketches.WORD_TASKS}), REPARTITION_BY_NUM" in plan
    assert rows(found) == [(c, 7 * 250 + 300) for c in range(5)]


def test_marts_place_centers_once(tables, monkeypatch, tmp_path):
    from datetime import datetime

    from fleetlens.operators import geo
    from fleetlens.plans import marts

    placed, store = [], geo.store_by_key
    monkeypatch.setattr(geo, "store_by_key", lambda df: (placed.append(1), store(df))[1])
    paths = marts.build_marts(tables, datetime(2001, 8, 2), str(tmp_path / "marts"), datetime(2024, 1, 31))
    assert len(placed) == 1 and len(paths) == 14 and "_located" not in paths
    points = tables.spark.read.parquet(paths["map_points"])
    again = geo.map_points(tables.spark.read.parquet(paths["center_360"]), tables.geo_store, marts.DEFAULT_FILTERS)
    assert points.count() == again.count() > 0
