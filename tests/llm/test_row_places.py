"""Rows told apart by their place, and kept by bitmaps, whatever way these are joined."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from fleetlens.llm import common


@pytest.mark.parametrize("most", (common.BITMAP_BYTES, 0))
def test_rows_are_kept_by_place(spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr(common, "BITMAP_BYTES", most)
    spark.range(100_000).selectExpr("id", "id % 7 AS row", "'x' AS file", "id AS _kept").repartition(3).write.parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    placed = common.with_row_place(table, "_place")
    assert placed.select("_place").distinct().count() == 100_000
    wanted = F.col("id").isin(0, 1, 8, 32767, 32768, 32769, 65535, 65536, 99_999) | (F.col("id") % 1000 == 3)
    kept = common.keep_rows(placed, "_place", placed.filter(wanted).select("_place.file", "_place.row"))
    assert kept.columns == placed.columns
    assert sorted(r.id for r in kept.collect()) == sorted(r.id for r in table.filter(wanted).collect())
    assert common.keep_rows(placed, "_place", placed.limit(0).select("_place.file", "_place.row")).count() == 0


def test_rows_of_other_frames_are_written_first(spark):
    twice = spark.range(5).union(spark.range(5))
    assert common.with_row_place(twice, "_place").select("_place").distinct().count() == 10
