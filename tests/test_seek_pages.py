"""Pages by cursor: together they are the whole order, at every depth by the same plan."""

from __future__ import annotations

import pytest

from fleetlens.operators.explore import Cursor, SortKey, cursor_of, seek_page


@pytest.mark.parametrize("keys", (
    [SortKey("a")], [SortKey("a", True)], [SortKey("b", nulls_last=True), SortKey("a", True, nulls_last=False)], [SortKey("odd name", True)],
))
def test_pages_follow_each_other(spark, keys):
    rows = [(i % 7 if i % 5 else None, f"t{i % 3}" if i % 4 else None, float(i % 2)) for i in range(150)] + [(3, "same", 0.5)] * 40
    df = spark.createDataFrame(rows, "a int, b string, `odd name` double").repartition(4)
    every = [tuple(r) for r in seek_page(df, keys, 1000).collect()]
    assert len(every) == len(rows) and sorted(map(str, every)) == sorted(map(str, rows))
    seen, at = [], None
    while page := seek_page(df, keys, 13, at).collect():
        seen += [tuple(r) for r in page]
        at = cursor_of(df, keys, page, at)
    assert seen == every
    assert cursor_of(df, keys, [], at) == at


def test_deep_pages_are_a_top_k_of_one_page(spark):
    df = spark.range(100_000).selectExpr("id", "id % 10 AS k")
    spark.sparkContext.setJobGroup("seek", "seek")
    page = seek_page(df, [SortKey("id")], 5, Cursor((90_000, 0), 1))
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("seek")
    spark.sparkContext.setJobGroup("after", "after")
    assert "TakeOrderedAndProject(limit=6" in page._jdf.queryExecution().executedPlan().toString()
    assert [r.id for r in page.collect()] == [90_001, 90_002, 90_003, 90_004, 90_005]
    with pytest.raises(ValueError):
        seek_page(df, [SortKey("id")], 0)
