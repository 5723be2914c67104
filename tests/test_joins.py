from __future__ import annotations

from pyspark.sql import functions as F

from fleetlens.operators import joins
from fleetlens.operators.lineage import build_register, json_scalar
from helpers import rows


def test_left_join_first_takes_the_first_row_and_keeps_every_left_row(spark):
    left = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d"), (None, "d")], "k bigint, v string")
    right = spark.createDataFrame([(1, "z", 9), (1, "y", 8), (None, "x", 7)], "k bigint, o string, n int")
    got = joins.left_join_first(left, right, "k", ["o"]).select("v", "o", "n").collect()
    assert sorted(map(tuple, got), key=str) == sorted(
        [("a", "y", 8), ("b", "y", 8), ("c", None, None), ("d", None, None), ("d", None, None)], key=str)


def test_rows_without_a_key_are_spread_over_tasks(spark):
    left = spark.range(0, 8000).selectExpr("if(id % 3 = 0, cast(null AS bigint), id) AS k", "id AS v")
    right = spark.range(0, 8000).selectExpr("id AS k", "id * 2 AS w")
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        joined = joins.left_join_spread(left, right, "k")
        assert joined.count() == 8000 and joined.filter("k IS NOT NULL AND w != 2 * k OR k IS NULL AND w IS NOT NULL").count() == 0
        placed = joined.withColumn("task", F.spark_partition_id()).collect()
        assert len({r.task for r in placed if r.k is None}) == len({r.task for r in placed}) > 1
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_register_build_is_a_left_join(spark):
    issues = spark.createDataFrame([("P", "1", "s"), ("P", "2", "t"), ("Q", "1", "u")], "project_key string, issue_key string, summary string")
    changes = spark.createDataFrame([("P", "1", "a"), ("P", "1", "b"), ("Z", "9", "c")], "project_key string, issue_key string, author string")
    want = issues.join(changes, ["project_key", "issue_key"], "left")
    key = "concat_ws('|', project_key, issue_key, summary, coalesce(author, '-'))"
    assert rows(build_register(issues, changes).selectExpr(key)) == rows(want.selectExpr(key))


def test_json_scalars(spark):
    texts = ['{"a b":"x"}', '{"a b":{"c":1}}', '{"a b":[1]}', '{"a b":null}', '{"a b":7}', "{broken", None, '{"other":1}']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    assert [r[0] for r in df.orderBy("i").select(json_scalar("t", "a b")).collect()] == ["x", None, None, None, "7", None, None, None]
