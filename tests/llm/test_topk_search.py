"""Exact top-k search against brute force: ties, copies, repeated ids, odd vectors, sums beyond 53 and 64 bits, many groups."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from fleetlens.llm import topk_search
from fleetlens.llm.queries import QUERIES, table

SMALL = "/root/testdata/sf0.001"
TOP = 2**63 - 1


def brute(rows, k, every):
    """(query_id, rank, vec_id, score) of every query row; ``rows`` are (id, vector)."""
    whole = [(i, [int(x) * 256 if abs(x) > 2**60 else math.floor(256 * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for at, (i, q) in enumerate(whole):
        if i is not None and i % every == 0:
            scored = [(min(TOP, max(-TOP - 1, sum(a * b for a, b in zip(q, c)))), j) for other, (j, c) in enumerate(whole) if other != at]
            best = sorted(scored, key=lambda x: (-x[0], x[1] is None, x[1] or 0))[:k]
            out += [(i, rank, j, score) for rank, (score, j) in enumerate(best, 1)]
    return sorted(out, key=str)


def found(df):
    assert dict(df.dtypes) == {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "bigint"}
    return sorted(map(tuple, df.select("query_id", "rank", "vec_id", "score").collect()), key=str)


def vectors():
    r = random.Random(1)
    rows = [(i, [r.gauss(0, 0.3) for _ in range(12)]) for i in range(150)]
    rows += [(1000 + i, [0.5] * 12) for i in range(90)]  # many equal ones, which tie
    rows += [(50, rows[0][1]), (50, rows[0][1]), (50, [0.1] * 12), (None, [0.5] * 12), (None, None), (201, None), (202, [math.nan] * 12), (203, [None, 1.0]), (204, [math.inf])]
    return rows + [(205, []), (210, [1.0]), (220, [-0.0] * 12), (230, [0.25] * 15), (1100, [0.5] * 12), (1100, [0.5] * 12)]


SCHEMA = "vec_id bigint, embedding array<double>"


@pytest.mark.parametrize("group", (topk_search.GROUP_ROWS, 7))
def test_search(spark, monkeypatch, group):
    monkeypatch.setattr(topk_search, "GROUP_ROWS", group)
    frame = spark.createDataFrame(vectors(), SCHEMA).repartition(5)
    for clash in ("id", "v", "copies", "rank", "SCORE"):
        frame = frame.withColumn(clash, F.lit(1))
    for k in (1, 5) if group > 7 else (3,):
        assert found(topk_search.top_k(frame, frame.filter("vec_id % 10 = 0"), k)) == brute(vectors(), k, 10)


def test_large_components(spark):
    """Scores that 53 and then 64 bits do not hold."""
    r = random.Random(2)
    rows = [(i, [r.choice((1e15, -3e17, 1.5, 1e30, 7e22, -2.25)) for _ in range(3)]) for i in range(40)]
    assert found(topk_search.top_k(*[spark.createDataFrame(rows, SCHEMA)] * 2, 4)) == brute(rows, 4, 1)
    rows = [(i, [float(r.randrange(2**19)), float(r.randrange(2**20))]) for i in range(40)]
    assert found(topk_search.top_k(*[spark.createDataFrame(rows, SCHEMA)] * 2, 4)) == brute(rows, 4, 1)


def test_few_or_none(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert found(topk_search.top_k(empty, empty, 5)) == []
    rows = [(0, [1.0, 2.0]), (1, [3.0, 4.0]), (2, None)]
    frame = spark.createDataFrame(rows, SCHEMA)
    assert found(topk_search.top_k(frame, frame, 5)) == brute(rows, 5, 1)
    assert found(topk_search.top_k(frame, spark.createDataFrame([(9, [1.0])], SCHEMA), 1, own_rows=False)) == [(9, 1, 1, 256 * 768)]


def test_refinement(spark):
    """Scores crowded into one bin of the first pass need several."""
    rows = [(i, [1000.0, i / 256]) for i in range(600)] + [(700, [1e6, 0.0])]
    frame = spark.createDataFrame(rows, SCHEMA)
    asked = frame.filter("vec_id % 100 = 0")
    assert found(topk_search.top_k(frame, asked, 3)) == brute(rows, 3, 100)


def test_query_matches_brute_force(spark):
    rows = [(r.vec_id, r.embedding) for r in table(spark, SMALL, "embeddings").collect()]
    assert found(QUERIES["op11_topk_search"](spark, SMALL)) == brute(rows, 5, 50)
