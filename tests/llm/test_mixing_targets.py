"""Every source takes its target to a word, however small it is beside the others."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from fleetlens.llm import mixing

from test_corpus_operators import make


@pytest.mark.parametrize("block", (None, 1, 50_000))
def test_small_sources_beside_long_documents(spark, block):
    rows = [(i, "w " * 40, f"small{i}") for i in range(24)] + [(100 + i, "w " * 1000, "hot") for i in range(200)]
    rows += [(400 + i, "w " * (300 + 7 * i), f"s{i % 5}") for i in range(25)] + [(500, "one", "tiny"), (501, None, "none"), (None, "w " * 77, None), (None, "w " * 77, None), (400, "x " * 9, "s0")]
    made = mixing.mix(make(spark, rows), block=block)
    out = mixing.mixed_documents(made)
    sums = out.groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target"), F.max("source_size").alias("size")).collect()
    assert all(abs(r.taken - r.target) <= 1 and r.taken <= 2 * r["size"] for r in sums)
    assert {r.taken for r in sums if r.source and r.source.startswith("small")} == {80}
    assert out.filter("taken < 0 OR taken > 2 * size").isEmpty() and out.count() == len(rows)
    # Each slot holds one block of one source; its pieces lie side by side and are no longer than a block.
    assert made.schedule.groupBy("slot").count().filter("count > 1").isEmpty()
    assert made.schedule.groupBy("rank", "block").count().filter("count > 1").isEmpty()
    words = made.pieces.groupBy("slot").agg(F.sum("words").alias("n")).agg(F.min("n"), F.max("n")).first()
    assert words[0] > 0 and words[1] <= (block or 4096)
    assert made.pieces.agg(F.sum("words")).first()[0] == sum(r.taken for r in sums)
