"""A line above a fixed number of documents goes, however many documents its host has."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlens.llm import line_frequency


def test_frequent_line_of_a_large_host(spark):
    own = F.translate(F.md5(F.col("id").cast("string")), "0123456789", "ghijklmnop")
    text = F.when(F.col("id") < 1001, F.concat(F.lit("all rights reserved by us\n"), own)).when(F.col("id") < 2001, F.concat(F.lit("see the next page\n"), own)).otherwise(own)
    docs = spark.range(30_000).select(F.col("id").alias("doc_id"), text.alias("text"), F.lit("large").alias("source"))
    out = line_frequency.line_frequency(docs).filter("removed_words > 0").select("id").collect()
    # 1,001 documents are beyond the cap of 1,000 and below a twentieth of the host's; 1,000 are not beyond it.
    assert sorted(r.id for r in out) == list(range(1001))
