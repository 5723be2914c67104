"""The training-data pipeline: quality classifier, SimHash near-dedup, benchmark decontamination, secret scan, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet before the next one reads it.
All but the last return the columns of ``documents``; the last returns one row per document that is left, with the words
the mix takes of it. Benchmark and labels are read from ``sf_dir``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.llm import decontaminate, mixing, quality_classifier, secret_scan, simhash
from fleetlens.llm.common import cut, keep_rows, unused, with_row_place
from fleetlens.llm.queries import KEEP_FROM, graded, table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that probably have the best grade; toxic ones and those of low quality go."""
    model = quality_classifier.train(docs, graded(table(spark, sf_dir, "labels")))
    quality = unused(docs, "_quality")
    scored = quality_classifier.classify(docs, model, score_col=quality)
    return scored.filter(F.col(quality)["tail_probability"] >= KEEP_FROM).select(*docs.columns)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies one row: the smallest id's, NULL ids last; of repeated ids the first as written."""
    place = unused(docs, "_place")
    placed = with_row_place(docs, place)
    first = simhash.first_rows(placed, place)
    return keep_rows(placed, place, first.select("key.file", "key.row")).select(*docs.columns)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth is benchmark text."""
    hits = unused(docs, "_hits")
    found = decontaminate.find_hits(docs, table(spark, sf_dir, "benchmark"), hits_col=hits)
    return found.filter(~decontaminate.contaminated(hits)).select(*docs.columns)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by a mark and their length counted anew."""
    clean = secret_scan.redact_secrets(docs, secret_scan.new_ledger(spark))
    return clean.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes of each document."""
    made = mixing.mix(docs)
    return mixing.mixed_documents(made).select(F.col("id").alias("doc_id"), "source", "size", "source_size", "target", "taken")


STAGES = [
    ("quality_classifier", good_quality),
    ("simhash_near_dedup", without_near_copies),
    ("benchmark_decontamination", without_benchmark),
    ("secret_scan", without_secrets),
    ("source_mixing", mixed),
]

# The classifier's training and the fingerprints' hash are beyond SQL; tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
