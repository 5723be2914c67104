"""Spark session settings."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Facts of this size are thinned by a Bloom filter of the keys a filtered side has left, up to that size of the side.
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "256m",
    "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "64m",
    # Recording the Python line of every column costs several driver round trips each.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def session(app: str = "fleetlens") -> SparkSession:
    """A session for a cluster; master, memory and shuffle width come from its own configuration."""
    builder = SparkSession.builder.appName(app)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def local_session(cpus: str | int | None = None) -> SparkSession:
    """A single-machine session for tests and benchmarks."""
    cores = cpus or os.environ.get("BENCH_CPUS", "8")
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("fleetlens-local")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", os.environ.get("FLEETLENS_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        # Test tables are single small files: join and shuffle them as a cluster would the real ones,
        # instead of working in the one task that scans the file.
        .config("spark.sql.autoBroadcastJoinThreshold", "1000000")
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "128k")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor sees, as spark.checkpoint.dir names it.

    Unset, a local session gets a temporary one, the same until the process ends; on a cluster that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return folder or _temporary_folder()


# Shuffle files go as soon as the write or collect they served ends, and what is written takes two thirds of the usual bytes.
SPARING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.parquet.compression.codec": "zstd"}


@contextmanager
def sparing_disk(spark: SparkSession) -> Iterator[None]:
    """Settings for a job of many steps: else the shuffle files of all of them lie on disk until the driver collects its garbage."""
    before = {key: spark.conf.get(key) for key in SPARING}
    for key, value in SPARING.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def file_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of a file, or of all files under a folder, in whatever store it lies."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(place).getLength()


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of our own, in whatever store it lies; it may be gone already."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@cache
def _temporary_folder() -> str:
    return tempfile.mkdtemp(prefix="fleetlens-")
