"""Versioned marts: a fingerprint of the inputs leads to the Parquet table that was built from them.

A version is a hash over the input files (path, length, time of change) and the parameters of the build. Every build is
written under a path of its own and entered only once it is complete, so readers never see a half-written mart, two
builders do no harm, and a version that readers still use is left in place when its inputs change.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.session import shared_folder

_ENTRY = "path string, row_count bigint, built string"
_KNOWN: dict[tuple[str, str], str] = {}


def input_version(spark: SparkSession, inputs: Mapping[str, DataFrame], **parameters: object) -> str | None:
    """One text for the files behind ``inputs`` and the parameters; None where an input has no files to tell it by.

    The files are listed by tasks (their content is not read), so very many of them do not burden the driver's loop.
    """
    said = [f"{k}={v}" for k, v in sorted(parameters.items())]
    files = {name: sorted(set(df.inputFiles())) for name, df in inputs.items()}
    if not all(files.values()):
        return None
    every = sorted({f for found in files.values() for f in found})
    facts = spark.read.format("binaryFile").load(every).select(F.xxhash64("path", "modificationTime", "length").alias("h"))
    seen = facts.agg(F.count("*").alias("n"), F.sum(F.col("h").bitwiseAND(0x7FFFFFFF)).alias("low"), F.bit_xor("h").alias("mix")).first()
    names = [f"{name}:{hashlib.sha256(chr(10).join(found).encode()).hexdigest()}" for name, found in sorted(files.items())]
    return hashlib.sha256("|".join([*said, *names, *map(str, seen)]).encode()).hexdigest()[:32]


class MartCatalog:
    """Marts by name and version under one folder."""

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark = spark
        self.folder = (folder or f"{shared_folder(spark).rstrip('/')}/mart-catalog").rstrip("/")

    def entries(self, name: str, version: str) -> DataFrame | None:
        try:
            return self.spark.read.schema(_ENTRY).json(f"{self.folder}/entries/{name}/{version}")
        except AnalysisException:
            return None

    def path(self, name: str, version: str) -> str | None:
        """Where the first complete build of this version lies; None if there is none yet."""
        key = (f"{self.folder}/{name}", version)
        if key not in _KNOWN:
            known = self.entries(name, version)
            first = known.orderBy("built", "path").first() if known is not None else None
            if first is None:
                return None
            _KNOWN[key] = first["path"]
        return _KNOWN[key]

    def resolve(self, name: str, version: str | None, build: Callable[[], DataFrame], partition: str | None = None) -> DataFrame:
        """The mart of this version, built first where that was not done yet. Without a version it is built each time."""
        found = self.path(name, version) if version else None
        if found is None:
            found = f"{self.folder}/{name}/{version or 'unversioned'}-{uuid.uuid4().hex}"
            made = build()
            (made.write.partitionBy(partition) if partition else made.write).parquet(found)
            if version:
                self.enter(name, version, found, self.spark.read.schema(made.schema).parquet(found).count())
        return self.spark.read.parquet(found)

    def enter(self, name: str, version: str, path: str, rows: int) -> None:
        """Record a complete build."""
        entry = self.spark.range(1).select(F.lit(path).alias("path"), F.lit(rows).alias("row_count"), F.current_timestamp().cast("string").alias("built"))
        entry.write.mode("append").json(f"{self.folder}/entries/{name}/{version}")
        _KNOWN[(f"{self.folder}/{name}", version)] = path
