"""Fact tables stored bucketed by the key they are joined on, so that a join moves the small side alone.

A bucket would hold all rows of a key, however many. Rows are therefore bucketed by the key and a salt, a hash of the row
below ``SALTS``: a key of very many rows lies in as many buckets, and the small side of a join is repeated once per salt.
The table is read bucket by bucket without an exchange, sorted within its files.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.sources.catalog import MartCatalog, input_version

SALTS = 8
BUCKETS = 64
_SALT = "_salt"


@dataclass(frozen=True)
class Bucketed:
    """A bucketed table under a path, and how it was dealt."""

    path: str
    schema: str
    keys: tuple[str, ...]
    buckets: int
    salts: int

    def read(self, spark: SparkSession) -> DataFrame:
        """The table by its catalog entry, made anew in a session that lacks it: bucketing is known to the catalog alone."""
        name = f"bucketed_{hashlib.sha256(self.path.encode()).hexdigest()[:24]}"
        if not spark.catalog.tableExists(name):
            by = ", ".join(f"`{k}`" for k in (*self.keys, _SALT))
            spark.sql(f"CREATE TABLE {name} ({self.schema}) USING parquet CLUSTERED BY ({by}) SORTED BY ({by}) INTO {self.buckets} BUCKETS LOCATION '{self.path}'")
        return spark.table(name)

    def join(self, spark: SparkSession, small: DataFrame, how: str = "inner") -> DataFrame:
        """The table's rows beside those of ``small`` of the same keys; no row of the table is moved."""
        salts = F.explode(F.sequence(F.lit(0), F.lit(self.salts - 1)))
        return self.read(spark).join(small.withColumn(_SALT, salts), [*self.keys, _SALT], how).drop(_SALT)


def bucketed(
    df: DataFrame, name: str, keys: Sequence[str], buckets: int = BUCKETS, salts: int = SALTS, catalog: MartCatalog | None = None
) -> Bucketed:
    """``df`` written by buckets of ``keys`` when this version of it is first asked for.

    One task writes a bucket, so that each is one sorted file. Rows without a key are dealt by their content.
    """
    spark = df.sparkSession
    catalog = catalog or MartCatalog(spark)
    version = input_version(spark, {name: df}, keys=",".join(keys), buckets=buckets, salts=salts)
    known = catalog.path(f"{name}-buckets", version) if version else None
    salted = df.withColumn(_SALT, F.pmod(F.xxhash64(*(F.col(f"`{c}`") for c in df.columns)), F.lit(salts)).cast("int"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in salted.schema.fields)
    if known is None:
        known = f"{catalog.folder}/{name}-buckets/{uuid.uuid4().hex}"
        table = f"bucketed_{hashlib.sha256(known.encode()).hexdigest()[:24]}"
        by = [*keys, _SALT]
        # Dealt as the buckets are, or every task would write a file for each.
        salted.repartition(buckets, *by).write.bucketBy(buckets, *by).sortBy(*by).option("path", known).format("parquet").saveAsTable(table)
        if version:
            catalog.enter(f"{name}-buckets", version, known, spark.table(table).count())
    return Bucketed(known, schema, tuple(keys), buckets, salts)
