"""Join shapes the metrics share."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.sources.reference_data import account_hubs


def left_join_spread(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Left join on a key that many left rows may lack.

    Rows without the key match nothing, yet a plain join would hash them all to one task; a second key
    taken from their content spreads them. On the right that key is always 0, written so that the optimizer
    keeps it: a literal would be folded into a filter and no longer take part in the shuffle.
    """
    content = 1 + F.pmod(F.xxhash64(*left.columns), F.lit(4096))
    spread = left.withColumn("_spread", F.when(F.col(key).isNull(), content).otherwise(0))
    matches = right.withColumn("_spread", F.pmod(F.xxhash64(key), F.lit(1)))
    return spread.join(matches, [key, "_spread"], "left").drop("_spread")


def left_join_first(left: DataFrame, right: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Left join in which each key of ``right`` contributes its first row by ``order``.

    The first row is found by an aggregate, which reduces repeated keys before the shuffle.
    """
    kept = [*order, *(c for c in right.columns if c != key and c not in order)]
    first = right.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*kept)).alias("_first"))
    return left_join_spread(left, first.select(key, "_first.*"), key)


def with_flag(rows: DataFrame, marked: DataFrame, key: str, flag: str) -> DataFrame:
    """Add whether the row's key occurs in ``marked``."""
    keys = marked.select(key).filter(F.col(key).isNotNull()).distinct().withColumn("_hit", F.lit(True))
    return left_join_spread(rows, keys, key).withColumn(flag, F.coalesce("_hit", F.lit(False))).drop("_hit")


def with_account(centers: DataFrame) -> DataFrame:
    """Center rows of the curated accounts, with the account their hub belongs to."""
    return centers.join(F.broadcast(account_hubs(centers.sparkSession)), "hub_id")
