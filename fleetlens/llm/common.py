"""What the operators share: intermediate tables in the cluster's shared folder, and words of a text as bytes."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE = b" \t\n\x0b\x0c\r"
CONTINUATION = bytes(range(0x80, 0xC0))

# Maps A-Z to a-z, keeps a-z, 0-9 and every byte of a non-ASCII character, and turns all else into a space.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see, from spark.checkpoint.dir.

    Unset, a local session (as in tests) gets a temporary one; on a cluster that is an error, as executors
    would not see each other's files.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    folder = tempfile.mkdtemp(prefix="fleetlens-shared-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def cut(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back, so that no lost executor makes it be computed again."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def with_row_place(df: DataFrame, name: str) -> DataFrame:
    """``df`` with ``name``: file and place in the file of each row, the same wherever the table is read.

    A plain Parquet table has them without being written again; anything else is written first.
    """
    if df._jdf.queryExecution().analyzed().nodeName() != "LogicalRelation":
        df = cut(df, "placed")
    source = df.metadataColumn("_metadata")
    return df.withColumn(name, F.struct(source["file_path"].alias("file"), source["row_index"].alias("row")))


BITMAP_BYTES = 64 << 20  # of bitmaps that are broadcast: places of some 500,000,000 rows


def keep_rows(df: DataFrame, place: str, kept: DataFrame) -> DataFrame:
    """Rows of ``df``, which ``with_row_place`` has named, that ``kept`` (file, row) lists.

    The places are packed as bitmaps of 32,768 rows each, a bit a row. As long as these are small they are broadcast,
    and no text is shuffled; beyond, rows and bitmaps are joined by file and bitmap.
    """
    name = unused(df, "_kept")
    maps = kept.groupBy("file", F.expr("bitmap_bucket_number(row + 1)").alias("part")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(row + 1))").alias("bits"))
    maps = cut(maps.select(F.struct("file", "part", "bits").alias(name)), "kept-rows")
    mine = F.col(name)
    size = maps.agg(F.sum(F.length(mine["bits"]) + F.length(mine["file"]))).first()[0] or 0
    on = (F.col(place)["file"] == mine["file"]) & (F.expr(f"bitmap_bucket_number(`{place}`.row + 1)") == mine["part"])
    bit = F.expr(f"bitmap_bit_position(`{place}`.row + 1)")
    byte = F.conv(F.hex(F.substring(mine["bits"], (bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    joined = df.join(F.broadcast(maps) if size <= BITMAP_BYTES else maps, on)
    return joined.filter(F.floor(byte / F.pow(F.lit(2), bit % 8)) % 2 == 1).select(*df.columns)


def unused(df: DataFrame, name: str) -> str:
    """``name``, or the next longer one that no column of ``df`` has in any spelling."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def as_bytes(texts: pa.Array) -> list[bytes | None]:
    """UTF-8 of each text, without decoding it."""
    return texts.cast(pa.large_binary()).to_pylist()


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
