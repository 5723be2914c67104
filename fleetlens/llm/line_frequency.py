"""Quality rules by cross-document line frequency.

Each text's lines are normalised and hashed, distinct documents are counted per host and line, lines above the
host's limit are removed, and documents left with too little are rejected. The limit is a share of the host's texts,
but never above a fixed count, so that a line does not escape because its host is large.

Defined results: a NULL text has no words and fails; a NULL host is a host of its own; a NULL or repeated id is a
row like any other (rows are told apart by a key given when the statistics are written). Rows with the same text in
one host are one document to the counts, so a large group of copies does not make its own lines frequent.
An empty table gives an empty result. Columns other than the three named ones are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.llm.common import CONTINUATION, SPACE, as_bytes, cut

SYMBOLS = b"#*$%&|<>"
WINDOW = 8
SHARE_CAP = 1000
# Upper case to lower, digits to 0: lines that differ in these alone are the same line.
LINE_FOLD = bytes(b + 32 if 65 <= b <= 90 else 48 if 48 <= b <= 57 else b for b in range(256))

STATS = T.StructType([
    *(T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "text_hash")),
    T.StructField("lines", T.ArrayType(T.LongType())),
    T.StructField("line_words", T.ArrayType(T.IntegerType())),
])


def _signed(text: bytes) -> int:
    h = xxhash.xxh64_intdigest(text)
    return h - (1 << 64) if h >> 63 else h


def line_hash(line: bytes) -> int:
    """Hash of a line after normalising case, digits and white space."""
    return _signed(b" ".join(line.translate(LINE_FOLD).split()))


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows of 8 that occur at least twice in the text."""
    if window != 8:
        raise ValueError("windows are built by doubling to 8 words")
    n = len(words)
    if n <= window:
        return 0
    seen: dict[bytes, int] = {}
    rank = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    if len(seen) == n:
        return 0
    for width in (1, 2, 4):  # the rank of 2w words is that of its two halves
        _, rank = np.unique(rank[:-width] * (n + 1) + rank[width:], return_inverse=True)
        if rank.max() + 1 == len(rank):
            return 0
    starts = np.flatnonzero(np.bincount(rank)[rank] > 1)
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + window, -1)
    return int(np.count_nonzero(np.cumsum(edges[:n])))


def text_stats(text: bytes) -> tuple:
    words = text.split()
    solid = text.translate(None, SPACE)
    seen: set[bytes] = set()
    found: dict[int, int] = {}
    repeated = 0
    for line in text.split(b"\n"):
        n = len(line.split())
        if not n:
            continue
        if line in seen:
            repeated += 1
        seen.add(line)
        h = line_hash(line)
        found[h] = found.get(h, 0) + n
    return (
        len(words), len(solid.translate(None, CONTINUATION)), len(text) - len(text.translate(None, SYMBOLS)), repeated,
        repeated_words(words), _signed(text), list(found), list(found.values()),
    )


def _stats_of(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [text_stats(t or b"") for t in as_bytes(batch.column("_text"))]
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in STATS]
            arrays = [batch.column("_id"), batch.column("_host"), batch.column("_text").is_null()]
            arrays += [pa.array(c, f.type) for c, f in zip(columns, list(schema)[3:], strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, schema=pa.schema([pa.field(n, a.type) for n, a in zip(schema.names, arrays, strict=True)]))

    return run


def document_stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """One row per document, written to the shared folder: a row key, id, host, the base counts and its line hashes."""
    taken = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(host_col).alias("_host"))
    schema = T.StructType([
        T.StructField("id", taken.schema["_id"].dataType), T.StructField("host", taken.schema["_host"].dataType),
        T.StructField("no_text", T.BooleanType()), *STATS.fields,
    ])
    from pyspark.sql.pandas.types import to_arrow_schema

    rows = taken.mapInArrow(_stats_of(to_arrow_schema(schema)), schema)
    return cut(rows.withColumn("key", F.monotonically_increasing_id()), "line-stats")


def frequent_lines(stats: DataFrame, max_docs: int = 20, max_share: float = 0.05, share_cap: int = SHARE_CAP) -> DataFrame:
    """(host, line, n_docs) of lines in more than ``max_docs`` documents and more than ``max_share`` of the host's, a
    share that counts as ``share_cap`` documents at most."""
    # One row for each host, text and line: copies of a text count once.
    texts = stats.groupBy("host", "text_hash").agg(F.any_value("lines").alias("lines"))
    sizes = texts.groupBy("host").agg(F.count(F.lit(1)).alias("host_docs"))
    counts = texts.select("host", F.explode("lines").alias("line")).groupBy("host", "line").agg(F.count(F.lit(1)).alias("n_docs"))
    counts = counts.filter(F.col("n_docs") > max_docs)
    return (
        counts.alias("c").join(sizes.alias("s"), F.col("c.host").eqNullSafe(F.col("s.host")))
        .filter(F.col("n_docs") > F.least(F.col("host_docs") * max_share, F.lit(float(share_cap)))).select("c.host", "line", "n_docs")
    )


def judge(stats: DataFrame, frequent: DataFrame, min_words: int = 10, min_share: float = 0.3) -> DataFrame:
    """Per document: base counts, words on removed lines, ``removed_lines`` (their hashes), and the verdicts."""
    lines = stats.select("key", "host", F.explode(F.arrays_zip("lines", "line_words")).alias("z")).select("key", "host", F.col("z.lines").alias("line"), "z.line_words")
    removed = (
        lines.alias("l").join(frequent.alias("f"), F.col("l.host").eqNullSafe(F.col("f.host")) & (F.col("l.line") == F.col("f.line")))
        .groupBy("key").agg(F.sum("line_words").alias("removed_words"), F.collect_list("l.line").alias("removed_lines"))
    )
    joined = stats.join(removed, "key", "left")
    cut_words = F.coalesce("removed_words", F.lit(0))
    left = F.col("n_words") - cut_words
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    depleted = (left < min_words) | (left < min_share * F.col("n_words"))
    return joined.select(
        "key", F.col("id"), "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", cut_words.alias("removed_words"),
        F.coalesce("removed_lines", F.array().cast("array<bigint>")).alias("removed_lines"), failed.alias("base_failed"), depleted.alias("depleted"), (~failed & ~depleted).alias("kept"),
    )


def line_frequency(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
    max_docs: int = 20, max_share: float = 0.05, min_words: int = 10, min_share: float = 0.3, share_cap: int = SHARE_CAP,
) -> DataFrame:
    """The whole rule: statistics, frequent lines per host, verdict per document."""
    stats = document_stats(docs, id_col, text_col, host_col)
    return judge(stats, frequent_lines(stats, max_docs, max_share, share_cap), min_words, min_share)


@F.arrow_udf(T.StringType())
def strip_lines(text: pa.Array, removed: pa.Array) -> pa.Array:
    """The text without lines whose hash is listed; other lines stay as they are. NULL stays NULL."""
    out = []
    for body, hashes in zip(as_bytes(text), removed.to_pylist(), strict=True):
        if body is None or not hashes:
            out.append(body)
            continue
        gone = set(hashes)
        out.append(b"\n".join(x for x in body.split(b"\n") if not x.split() or line_hash(x) not in gone))
    return pa.array([None if x is None else x.decode() for x in out], pa.string())
