"""Benchmark decontamination: a broadcast hash set of benchmark n-grams, scanned for in every training text.

Words are what is left between characters other than digits, letters and non-ASCII ones, A-Z lower-cased. A window is
13 consecutive words of an item; a shorter item is one window. Hash hits are verified word by word.

What is broadcast is bounded: the items are dealt into blocks of at most ``block_words`` words; with one block the
hits are found in one pass, with more each block is broadcast and scanned for on its own and the hits of a document
are joined afterwards. A single item longer than a block is a block of its own.

Defined results: a NULL or empty text has no words, no hits, and is not contaminated; NULL items and items without
words have no windows; NULL item ids are not listed; equal items are listed under each of their ids. NULL or repeated
document ids are rows like any other with one block; with several, rows of equal id and text are told apart by a key.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.llm.common import FOLD, as_bytes, cut, unused

WINDOW = 13
BLOCK_WORDS = 2_000_000
MIX = np.uint64(0x9E3779B97F4A7C15)
HITS = "struct<n_words:bigint,spans:array<struct<start:int,end:int>>,items:array<string>>"


def fold_words(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


def _rolled(ids: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of every run of ``width`` ids."""
    out = np.zeros(max(0, len(ids) - width + 1), np.uint64)
    for k in range(width):
        out = out * MIX + ids[k : len(ids) - width + 1 + k]
    return out ^ (out >> np.uint64(29))


class WindowSet:
    """The windows of a block of benchmark items, found by hash and verified by their words."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        self.by_width: dict[int, dict[tuple[int, ...], list[str]]] = {}
        for item, text in items:
            words = fold_words(text)
            if not words:
                continue
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words]
            width = min(window, len(ids))
            windows = self.by_width.setdefault(width, {})
            for at in range(len(ids) - width + 1):
                holders = windows.setdefault(tuple(ids[at : at + width]), [])
                if item is not None and (not holders or holders[-1] != item):
                    holders.append(item)
        self.hashes = {}
        for width, windows in self.by_width.items():
            keys = np.array(list(windows), np.uint64)
            flat = np.concatenate([_rolled(k, width) for k in keys]) if len(keys) else np.zeros(0, np.uint64)
            mask = np.zeros(1 << 20, bool)
            mask[flat & np.uint64((1 << 20) - 1)] = True
            self.hashes[width] = (np.sort(flat), mask)

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged spans of words inside windows, and the items whose windows occur."""
        n = len(words)
        known = self.vocabulary.get
        ids = np.fromiter((known(w, 0) for w in words), np.uint64, n)
        starts: list[tuple[int, int]] = []
        items: set[str] = set()
        for width, windows in self.by_width.items():
            if n < width:
                continue
            flat, mask = self.hashes[width]
            rolled = _rolled(ids, width)
            at = np.flatnonzero(mask[rolled & np.uint64((1 << 20) - 1)])
            if not len(at):
                continue
            place = np.minimum(np.searchsorted(flat, rolled[at]), len(flat) - 1)
            for s in at[flat[place] == rolled[at]].tolist():
                holders = windows.get(tuple(ids[s : s + width].tolist()))
                if holders is not None:
                    starts.append((s, s + width))
                    items.update(holders)
        return merged(starts), items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(a, b) for a, b in out]


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, block_words: int) -> list[list[int]]:
    """Groups of hash buckets whose items have at most ``block_words`` words together (a bucket at least)."""
    bucket = F.pmod(F.xxhash64(F.col(item_col), F.col(text_col)), F.lit(1024)).cast("int").alias("b")
    sizes = benchmark.select(bucket, F.regexp_count(text_col, F.lit("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+")).alias("n"))
    groups: list[list[int]] = []
    room = 0
    for b, n in sizes.groupBy("b").agg(F.coalesce(F.sum("n"), F.lit(0))).orderBy("b").collect():  # 1,024 rows at most
        if not groups or room + n > block_words:
            groups.append([])
            room = 0
        groups[-1].append(b)
        room += n
    return groups or [[]]


_SETS: dict[str, WindowSet] = {}  # of a Python worker: the block it last used


def _finder(spark: SparkSession, items: list[tuple[str | None, bytes]], window: int):
    held, name = spark.sparkContext.broadcast(items), uuid.uuid4().hex

    @F.arrow_udf(HITS)
    def find(text: pa.Array) -> pa.Array:
        if name not in _SETS:
            _SETS.clear()
            _SETS[name] = WindowSet(held.value, window)
        words = [fold_words(t or b"") for t in as_bytes(text)]
        found = [_SETS[name].scan(w) for w in words]
        return pa.array(
            [{"n_words": len(w), "spans": [{"start": a, "end": b} for a, b in spans], "items": sorted(ids)} for w, (spans, ids) in zip(words, found, strict=True)],
            pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), ("items", pa.list_(pa.string()))]),
        )

    return find


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


@F.arrow_udf(SPANS)
def _merge(spans: pa.Array) -> pa.Array:
    out = [[{"start": a, "end": b} for a, b in merged([(x["start"], x["end"]) for x in row or []])] for row in spans.to_pylist()]
    return pa.array(out, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))


def find_hits(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    window: int = WINDOW, block_words: int = BLOCK_WORDS, hits_col: str = "hits",
) -> DataFrame:
    """``docs`` with ``hits``: words, merged spans of hit words and the items found. A column of that name is replaced."""
    spark = docs.sparkSession
    bucket = F.pmod(F.xxhash64(F.col(item_col), F.col(item_text_col)), F.lit(1024)).cast("int")
    groups = _blocks(benchmark, item_col, item_text_col, block_words)

    def finder(group: list[int]):
        rows = benchmark.filter(bucket.isin(group)).select(F.col(item_col).cast("string"), item_text_col).collect()  # at most a block
        return _finder(spark, sorted({(i, t.encode()) for i, t in rows if t is not None}, key=str), window)

    if len(groups) == 1:
        return docs.withColumn(hits_col, finder(groups[0])(F.col(text_col)))
    key = unused(docs, "_key")
    keyed = cut(docs.withColumn(key, F.monotonically_increasing_id()), "decontaminate")
    passes = [keyed.select(key, finder(g)(F.col(text_col)).alias("h")) for g in groups]
    found = passes[0]
    for more in passes[1:]:
        found = found.unionAll(more.filter(F.size("h.spans") > 0))
    joined = found.groupBy(key).agg(
        F.max("h.n_words").alias("n"), F.flatten(F.collect_list("h.spans")).alias("s"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("h.items")))).alias("i")
    )
    hits = F.struct(F.col("n").alias("n_words"), _merge("s").alias("spans"), F.col("i").alias("items")).alias(hits_col)
    return keyed.drop(hits_col).join(joined.select(key, hits), key).drop(key)


def n_hit(hits: Column | str) -> Column:
    hits = F.col(hits) if isinstance(hits, str) else hits
    return F.aggregate(hits["spans"], F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["start"])


def contaminated(hits: str = "hits") -> Column:
    """Hit words make up a twentieth of the text or more."""
    return (n_hit(hits) > 0) & (20 * n_hit(hits) >= F.col(hits)["n_words"])


@F.arrow_udf(T.StringType())
def strip_spans(text: pa.Array, spans: pa.Array) -> pa.Array:
    """The text's folded words outside the spans, joined by spaces, where there are spans; else the text as it is."""
    out = []
    for body, cuts in zip(as_bytes(text), spans.to_pylist(), strict=True):
        if body is None or not cuts:
            out.append(None if body is None else body.decode())
            continue
        words, at, kept = fold_words(body), 0, []
        for c in cuts:
            kept += words[at : c["start"]]
            at = c["end"]
        out.append(b" ".join(kept + words[at:]).decode())
    return pa.array(out, pa.string())
