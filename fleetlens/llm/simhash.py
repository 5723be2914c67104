"""SimHash near-duplicates by deletion-variant signatures.

A 64-bit fingerprint is cut into two segments of 32 bits. Of two fingerprints that differ in three bits at most, one
segment differs in at most one, so it is equal once the right bit is blanked: each segment is indexed under its 32
one-wildcard variants, equal keys meet, and the whole fingerprints are compared. Copies cost nothing: only distinct
fingerprints are indexed. A pair is taken under one key only, and a key sends on a spanning forest of its links, not
all pairs. A key that more than ``group_limit`` fingerprints share is streamed past and dealt anew by the exact bytes
of its other segment (of three differing bits over four bytes, one byte is equal).

Components are then joined by alternating large and small stars.

Defined results: a NULL or empty text has fingerprint zero and links like any other; a text of fewer than three
words is one shingle; rows of a repeated id each get their own fingerprint and all of them the id's class; a NULL id
keeps a NULL component unless it links to an id. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.llm.common import as_bytes, cut

SHINGLE = 3
SEED = 42
DISTANCE = 3
GROUP_LIMIT = 4096


def simhash(text: bytes, shingle: int = SHINGLE) -> int:
    """Signed 64-bit fingerprint of the lower-cased text's word shingles."""
    words = text.lower().split()  # bytes.lower() changes A-Z alone
    if not words:
        return 0
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    else:
        line = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        digest = xxhash.xxh64_intdigest
        hashes = [digest(line[a:b], SEED) for a, b in zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)]
    total, n = np.zeros(64, np.int64), len(hashes)
    for at in range(0, n, 1 << 16):  # a very long text goes block by block
        block = np.array(hashes[at : at + (1 << 16)], ">u8")
        total += np.unpackbits(block.view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > n).view(">u8")[0].astype(np.uint64).view(np.int64))


@F.arrow_udf(T.LongType())
def fingerprint(text: pa.Array) -> pa.Array:
    return pa.array([simhash(t or b"") for t in as_bytes(text)], pa.int64())


def _bits(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def _own_place(differing: np.ndarray) -> np.ndarray:
    """The one key under which a pair is taken: the first segment with at most one differing bit, and that bit's place."""
    low, high = differing & np.uint64(0xFFFFFFFF), differing >> np.uint64(32)
    use_high = _bits(high) <= 1
    part = np.where(use_high, high, low)
    place = _bits(np.maximum(part, np.uint64(1)) - np.uint64(1)).astype(np.int64)
    return np.where(use_high, 32 + place, place)


def join_classes(label: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the links between differently labelled items are needed to join their classes, and the labels after it."""
    parent: dict[int, int] = {}

    def top(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = x = parent.get(up, up)
        return x

    needed = np.zeros(len(left), bool)
    for i, (a, b) in enumerate(zip(label[left].tolist(), label[right].tolist(), strict=True)):
        x, y = top(a), top(b)
        if x != y:
            parent[max(x, y)] = min(x, y)
            needed[i] = True
    moved = np.arange(len(label))
    for x in parent:
        moved[x] = top(x)
    return needed, moved[label]


def linked(prints: np.ndarray, keys: np.ndarray, place: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between rows (sorted by key) that share a key, are near and belong to that key's place.

    Rows are compared with the one ``step`` places on, for one step after another. Rows that earlier steps have joined
    are not compared again, and of a step's links only those that join classes are kept, so no list of pairs builds up.
    """
    lefts, rights = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    label = np.arange(len(keys))
    at, step = np.arange(len(keys) - 1), 1
    while True:
        at = at[at + step < len(keys)]
        at = at[keys[at] == keys[at + step]]
        if not len(at):
            break
        apart = at[label[at] != label[at + step]]
        differing = prints[apart] ^ prints[apart + step]
        good = (_bits(differing) <= distance) & (differing != 0)
        hit = apart[good]
        own = hit[_own_place(differing[good]) == place[hit]]
        if len(own):
            needed, label = join_classes(label, own, own + step)
            lefts.append(own[needed])
            rights.append(own[needed] + step)
        step += 1
    return np.concatenate(lefts), np.concatenate(rights)


EDGES = "a bigint, b bigint, place int, key bigint"


def _verify(distance: int, limit: int | None):
    """Over rows sorted by (place, key, print): links of each key as (a, b), rows of too large keys as (a, NULL, place, key)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 3  # place, key, print of a key that may go on
        passing: tuple[int, int] | None = None  # a key too large, whose rows are passed on as they come

        def emit(a, b, place, key):
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(place, pa.int32()), pa.array(key, pa.int64())], names=["a", "b", "place", "key"])

        def overflow(place, key, prints):
            return emit(prints, [None] * len(prints), place, key)

        def settle(place, key, prints):
            group = np.concatenate(([0], np.cumsum((place[1:] != place[:-1]) | (key[1:] != key[:-1]))))
            left, right = linked(prints.view(np.uint64), group, place & 63, distance)
            return emit(prints[left], prints[right], [None] * len(left), [None] * len(left))

        for batch in batches:
            columns = [batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)]
            if not len(columns[0]):
                continue
            if passing is not None:
                more = (columns[0] == passing[0]) & (columns[1] == passing[1])
                if more.any():
                    yield overflow(*(c[more] for c in columns))
                    columns = [c[~more] for c in columns]
                if not len(columns[0]):
                    continue
                passing = None
            place, key, prints = (np.concatenate((h, c)) for h, c in zip(held, columns, strict=True))
            bounds = np.flatnonzero((place[1:] != place[:-1]) | (key[1:] != key[:-1])) + 1
            starts, ends = np.concatenate(([0], bounds)), np.concatenate((bounds, [len(key)]))
            if limit is not None:
                large = ends - starts > limit
                for s, e in zip(starts[large].tolist(), ends[large].tolist(), strict=True):
                    yield overflow(place[s:e], key[s:e], prints[s:e])
                if large[-1]:
                    passing = (int(place[-1]), int(key[-1]))
                keep = np.repeat(~large, ends - starts)
            else:
                keep = np.ones(len(key), bool)
            last = slice(starts[-1], ends[-1]) if passing is None else slice(len(key), len(key))
            keep[last] = False
            held = [place[last], key[last], prints[last]]
            if keep.any():
                yield settle(place[keep], key[keep], prints[keep])
        if len(held[0]):
            yield settle(*held)

    return run


def _variants(prints: DataFrame) -> DataFrame:
    """64 keys of a fingerprint: a segment with one of its bits set, under that segment and bit."""
    places = F.array(*(F.lit(i) for i in range(64)))
    spread = prints.select("print", F.explode(places).alias("place"))
    segment = F.when(F.col("place") < 32, F.col("print").bitwiseAND(F.lit(0xFFFFFFFF))).otherwise(F.expr("shiftrightunsigned(print, 32)"))
    return spread.select("place", segment.bitwiseOR(F.expr("shiftleft(1L, place % 32)")).alias("key"), "print")


def near_links(prints: DataFrame, distance: int = DISTANCE, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """(a, b) of a spanning set of the links between distinct fingerprints ``print``; written to the shared folder."""
    if not 0 <= distance <= DISTANCE:
        raise ValueError("two segments with one wildcard find up to 3 differing bits")

    def verified(keys: DataFrame, limit: int | None) -> DataFrame:
        dealt = keys.repartition("place", "key").sortWithinPartitions("place", "key", "print")
        return dealt.mapInArrow(_verify(distance, limit), EDGES)

    first = cut(verified(_variants(prints), group_limit), "simhash-links")
    links, rest = first.filter(F.col("b").isNotNull()).select("a", "b"), first.filter(F.col("b").isNull())
    if rest.isEmpty():
        return links
    # Keys shared by many: also equal in one byte of the other segment. At most 2^25 fingerprints agree in 39 bits.
    other = F.when(F.col("place") < 32, F.expr("shiftrightunsigned(a, 32)")).otherwise(F.col("a").bitwiseAND(F.lit(0xFFFFFFFF)))
    spread = rest.select("a", "place", "key", other.alias("o"), F.explode(F.array(*(F.lit(i) for i in range(4)))).alias("part"))
    byte = F.expr("shiftrightunsigned(o, part * 8)").bitwiseAND(F.lit(255))
    finer = F.col("key").bitwiseOR(F.expr("shiftleft(CAST(part AS BIGINT), 40)")).bitwiseOR(F.shiftleft(byte, 32))
    finer = spread.select("place", finer.alias("key"), F.col("a").alias("print"))
    return links.unionAll(cut(verified(finer, None), "simhash-links").select("a", "b"))


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node of each node's component, for nodes that have links."""
    both = lambda e: e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = cut(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "stars")
    for _ in range(max_rounds):
        # Large star: every larger neighbour is hung onto the smallest one. Rows here are (a larger, b smaller).
        around = both(edges)
        least = around.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = around.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        # Small star: the smaller neighbours and the node itself are hung onto the smallest.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("x"), "m", "a")
        small = small.select(F.explode(F.array("x", "a")).alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        small = cut(small, "stars")
        # Stars alone are left when no node is both hung and hung onto, and none is hung twice.
        open_nodes = small.groupBy("a").count().filter("count > 1").select("a").unionAll(small.select("a").intersect(small.select(F.col("b").alias("a"))))
        edges = small
        if open_nodes.isEmpty():
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    raise RuntimeError("components did not settle")


def _rooted(distinct: DataFrame, distance: int, group_limit: int) -> DataFrame:
    """``distinct`` prints with the ``root`` print of their class."""
    roots = components(near_links(distinct.select("print"), distance, group_limit))
    return distinct.join(roots.withColumnRenamed("node", "print"), "print", "left").withColumn("root", F.coalesce("root", "print"))


def first_rows(docs: DataFrame, key_col: str, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """(key) of one row of each class: the one with the smallest id, NULL ids last, and of those the smallest key.

    ``key_col`` tells rows apart, and is the same wherever the table is read (see ``common.with_row_place``).
    """
    row = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col(key_col).alias("key"))
    prints = cut(docs.select(row.alias("row"), fingerprint(F.col(text_col)).alias("print")), "simhash")
    classes = _rooted(prints.groupBy("print").agg(F.min("row").alias("least")), distance, group_limit)
    return classes.groupBy("root").agg(F.min("least").alias("least")).select("least.key")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """One row per document: ``id``, ``print`` (signed 64 bits) and ``component``, the smallest id of its class."""
    prints = cut(docs.select(F.col(id_col).alias("id"), fingerprint(F.col(text_col)).alias("print")), "simhash")
    classes = _rooted(prints.groupBy("print").agg(F.min("id").alias("least")), distance, group_limit)
    best = classes.groupBy("root").agg(F.min("least").alias("component"))
    named = classes.join(best, "root").select("print", "component")
    return prints.join(named, "print").select("id", "print", "component")
