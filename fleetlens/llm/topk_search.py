"""Exact top-k search: every query against every vector, by distributed histogram selection.

Components x become floor(scale * x); the score is the integer inner product. Queries are held in groups of bounded size,
one broadcast at a time, and for each group every task scores all its vectors against all queries of the group, in tiles:

* Each task counts its scores in a histogram per query; Spark sums them, and the bin is located that holds the query's
  k-th highest score. The next pass divides that bin alone, until few scores are at or above its lower end or it is one
  score wide. Of a task's counts only those down to its own k-th score are sent, as lower ones cannot matter.
* A last pass keeps the scores at or above each query's bound, of one task the k best at most (by score, then smaller
  id); these are ranked. So ties of any number cost nothing more, and the result does not depend on partitioning.

Scores are formed anew in each pass, never stored: there are as many as queries times vectors. Vectors are packed once,
in blocks of small integers dealt evenly to all tasks. Nothing else is kept on the driver than one group and its bounds.

Results: ``query_id``, ``rank`` from 1, ``vec_id``, ``score``. A query that is itself a row of ``vectors`` does not find that
row, but finds others of the same id or content. Repeated query rows each have their result. Vectors that are NULL or hold
a NULL or non-finite component (or one that scaling makes infinite) take no part, neither as queries. Shorter vectors count
as ending in zeros; an empty one scores 0. A row without an id can be found, last among ties, and cannot ask. With fewer
than k vectors all are returned; an empty table gives an empty result. Sums beyond 64 bits are formed exactly and returned
as the nearest 64-bit number. Other columns do not matter. Ids are integers below 2^63 - 2.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.llm.common import cut, shared_folder

GROUP_ROWS, GROUP_BYTES = 4096, 16 << 20  # queries that are held at once
BLOCK = 512  # vectors that are packed together, and scored together
BITS = 9  # a pass divides an interval by 2^9
TOP = (1 << 63) - 1
NO_ID = TOP - 1
PACKED = "ids binary, copies binary, dims int, kind string, matrix binary, most array<double>"
FOUND = "q int, query_id bigint, copies bigint, own boolean, vec_id bigint, score bigint"


def _scaled(vectors: pa.Array, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors take part, and these as rows of whole numbers, shorter ones ending in zeros."""
    lists = vectors.cast(pa.list_(pa.float64()))
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten()
    with np.errstate(over="ignore"):
        whole = np.floor(flat.to_numpy(zero_copy_only=False).astype(np.float64) * scale)  # NULL becomes NaN
    owner = np.repeat(np.arange(len(sizes)), sizes)
    fine = lists.is_valid().to_numpy(zero_copy_only=False) & (np.bincount(owner, ~np.isfinite(whole), len(sizes)) == 0)
    place = np.arange(len(whole)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    used = fine[owner]
    out = np.zeros((len(sizes), int(sizes[fine].max()) if fine.any() else 0))
    out[owner[used], place[used]] = whole[used]
    return fine, out[fine]


def _pack(scale: int) -> Callable:
    """Rows (id, copies, vector) in blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fine, rows = _scaled(batch.column(2), scale)
            ids = batch.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False).astype(np.int64)[fine]
            copies = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)[fine]
            out = []
            for at in range(0, len(rows), BLOCK):
                part = rows[at : at + BLOCK]
                most = np.abs(part).max(0) if part.shape[1] else np.zeros(0)
                kind = "int16" if most.max(initial=0) < 1 << 15 else "int32" if most.max() < 1 << 31 else "float64"
                out.append((ids[at : at + BLOCK].tobytes(), copies[at : at + BLOCK].tobytes(), part.shape[1], kind, part.astype(kind).tobytes(), most.tolist()))
            kinds = (pa.binary(), pa.binary(), pa.int32(), pa.string(), pa.binary(), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=["ids", "copies", "dims", "kind", "matrix", "most"])

    return run


def _unpacked(ids: bytes, copies: bytes, dims: int, kind: str, matrix: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids = np.frombuffer(ids, np.int64)
    return ids, np.frombuffer(copies, np.int64), np.frombuffer(matrix, kind).reshape(len(ids), dims).astype(np.float64)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and rows of each packed block."""
    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            ids, _, rows = _unpacked(*row)
            yield ids, rows


@dataclass
class Group:
    """Queries that are asked together, and how far each one's bound is known."""

    ids: np.ndarray
    copies: np.ndarray
    rows: np.ndarray
    own: np.ndarray  # each one's score with itself
    exact: np.ndarray  # scores fit float64 without rounding
    low: np.ndarray  # int64: the least score of the interval that holds the k-th one
    shift: np.ndarray  # its bins are 2^shift scores wide
    bins: np.ndarray
    need: np.ndarray  # the k-th score's rank from the interval's top
    above: np.ndarray  # scores above the interval
    open: np.ndarray

    def scores(self, rows: np.ndarray, which: np.ndarray | None = None) -> np.ndarray:
        """Integer inner products of the queries (all, or those at ``which``) with ``rows``."""
        mine = self.rows if which is None else self.rows[which]
        exact = self.exact if which is None else self.exact[which]
        dims = min(mine.shape[1], rows.shape[1])
        mine, rows = mine[:, :dims], rows[:, :dims]
        if exact.all():
            return (mine @ rows.T).astype(np.int64)
        out = np.zeros((len(mine), len(rows)), np.int64)
        out[exact] = (mine[exact] @ rows.T).astype(np.int64)
        whole = [[int(x) for x in r] for r in rows]
        for i in np.flatnonzero(~exact):
            q = [int(x) for x in mine[i]]
            out[i] = [max(-TOP - 1, min(TOP, sum(a * b for a, b in zip(q, r, strict=True)))) for r in whole]
        return out


def _group(ids: np.ndarray, copies: np.ndarray, rows: np.ndarray, most: np.ndarray, wanted: int) -> Group:
    dims = min(rows.shape[1], len(most))
    bound = np.abs(rows[:, :dims]) @ most[:dims] * (1 + 1e-9) + 1  # no score is further from zero
    exact, small = bound < 1 << 53, bound < 1 << 61
    reach = np.where(small, bound, 0).astype(np.int64)
    shift = np.array([max(0, (2 * int(r) + 1).bit_length() - BITS) for r in reach])
    shift = np.where(small, shift, 64 - BITS)
    low = np.where(small, -reach, -TOP - 1)
    n = len(ids)
    group = Group(ids, copies, rows, np.zeros(n, np.int64), exact, low, shift, np.full(n, 1 << BITS), np.full(n, wanted), np.zeros(n, np.int64), np.ones(n, bool))
    group.own[exact] = np.einsum("ij,ij->i", rows[exact], rows[exact]).astype(np.int64)
    for i in np.flatnonzero(~exact):
        group.own[i] = group.scores(rows[i : i + 1], np.array([i]))[0, 0]
    return group


def _histograms(held: Broadcast) -> Callable:
    """(q, bin, n): counts per open query over all vectors of the task, from the top down to its own k-th score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: Group = held.value
        at = np.flatnonzero(group.open)
        width = 1 << BITS
        counts = np.zeros((len(at), width), np.int64)
        low, shift, bins = group.low[at].astype(np.uint64)[:, None], group.shift[at].astype(np.uint64)[:, None], group.bins[at][:, None]
        line = np.arange(len(at))[:, None] * width
        for _, rows in _blocks(batches):
            scores = group.scores(rows, at)
            place = ((scores.view(np.uint64) - low) >> shift).astype(np.int64)  # modulo 2^64: below the interval is far above it
            inside = (place >= 0) & (place < bins) & (scores >= group.low[at][:, None])
            counts += np.bincount((place + line)[inside], minlength=counts.size).reshape(counts.shape)
        higher = np.cumsum(counts[:, ::-1], axis=1)[:, ::-1] - counts
        q, b = np.nonzero((counts > 0) & (higher < group.need[at][:, None]))
        yield pa.RecordBatch.from_arrays([pa.array(at[q], pa.int32()), pa.array(b, pa.int32()), pa.array(counts[q, b], pa.int64())], names=["q", "bin", "n"])

    return run


def _best(q: np.ndarray, ids: np.ndarray, scores: np.ndarray, wanted: int) -> np.ndarray:
    """Where the ``wanted`` best of each query are."""
    by = np.lexsort((ids, ~scores, q))
    q = q[by]
    first = np.flatnonzero(np.append(True, q[1:] != q[:-1])) if len(q) else np.zeros(0, int)
    rank = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
    return by[rank < wanted]


def _matches(held: Broadcast, wanted: int) -> Callable:
    """The task's best scores at or above each query's bound."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: Group = held.value
        floor, floor_id = group.low.copy(), np.full(len(group.ids), TOP)
        q = ids = scores = np.zeros(0, np.int64)
        for block_ids, rows in _blocks(batches):
            new = group.scores(rows)
            hit = (new > floor[:, None]) | (new == floor[:, None]) & (block_ids < floor_id[:, None])
            at, column = np.nonzero(hit)
            if not len(at):
                continue
            q, ids, scores = np.append(q, at), np.append(ids, block_ids[column]), np.append(scores, new[at, column])
            keep = _best(q, ids, scores, wanted)
            q, ids, scores = q[keep], ids[keep], scores[keep]
            last = np.flatnonzero(q[wanted - 1 :] == q[: max(0, len(q) - wanted + 1)]) + wanted - 1  # the k-th of each query that has k
            floor[q[last]], floor_id[q[last]] = scores[last], ids[last]
        own = (ids == group.ids[q]) & (scores == group.own[q])
        yield pa.RecordBatch.from_arrays(
            [pa.array(q, pa.int32()), pa.array(group.ids[q], pa.int64()), pa.array(group.copies[q], pa.int64()), pa.array(own, pa.bool_()), pa.array(ids, pa.int64(), mask=ids == NO_ID), pa.array(scores, pa.int64())],
            names=["q", "query_id", "copies", "own", "vec_id", "score"],
        )

    return run


def _narrowed(group: Group, packed: DataFrame, wanted: int) -> int:
    """One pass of histograms; each open query's interval becomes the bin of its k-th score. How many are left open."""
    spark = packed.sparkSession
    held = spark.sparkContext.broadcast(group)
    counts = packed.drop("most").mapInArrow(_histograms(held), "q int, bin int, n bigint").groupBy("q", "bin").agg(F.sum("n").alias("n"))
    need = F.element_at(F.lit(group.need.tolist()), F.col("q") + 1) if len(set(group.need.tolist())) > 1 else F.lit(int(group.need[0]))
    down = Window.partitionBy("q").orderBy(F.desc("bin"))
    upto = counts.withColumn("upto", F.sum("n").over(down))
    # One row per query: the first bin from the top by which enough scores are counted, or none where there are too few.
    located = upto.filter((F.col("upto") >= need) & (F.col("upto") - F.col("n") < need)).toArrow()
    held.unpersist()
    q, b, n, total = (located[c].to_numpy() for c in ("q", "bin", "n", "upto"))
    found = np.zeros(len(group.ids), bool)
    found[q] = True
    group.open &= found  # with too few scores all are taken, from the interval's low end
    group.low[q] = (group.low[q].astype(np.uint64) + (b.astype(np.uint64) << group.shift[q].astype(np.uint64))).view(np.int64)
    group.above[q] += total - n
    group.need[q] -= total - n
    step = np.minimum(group.shift[q], BITS)
    enough = (group.above[q] + n <= 4 * wanted) | (group.shift[q] == 0)
    group.open[q] = ~enough
    group.bins[q] = 1 << step
    group.shift[q] -= step
    return int(group.open.sum())


def top_k(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256, own_rows: bool = True) -> DataFrame:
    """The ``k`` best vectors of each row of ``queries``; with ``own_rows`` the queries are rows of ``vectors`` and do not
    find themselves."""
    spark = vectors.sparkSession
    wanted = k + own_rows
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    ids, vector = F.col(id_col).cast("bigint"), F.col(vector_col)
    packed = cut(vectors.select(ids.alias("id"), F.lit(1).cast("bigint").alias("copies"), vector.alias("v")).mapInArrow(_pack(scale), PACKED).repartition(parts), "topk-vectors")
    asked = queries.select(ids.alias("id"), vector.alias("v")).filter("id IS NOT NULL AND v IS NOT NULL").groupBy("id", "v").agg(F.count(F.lit(1)).alias("copies"))
    asked = cut(asked.select("id", "copies", "v").mapInArrow(_pack(scale), PACKED), "topk-queries")
    most = packed.select(F.posexplode("most").alias("at", "most")).groupBy("at").agg(F.max("most").alias("most")).orderBy("at").toArrow()["most"].to_numpy()
    folder, paths = f"{shared_folder(spark).rstrip('/')}/topk-{uuid.uuid4().hex}", []
    empty = spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")

    def answer(blocks: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> None:
        dims = max(b[2].shape[1] for b in blocks)
        rows = np.concatenate([np.pad(b[2], ((0, 0), (0, dims - b[2].shape[1]))) for b in blocks])
        group = _group(np.concatenate([b[0] for b in blocks]), np.concatenate([b[1] for b in blocks]), rows, most, wanted)
        while _narrowed(group, packed, wanted):
            pass
        held = spark.sparkContext.broadcast(group)
        best = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
        ranked = packed.drop("most").mapInArrow(_matches(held, wanted), FOUND).withColumn("place", F.row_number().over(best)).filter(F.col("place") <= wanted)
        mine = F.min(F.when(F.col("own"), F.col("place"))).over(Window.partitionBy("q"))
        out = ranked.withColumn("mine", F.coalesce(mine, F.lit(wanted)) if own_rows else F.lit(wanted + 1)).filter("place <> mine")
        out = out.select("query_id", (F.col("place") - F.when(F.col("place") > F.col("mine"), 1).otherwise(0)).alias("rank"), "vec_id", "score", "copies")
        out = out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), "copies"))).select(*empty.columns)
        paths.append(f"{folder}/{len(paths)}")
        out.write.parquet(paths[-1])
        held.unpersist()

    group, size = [], 0
    for row in asked.toLocalIterator():
        block = _unpacked(row.ids, row.copies, row.dims, row.kind, row.matrix)
        most_rows = max(1, min(GROUP_ROWS, GROUP_BYTES // (8 * max(1, row.dims))))
        for at in range(0, len(block[0]), most_rows):
            part = tuple(x[at : at + most_rows] for x in block)
            if group and size + len(part[0]) > most_rows:
                answer(group)
                group, size = [], 0
            group.append(part)
            size += len(part[0])
    if group:
        answer(group)
    return spark.read.schema(empty.schema).parquet(*paths) if paths else empty
