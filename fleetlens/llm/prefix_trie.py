"""Conversation prefix trie: which conversations begin alike, how far, and what sharing their beginnings saves.

A node is a distinct sequence of first turns (role and text); its members are the conversations that begin with it.

* Each turn becomes a turn id, 128 bits of SHA-256 over role and text with the text's length behind. Turns are numbered by
  a sort over ranges of (conversation, turn), so that a conversation of any length is dealt to many tasks.
* Eight turns at a time stand side by side in positional columns, and ``GROUP BY prior node, ROLLUP(t1, ..., t8)`` counts
  all prefixes together; ``grouping_id`` tells their depth. What is longer goes on in further blocks of 16, 32 and then 63
  columns, keyed by the node the block before ended with. Only conversations that still share that node with another one
  go on: beyond, a prefix of one member is a chain, and its turns are nodes as they are. So the number of blocks follows
  the longest *shared* beginning, however long conversations are.
* Sums over subtrees take a second ROLLUP, over the shared nodes, from the deepest block up: a block's sums at depth 0 are
  carried to the node it is keyed by. A member-less chain below a shared node counts as one leaf of it.
* The ids of the conversations that end at a node are sorted over ranges, joined in pieces of bounded length, and hashed
  as a stream of these; no task holds them all.

Turns are ordered by ``turn``, NULL first; turns of equal number by their turn id. NULL role and text count as empty. Rows
without a conversation id take no part. Repeated rows are turns of their own. An empty table has no node. Only the four
columns named are read, so others may have any names. Nodes and sums are whole for any number of copies: groups are
counted by partial aggregates, joins are inner or left ones that adaptive execution splits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import cut

WIDTHS = (8, 16, 32, 63)  # columns of successive blocks; grouping sets take 64, with the prior node
NODE, LENGTH = 16, 4  # bytes of a node id, and of a text's length behind a turn id
TURN = NODE + LENGTH
ROOT = bytes(NODE)
PIECE = 1 << 16  # characters of joined ids that are held at once
NO_ENDS = hashlib.sha256(b"").hexdigest()


def _digest(of: Column) -> Column:
    return F.substring(F.unhex(F.sha2(of, 256)), 1, NODE)


def turn_id(role: Column, text: Column) -> Column:
    """128 bits of SHA-256 over role and text, then the bytes of the text as four bytes."""
    said, body = F.coalesce(role.cast("string"), F.lit("")), F.coalesce(text.cast("string"), F.lit(""))
    return F.concat(_digest(F.concat(F.octet_length(said).cast("string"), F.lit(":"), said, body)), F.unhex(F.lpad(F.hex(F.octet_length(body)), 2 * LENGTH, "0")))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by conversation, with their place among the conversation's rows of this task, from 1."""
    part, last, seen = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        places = []
        for conv in batch.column(0).to_pylist():
            seen = seen + 1 if conv == last else 1
            last = conv
            places.append(seen)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([part] * len(places), pa.int32()), pa.array(places, pa.int64())], names=["conv_id", "key", "part", "place"])


def numbered_turns(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(conv_id, pos from 1, key) of every turn, and (conv_id, n_turns) of every conversation; both written."""
    slim = conversations.select(F.col(conv_col).cast("bigint").alias("conv_id"), F.col(turn_col).alias("turn"), turn_id(F.col(role_col), F.col(text_col)).alias("key"))
    slim = cut(slim.filter("conv_id IS NOT NULL"), "trie-turns")
    # The last column tells equal rows apart, so that they too are dealt to several ranges.
    order = ["conv_id", "turn", "key", "tie"]
    ranged = slim.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    counted = cut(ranged.select("conv_id", "key").mapInArrow(_counted, "conv_id bigint, key binary, part int, place bigint"), "trie-counted")
    held = counted.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n"))
    offsets = cut(held.selectExpr("conv_id", "part", "n", "sum(n) OVER (PARTITION BY conv_id ORDER BY part) - n AS before"), "trie-offsets")
    moved = counted.join(offsets.filter("before > 0").select("conv_id", "part", "before"), ["conv_id", "part"], "left")
    turns = cut(moved.select("conv_id", (F.col("place") + F.coalesce("before", F.lit(0))).alias("pos"), "key"), "trie-numbered")
    return turns, cut(offsets.groupBy("conv_id").agg(F.sum("n").alias("n_turns")), "trie-lengths")


def _columns(width: int) -> list[str]:
    return [f"t{i}" for i in range(1, width + 1)]


def _side_by_side(turns: DataFrame, alive: DataFrame, depth: int, width: int) -> DataFrame:
    """Conversations ``alive`` with their turns ``depth`` + 1 to ``depth`` + ``width`` in columns."""
    here = turns.filter(F.col("pos").between(depth + 1, depth + width)).selectExpr("conv_id", "pos", "key", "CAST(NULL AS BIGINT) AS n_turns", "CAST(NULL AS BINARY) AS prior")
    rows = here.unionAll(alive.selectExpr("conv_id", "CAST(0 AS BIGINT) AS pos", "CAST(NULL AS BINARY) AS key", "n_turns", "prior"))
    wide = [F.max(F.when(F.col("pos") == depth + i, F.col("key"))).alias(t) for i, t in enumerate(_columns(width), 1)]
    return rows.groupBy("conv_id").agg(F.max("n_turns").alias("n_turns"), F.max("prior").alias("prior"), *wide).filter("n_turns IS NOT NULL")


def _rolled(rows: DataFrame, width: int, sums: dict[str, str]) -> DataFrame:
    """``sums`` for every prefix of the turn columns under each prior node: d (turns of the prefix) and its path."""
    names = ", ".join(_columns(width))
    aggregates = ", ".join(f"{what} AS {name}" for name, what in sums.items())
    out = rows.sparkSession.sql(f"SELECT prior, {names}, {width} - bit_count(grouping_id()) AS d, {aggregates} FROM {{rows}} GROUP BY prior, ROLLUP({names})", rows=rows)
    # A prefix longer than what it is of repeats the whole one with an empty column; those are no nodes.
    real = (F.col("d") == 0) | F.get(F.array(*_columns(width)), F.col("d") - 1).isNotNull()
    return out.filter(real).select("prior", "d", _path(width).alias("path"), *sums)


def _path(width: int) -> Column:
    """The prior node and the turn ids after it."""
    return F.concat("prior", *(F.coalesce(F.col(t), F.lit(b"")) for t in _columns(width)))


def _node(path: Column) -> Column:
    return F.when(F.length(path) == NODE, path).otherwise(_digest(path))


def _hash_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (node, conv_id) in order, as (node, first id, ids joined by commas) of bounded length."""
    node, first, ids, size = None, None, [], 0
    out: list[tuple] = []

    def flush() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.binary()), pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out], pa.string())], names=["node", "first", "ids"])
        out.clear()
        return made

    held = 0
    for batch in batches:
        for at, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if at != node or size >= PIECE:
                if ids:
                    out.append((node, first, ",".join(ids)))
                    held += size
                node, first, ids, size = at, conv, [], 0
                if held >= 16 * PIECE:
                    yield flush()
                    held = 0
            ids.append(str(conv))
            size += len(ids[-1]) + 1
    if ids:
        out.append((node, first, ",".join(ids)))
    if out:
        yield flush()


def _hash_streams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces (node, first, ids) in order, as (node, SHA-256 of all its ids)."""
    node, state = None, None
    for batch in batches:
        nodes, sums = [], []
        for at, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if at == node:
                state.update(b"," + ids.encode())
                continue
            if state is not None:
                nodes.append(node)
                sums.append(state.hexdigest())
            node, state = at, hashlib.sha256(ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(sums, pa.string())], names=["node", "ends"])
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([state.hexdigest()], pa.string())], names=["node", "ends"])


def _ends(members: DataFrame) -> DataFrame:
    """(node, SHA-256 of its decimal ids in numeric order, comma-joined) of rows (node, conv_id)."""
    members = cut(members, "trie-ends")
    pieces = members.repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id").mapInArrow(_hash_pieces, "node binary, first bigint, ids string")
    return pieces.repartition("node").sortWithinPartitions("node", "first").mapInArrow(_hash_streams, "node binary, ends string")


def trie(turns: DataFrame, convs: DataFrame, widths: tuple[int, ...] = WIDTHS) -> DataFrame:
    """One row per node from (conv_id, pos, key) and (conv_id, n_turns): ``conv_id`` (smallest member), ``depth``,
    ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens`` and ``ends_sha256``."""
    alone = F.sha2(F.col("conv_id").cast("string"), 256)
    alive = convs.select("conv_id", "n_turns", F.lit(ROOT).alias("prior"))
    depth, blocks, chains, ended = 0, [], [], []
    while True:
        width = widths[min(len(blocks), len(widths) - 1)]
        whole = cut(_side_by_side(turns, alive, depth, width), "trie-block")
        rolled = _rolled(whole, width, {"n": "count(1)", "conv_id": "min(conv_id)", "longest": "max(n_turns)"})
        parent = F.when(F.col("d") > 0, _node(F.expr(f"substring(path, 1, length(path) - {TURN})")))
        said = F.when(F.col("d") > 0, F.conv(F.hex(F.expr(f"substring(path, length(path) - {LENGTH - 1}, {LENGTH})")), 16, 10).cast("bigint")).otherwise(0)
        nodes = rolled.filter("d > 0" if depth else "d >= 0").select(
            _node(F.col("path")).alias("node"), parent.alias("parent"), F.col("d").cast("int").alias("d"), (F.col("d") + depth).cast("bigint").alias("depth"), "conv_id", "n", "longest",
            ((F.col("n") - 1) * said).alias("saved"), F.when(F.col("n") > 1, F.col("path")).alias("path"),
        )
        nodes = cut(nodes, "trie-nodes")
        last = F.col("n_turns") <= depth + width
        ended.append(whole.filter(last).select(_node(_path(width)).alias("node"), "conv_id"))
        blocks.append((width, nodes))
        deep = nodes.filter((F.col("d") == width) & (F.col("longest") > F.col("depth")))
        chains.append(deep.filter("n = 1").select("conv_id", "depth", F.col("longest").alias("n_turns")))
        longer = whole.filter(~last).select("conv_id", "n_turns", _node(_path(width)).alias("node"))
        alive = cut(longer.join(deep.filter("n > 1").select("node"), "node").select("conv_id", "n_turns", F.col("node").alias("prior")), "trie-alive")
        depth += width
        if alive.isEmpty():
            break

    every = blocks[0][1].withColumn("block", F.lit(0))
    for k, (_, nodes) in enumerate(blocks[1:], 1):
        every = every.unionAll(nodes.withColumn("block", F.lit(k)))
    shared = every.filter("n > 1")
    above = shared.select(F.col("node").alias("parent"), F.col("conv_id").alias("above"))
    # What hangs under no shared node is part of a chain: its parent has the same only member.
    every = cut(every.join(above, "parent", "left"), "trie-linked")
    shared = every.filter("n > 1")
    below = every.filter("above IS NOT NULL").groupBy("parent").agg(F.count(F.lit(1)).alias("n_children"), F.count_if(F.col("n") == 1).alias("heads"))
    own = shared.join(below.withColumnRenamed("parent", "node"), "node", "left").withColumns({
        "n_children": F.coalesce("n_children", F.lit(0)),
        "leaves": F.coalesce("heads", F.lit(0)) + F.when(F.col("longest") == F.col("depth"), 1).otherwise(0),
    })
    own = cut(own.select("block", "node", "d", "path", "depth", "conv_id", "above", "n", "n_children", "leaves", "saved"), "trie-shared")

    subtrees, carried = None, None
    for k in range(len(blocks) - 1, -1, -1):
        width = blocks[k][0]
        mine = own.filter(F.col("block") == k).select("node", "path", "leaves", "saved")
        if carried is not None:
            mine = mine.join(carried, "node", "left").select("node", "path", (F.col("leaves") + F.coalesce("more", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("spared", F.lit(0))).alias("saved"))
        turn_at = [F.when(F.length("path") >= NODE + TURN * i, F.expr(f"substring(path, {NODE + TURN * (i - 1) + 1}, {TURN})")).alias(t) for i, t in enumerate(_columns(width), 1)]
        spread = mine.select(F.expr(f"substring(path, 1, {NODE})").alias("prior"), *turn_at, "leaves", "saved")
        sums = cut(_rolled(spread, width, {"n_leaves": "sum(leaves)", "saved_tokens": "sum(saved)"}).select(_node(F.col("path")).alias("node"), "d", "n_leaves", "saved_tokens"), "trie-sums")
        carried = sums.filter("d = 0").select("node", F.col("n_leaves").alias("more"), F.col("saved_tokens").alias("spared"))
        mine = (sums.filter("d > 0") if k else sums).drop("d")
        subtrees = mine if subtrees is None else subtrees.unionAll(mine)

    ends = ended[0]
    for more in ended[1:]:
        ends = ends.unionAll(more)
    ends = _ends(ends.join(own.select("node"), "node"))
    many = own.join(subtrees, "node").join(ends, "node", "left").select(
        "conv_id", "depth", F.col("above").alias("parent_conv_id"), F.col("n").alias("n_convs"), "n_children", "n_leaves", "saved_tokens", F.coalesce("ends", F.lit(NO_ENDS)).alias("ends_sha256")
    )

    def single(rows: DataFrame, parent: Column) -> DataFrame:
        """Nodes of one member, which has ``longest`` turns."""
        stops, one = F.col("longest") == F.col("depth"), F.lit(1).cast("bigint")
        return rows.select(
            "conv_id", "depth", parent.alias("parent_conv_id"), one.alias("n_convs"), F.when(stops, 0).otherwise(1).cast("bigint").alias("n_children"),
            one.alias("n_leaves"), F.lit(0).cast("bigint").alias("saved_tokens"), F.when(stops, alone).otherwise(F.lit(NO_ENDS)).alias("ends_sha256"),
        )

    few = single(every.filter("n = 1"), F.when(F.col("depth") > 0, F.coalesce("above", "conv_id")))
    tails = chains[0]
    for more in chains[1:]:
        tails = tails.unionAll(more)
    deeper = turns.filter(F.col("pos") > widths[0]).join(tails.withColumnRenamed("depth", "from"), "conv_id").filter("pos > from")
    chain = single(deeper.select("conv_id", F.col("pos").alias("depth"), F.col("n_turns").alias("longest")), F.col("conv_id"))
    return many.unionAll(few).unionAll(chain)


def prefix_trie(conversations: DataFrame, widths: tuple[int, ...] = WIDTHS, **columns: str) -> DataFrame:
    """The nodes of the trie of ``conversations``, as ``trie`` returns them."""
    turns, convs = numbered_turns(conversations, **columns)
    return trie(turns, convs, widths)
