"""Exchange of repeated passages between runs of documents, in memory-sized groups.

Two passages that repeat each other over a whole window (so many words or bytes) agree on which short gram of the
window has the smallest hash, its anchor. Windows with one anchor form a slice of text, and only slices travel:

1. Documents are packed into runs of some megabytes. Each run sends the sorted hashes of its anchors, dealt by hash
   range and delta-coded, and gets back one bit for each: does another run have it? (Found by hash only, so at worst a
   few slices too many travel on.)
2. Slices with such an anchor are sent, each content once a run, sorted and front-coded, to the group of their anchor.
   The announcement counts the distinct contents of each anchor. An anchor with more of them than ``part_bytes`` hold is
   split, at every size of the table: the windows of its slices fall into ``CLASSES`` by where the anchor stands in them,
   and each class goes to the group of the text that all its windows hold. Beyond ``CLASSES`` times as many, or in
   ``hot_runs`` runs or more, each window goes to a group of its own, which holds at most one entry a run for any content.
3. The group compares contents exactly (the operator's part) and sends back a bit for each window.
4. The runs remove what the bits cover.

A run's size, a group's size and the bits of a document are bounded by parameters and by the longest document, not by
the table. The table of runs and what comes back are written to the shared folder, so a lost executor repeats one stage.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import as_bytes, cut

RUN_BYTES = 4 << 20
PART_BYTES = 8 << 20
HOT_RUNS = 4096
CLASSES = 4
BLOCK = 1 << 16  # symbols hashed at once: what a core's cache holds
NO_ID = np.iinfo(np.int64).max  # a NULL id comes after all others
MASK48 = (1 << 48) - 1


def packed(*arrays: tuple[str, pa.Array]) -> bytes:
    """Columns as one compressed block."""
    batch = pa.RecordBatch.from_arrays([a for _, a in arrays], names=[n for n, _ in arrays])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=7))) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpacked(block: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(block).read_next_batch()


def pack_runs(docs: DataFrame, id_col: str, text_col: str, run_bytes: int) -> DataFrame:
    """(run, bytes, block): the documents in runs of about ``run_bytes``; a longer document is a run of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int | None] = []
        texts: list[bytes | None] = []
        size = 0

        def close() -> pa.RecordBatch:
            block = packed(("id", pa.array(ids, pa.int64())), ("text", pa.array(texts, pa.large_binary())))
            return pa.RecordBatch.from_arrays([pa.array([size], pa.int64()), pa.array([block], pa.binary())], names=["bytes", "block"])

        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True):
                n = len(text or b"")
                if ids and size + n > run_bytes:
                    yield close()
                    ids, texts, size = [], [], 0
                ids.append(i)
                texts.append(text)
                size += n
        if ids:
            yield close()

    taken = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return cut(taken.mapInArrow(run, "bytes bigint, block binary").withColumn("run", F.monotonically_increasing_id()), "runs")


def gram_hashes(symbols: np.ndarray, width: int) -> np.ndarray:
    """A hash of every ``width`` consecutive symbols (uint64), doubling and adding up the widths."""
    odd = np.uint64(0x9E3779B97F4A7C15)

    def join(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        out = left ^ (left >> np.uint64(29))
        out *= odd
        out += right
        return out

    step, done, so_far, power = symbols, 0, None, 1
    while True:
        if width & power:
            so_far = step if so_far is None else join(so_far[: len(symbols) - done - power + 1], step[done : done + len(symbols) - done - power + 1])
            done += power
        if power * 2 > width:
            break
        step = join(step[: len(step) - power], step[power:])
        power *= 2
    out = so_far ^ (so_far >> np.uint64(32))
    out *= np.uint64(0xD6E8FEB86659FD93)
    out ^= out >> np.uint64(29)
    return out


@dataclass
class Slices:
    """Windows in a row with one anchor: first window's place, how many, and the anchor's place and 48-bit hash."""

    start: np.ndarray
    count: np.ndarray
    anchor: np.ndarray
    hash: np.ndarray


def slices_of(symbols: np.ndarray, lengths: Sequence[int], window: int, gram: int) -> Slices:
    """The slices of documents laid end to end; no window crosses two documents."""
    valid = np.ones(len(symbols), bool)
    at = 0
    for n in lengths:
        valid[max(at, at + n - window + 1) : at + n] = False
        at += n
    reach = window - gram + 1
    parts = []
    for low in range(0, len(symbols), BLOCK):
        piece = symbols[low : low + BLOCK + window - 1]
        if len(piece) < window:
            break
        grams = gram_hashes(piece, gram)
        # The leftmost smallest of the top 40 bits, with its place in the bits below.
        least = (grams & np.uint64(MASK48 << 24 & ((1 << 64) - 1))) | np.arange(len(grams), dtype=np.uint64)
        width = 1
        while width * 2 <= reach:
            least = np.minimum(least[: len(least) - width], least[width:])
            width *= 2
        if width < reach:
            least = np.minimum(least[: len(least) - (reach - width)], least[reach - width :])
        starts = np.flatnonzero(valid[low : low + min(BLOCK, len(least))])
        if not len(starts):
            continue
        anchors = (least[starts] & np.uint64((1 << 24) - 1)).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], (np.diff(starts) != 1) | (np.diff(anchors) != 0))))
        # Anchors have small hashes: mixed again, they spread over all ranges.
        again = grams[anchors[first]] * np.uint64(0xA24BAED4963EE407)
        again ^= again >> np.uint64(32)
        again *= np.uint64(0x9FB21C651E98DF25)
        parts.append((starts[first] + low, np.diff(np.concatenate((first, [len(starts)]))), anchors[first] + low, (again >> np.uint64(16)).astype(np.int64)))
    if not parts:
        return Slices(*(np.zeros(0, np.int64) for _ in range(4)))
    start, count, anchor, code = (np.concatenate(c) for c in zip(*parts, strict=True))
    # A slice that goes on in the next block is one slice.
    head = np.flatnonzero(np.concatenate(([True], (start[1:] != start[:-1] + count[:-1]) | (anchor[1:] != anchor[:-1]))))
    return Slices(start[head], np.add.reduceat(count, head), anchor[head], code[head])


class Kind:
    """What an operator brings: its symbols, its entries' order and code, and the comparison of a group."""

    window: int
    gram: int
    symbol_bytes: int  # about what a symbol of an entry takes

    @property
    def entry_bytes(self) -> int:
        """What the longest slice takes as an entry."""
        return (2 * self.window - self.gram) * self.symbol_bytes

    def lay_out(self, texts: list[bytes]) -> tuple[np.ndarray, list[int]]:
        """Symbols of the texts end to end as uint64, and their numbers; keeps what ``content`` needs."""
        raise NotImplementedError

    def content(self, start: int, end: int, anchor: int) -> tuple:
        """Sortable content of symbols start to end, equal for equal text."""
        raise NotImplementedError

    def encode(self, contents: list[tuple], weights: list[int]) -> bytes:
        raise NotImplementedError

    def settle(self, blocks: list[bytes]) -> list[np.ndarray]:
        """For each run's block, for each entry a bit mask of the windows to remove."""
        raise NotImplementedError

    def weigh(self, ids: np.ndarray, entry: np.ndarray, n: int) -> np.ndarray:
        """An entry's weight, from the ids of the documents that hold it."""
        raise NotImplementedError

    def always(self, ids: np.ndarray, entry: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Slices all of whose windows go, whatever other runs hold."""
        raise NotImplementedError

    def kept(self, doc: int, cover: np.ndarray) -> bytes:
        """What is left of a document whose symbols are covered so."""
        raise NotImplementedError


def _opened(block: bytes) -> tuple[list[int | None], list[bytes | None]]:
    batch = unpacked(block)
    return batch.column(0).to_pylist(), batch.column(1).to_pylist()


def _by_part(hashes: np.ndarray, parts: int) -> np.ndarray:
    """Ranges of the 48-bit hashes; monotonic."""
    return (hashes >> 16) * parts >> 32


def _mixed(symbols: np.ndarray, start: np.ndarray, width: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """A hash of ``width`` symbols from each ``start`` on (uint64)."""
    h = seed.astype(np.uint64)
    for j in range(int(width.max(initial=0))):
        inside = j < width
        h[inside] = (h[inside] ^ (h[inside] >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + symbols[start[inside] + j]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def _contents(found: Slices, symbols: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct anchor hashes, sorted, and how many distinct contents each has."""
    hashes, which, times = np.unique(found.hash, return_inverse=True, return_counts=True)
    several = np.flatnonzero(times[which] > 1)
    if len(several):
        # A slice is no longer than two windows: its first and its last one hold all of it.
        first, count, width = found.start[several], found.count[several], np.full(len(several), window)
        content = _mixed(symbols, first + count - 1, width, _mixed(symbols, first, width, count))
        order = np.lexsort((content, which[several]))
        owner, content = which[several][order], content[order]
        new = np.concatenate(([True], (owner[1:] != owner[:-1]) | (content[1:] != content[:-1])))
        distinct = np.bincount(owner[new], minlength=len(hashes))
        times = np.where(times > 1, distinct, times)
    return hashes, times


def _announce(kind: Kind, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                _, texts = _opened(block)
                symbols, lengths = kind.lay_out([t or b"" for t in texts])
                hashes, times = _contents(slices_of(symbols, lengths, kind.window, kind.gram), symbols, kind.window)
                if not len(hashes):
                    continue
                part = _by_part(hashes, parts)
                bounds = np.concatenate(([0], np.flatnonzero(np.diff(part)) + 1, [len(part)]))
                rows = [(int(part[a]), packed(("d", pa.array(np.diff(hashes[a:b], prepend=0))), ("n", pa.array(times[a:b], pa.int32())))) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([p for p, _ in rows], pa.int64()), pa.array([number] * len(rows), pa.int64()), pa.array([b for _, b in rows], pa.binary())],
                    names=["part", "run", "block"],
                )

    return run


def _answer(hot_runs: int, most: int):
    """For the hashes of each run, whether another run has them, and whether they are split into classes or windows."""

    def run(table: pa.Table) -> pa.Table:
        runs = table["run"].to_pylist()
        blocks = [unpacked(b) for b in table["block"].to_pylist()]
        lists = [np.cumsum(b.column(0).to_numpy()) for b in blocks]
        values, which, counts = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
        entries = np.bincount(which, np.concatenate([b.column(1).to_numpy() for b in blocks]))
        windows = (counts >= hot_runs) | (entries > CLASSES * most)
        bits = np.stack([counts > 1, (entries > most) | windows, windows]) & (counts > 1)
        out, at = [], 0
        for hashes in lists:
            out.append(np.packbits(bits[:, which[at : at + len(hashes)]]).tobytes())
            at += len(hashes)
        return pa.table({"run": pa.array(runs, pa.int64()), "part": table["part"], "bits": pa.array(out, pa.binary())})

    return run


def _split(kind: Kind, symbols: np.ndarray, found: Slices, classes: np.ndarray) -> Slices:
    """The slices cut where their windows' class changes, with the hash of the text that all windows of a class hold.

    A window that holds its anchor ``o`` symbols after its start is of class o * classes / reach, so equal windows of an
    anchor meet; as many classes as windows make each window its own.
    """
    reach = kind.window - kind.gram + 1
    owner = np.repeat(np.arange(len(found.start)), found.count)
    start = found.start[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(found.count) - found.count, found.count)
    number = (found.anchor[owner] - start) * classes[owner] // reach
    head = np.flatnonzero(np.concatenate(([True], (owner[1:] != owner[:-1]) | (number[1:] != number[:-1]))))
    count = np.diff(np.concatenate((head, [len(owner)])))
    owner, number = owner[head], number[head]
    least, most = -(-number * reach // classes[owner]), -(-(number + 1) * reach // classes[owner]) - 1
    code = _mixed(symbols, found.anchor[owner] - least, kind.window - most + least, number * 64 + classes[owner])
    return Slices(start[head], count, found.anchor[owner], (code >> np.uint64(16)).astype(np.int64))


def _chosen(kind: Kind, parts: int, symbols: np.ndarray, lengths: list[int], answers: dict[int, bytes]) -> tuple[np.ndarray, ...]:
    """Slices that may repeat, those of hot anchors split: start, count, anchor, and 48-bit hash to deal by."""
    found = slices_of(symbols, lengths, kind.window, kind.gram)
    hashes, which, times = np.unique(found.hash, return_inverse=True, return_counts=True)
    part = _by_part(hashes, parts)
    remote, hot, single = (np.zeros(len(hashes), bool) for _ in range(3))
    for p, bits in answers.items():
        low, high = np.searchsorted(part, [p, p + 1])
        remote[low:high], hot[low:high], single[low:high] = np.unpackbits(np.frombuffer(bits, np.uint8))[: 3 * (high - low)].reshape(3, -1).astype(bool)
    take = np.flatnonzero((remote | (times > 1))[which])
    split = hot[which[take]]
    whole, cut_up = (Slices(*(c[at] for c in (found.start, found.count, found.anchor, found.hash))) for at in (take[~split], take[split]))
    if len(cut_up.start):
        cut_up = _split(kind, symbols, cut_up, np.where(single[which[take[split]]], kind.window - kind.gram + 1, min(CLASSES, kind.window - kind.gram + 1)))
    columns = [np.concatenate(c) for c in zip(*((x.start, x.count, x.anchor, x.hash) for x in (whole, cut_up)), strict=True)]
    order = np.argsort(columns[0], kind="stable")
    return tuple(c[order] for c in columns)


def _send(kind: Kind, parts: int):
    """Entries to their groups as (group, run, block), and each run's slices to itself, under a group of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, block, answers in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                ids, texts = _opened(block)
                symbols, lengths = kind.lay_out([t or b"" for t in texts])
                start, count, anchor, h = _chosen(kind, parts, symbols, lengths, {a["part"]: a["bits"] for a in answers or []})
                if not len(start):
                    continue
                contents = [kind.content(s, s + n + kind.window - 1, a) for s, n, a in zip(start.tolist(), count.tolist(), anchor.tolist(), strict=True)]
                # Equal contents have one anchor and so one group. Entries go by group, then in the order of their contents.
                numbers: dict[tuple, int] = {}
                number_of = np.array([numbers.setdefault(c, len(numbers)) for c in contents], np.int64)
                known = list(numbers)
                part = np.empty(len(known), np.int64)
                part[number_of] = _by_part(h, parts)
                by_content = np.array(sorted(range(len(known)), key=known.__getitem__), np.int64)
                order = by_content[np.argsort(part[by_content], kind="stable")]
                place = np.empty(len(order), np.int64)
                place[order] = np.arange(len(order))
                entry = place[number_of]
                owners = np.array([NO_ID if i is None else i for i in ids], np.int64)[_doc_of(start, lengths)]
                weights = kind.weigh(owners, entry, len(order))
                dealt = part[order]
                bounds = np.concatenate(([0], np.flatnonzero(np.diff(dealt)) + 1, [len(dealt)])).tolist()
                rows = [
                    (int(dealt[a]), kind.encode([known[i] for i in order[a:b].tolist()], weights[a:b].tolist()))
                    for a, b in zip(bounds[:-1], bounds[1:], strict=True)
                ]
                places = packed(("s", pa.array(np.diff(start, prepend=0), pa.int32())), ("n", pa.array(count, pa.uint8())), ("e", pa.array(entry, pa.int32())))
                rows.append((parts + number, places))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([p for p, _ in rows], pa.int64()), pa.array([number] * len(rows), pa.int64()), pa.array([b for _, b in rows], pa.binary())],
                    names=["part", "run", "block"],
                )

    return run


def _doc_of(places: np.ndarray, lengths: list[int]) -> np.ndarray:
    """The document each place is in."""
    return np.searchsorted(np.cumsum(lengths), places, side="right")


def _compare(kind: Kind, parts: int):
    def run(table: pa.Table) -> pa.Table:
        if table["part"][0].as_py() >= parts:
            return table.select(["run", "part", "block"])
        masks = kind.settle(table["block"].to_pylist())
        blocks = [packed(("m", pa.array(m, pa.uint64()))) for m in masks]
        return pa.table({"run": table["run"], "part": table["part"], "block": pa.array(blocks, pa.binary())})

    return run


def _apply(kind: Kind, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, back in zip(*(batch.column(i).to_pylist() for i in range(2)), strict=True):
                ids, texts = _opened(block)
                symbols, lengths = kind.lay_out([t or b"" for t in texts])
                edges = np.zeros(len(symbols) + 1, np.int32)
                if back:
                    back = sorted(((b["part"], b["block"]) for b in back), key=lambda b: b[0])
                    places = unpacked(back[-1][1])
                    start, count, entry = (c.to_numpy().astype(np.int64) for c in places.columns)
                    start = np.cumsum(start)
                    masks = np.concatenate([unpacked(b).column(0).to_numpy() for _, b in back[:-1]])[entry]
                    owners = np.array([NO_ID if i is None else i for i in ids], np.int64)[_doc_of(start, lengths)]
                    weights = kind.weigh(owners, entry, int(entry.max()) + 1)[entry]
                    masks = np.where(kind.always(owners, entry, weights), ~np.uint64(0), masks)
                    for j in range(kind.window - kind.gram + 1):
                        gone = start[((masks >> np.uint64(j)) & np.uint64(1)).astype(bool) & (count > j)] + j
                        np.add.at(edges, gone, 1)
                        np.add.at(edges, gone + kind.window, -1)
                covered = np.cumsum(edges[:-1]) > 0
                rows, at = [], 0
                for doc, (i, n) in enumerate(zip(ids, lengths, strict=True)):
                    cover = covered[at : at + n]
                    turns = np.flatnonzero(np.diff(np.concatenate(([False], cover, [False])).astype(np.int8)))
                    spans = [{"start": a, "end": b} for a, b in zip(turns[::2].tolist(), turns[1::2].tolist(), strict=True)]
                    rows.append((i, n, int(cover.sum()), spans, kind.kept(doc, cover)))
                    at += n
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), RESULT_TYPES, strict=True)], names=["id", "n", "n_removed", "spans", "kept"]
                )

    return run


RESULT = "id bigint, n bigint, n_removed bigint, spans array<struct<start:bigint,end:bigint>>, kept binary"
RESULT_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary()]


def remove_repeats(
    docs: DataFrame, kind: Kind, id_col: str = "doc_id", text_col: str = "text",
    run_bytes: int = RUN_BYTES, part_bytes: int = PART_BYTES, hot_runs: int = HOT_RUNS,
) -> DataFrame:
    """Per document ``id``, symbols ``n`` and ``n_removed``, removed ``spans`` and the ``kept`` bytes."""
    runs = pack_runs(docs, id_col, text_col, run_bytes)
    parts = max(1, math.ceil((runs.agg(F.sum("bytes")).first()[0] or 0) / part_bytes))
    announced = runs.select("run", "block").mapInArrow(_announce(kind, parts), "part bigint, run bigint, block binary")
    answers = announced.groupBy("part").applyInArrow(_answer(hot_runs, part_bytes // kind.entry_bytes), "run bigint, part bigint, bits binary")
    by_run = answers.groupBy("run").agg(F.collect_list(F.struct("part", "bits")).alias("answers"))
    asked = runs.join(by_run, "run", "left").select("run", "block", "answers")
    sent = asked.mapInArrow(_send(kind, parts), "part bigint, run bigint, block binary")
    back = cut(sent.groupBy("part").applyInArrow(_compare(kind, parts), "run bigint, part bigint, block binary"), "repeats")
    back = back.groupBy("run").agg(F.collect_list(F.struct("part", "block")).alias("back"))
    return runs.join(back, "run", "left").select("block", "back").mapInArrow(_apply(kind, parts), RESULT)
