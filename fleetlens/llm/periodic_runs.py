"""Periodic run detection: every maximal stretch of words that repeats with some period, by internal pattern matching.

A run is a stretch with smallest period q (words q apart are identical) of at least ``max(min_length, 2 * q)`` words that
no neighbouring word extends keeping period q. How they are found, in groups of whole documents inside a task:

* Words are numbered per document and a suffix array is built by prefix doubling. Suffixes whose first four words occur
  once in their document leave it early, so that plain prose costs little more than its words.
* Doubling passes every dyadic length m = 4, 8, 16, ...: then the suffixes that begin with the block at p, a multiple of
  m, are one range of the array. A run of period 2m - 1 to 4m - 2 holds such a block together with its copy one period
  on. (Periods up to 6 take blocks of four words at every second word: as a run has 12 words, one fits.)
* A wavelet matrix over the suffix array answers, for the block's range, how many of its occurrences start in a
  neighbouring window, the first one (range successor) and the next. A window is as wide as the block, so all occurrences
  form one arithmetic progression, and each member minus p is a candidate period.
* Candidates of one period at successive blocks are one run; only the first and the last block are extended, by less than
  a block. Where a block and its occurrence lie in a run of a shorter period already found, the longer one is not
  smallest (Fine and Wilf), and the window starts behind it. Of equal stretches the smallest period stays.

Results: one row per row of ``docs``. NULL and empty texts have no words, no runs and an empty ``kept_text``. Repeated rows
and ids are judged each for itself. An empty table gives an empty one. Other columns do not matter, whatever their names.
Very long texts are read in pieces and never cut; a worker holds one document or
about ``GROUP_WORDS`` words at a time, at 150 bytes a word at most (2,000,000 equal words, measured).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from fleetlens.llm.common import as_bytes

MIN_LENGTH = 12
GROUP_WORDS = 1 << 18  # documents are treated together until they hold so many words
BLOCKS = 1 << 16  # blocks whose occurrences are held at once
PIECE = 1 << 20  # bytes of a text that are split into words at once
FIRST_BLOCK = 4
FOUND = "n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, kept_text string"
_GAP = re.compile(rb"[ \t-\r]")


def word_lists(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, in pieces."""
    at = 0
    while at < len(text):
        gap = _GAP.search(text, at + PIECE) if at + PIECE < len(text) else None
        end = gap.start() if gap else len(text)
        yield text[at:end].split()
        at = end


def numbered(text: bytes) -> tuple[np.ndarray, int]:
    """Each word's number, equal for equal words, and how many there are."""
    numbers: dict[bytes, int] = {}
    parts = []
    for words in word_lists(text):
        numbers.update(zip([w for w in dict.fromkeys(words) if w not in numbers], range(len(numbers), len(numbers) + len(words))))
        parts.append(np.fromiter(map(numbers.__getitem__, words), np.int32, len(words)))
    return np.concatenate(parts) if parts else np.zeros(0, np.int32), len(numbers)


class WaveletMatrix:
    """Counts and order statistics over ranges of a sequence of ``values`` below ``len(values)``; queries are arrays."""

    def __init__(self, values: np.ndarray):
        self.bits = max(1, int(len(values) - 1).bit_length())
        self.words, self.ones, self.zeros = [], [], []  # per level: 64 bits a word, ones before each word, number of zeros
        for b in range(self.bits - 1, -1, -1):
            bit = (values >> b & 1).astype(bool)
            packed = np.zeros((len(values) // 64 + 1) * 8, np.uint8)
            short = np.packbits(bit, bitorder="little")
            packed[: len(short)] = short
            self.words.append(packed.view(np.uint64))
            ones = np.zeros(len(self.words[-1]), np.int64)
            np.cumsum(np.bitwise_count(self.words[-1][:-1]), out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(int(len(values) - bit.sum()))
            values = np.concatenate((values[~bit], values[bit]))

    def _ones_before(self, level: int, at: np.ndarray) -> np.ndarray:
        word, inside = at >> 6, (at & 63).astype(np.uint64)
        mask = (np.uint64(1) << inside) - np.uint64(1)
        return self.ones[level][word] + np.bitwise_count(self.words[level][word] & mask)

    def count_below(self, left: np.ndarray, right: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """How many values of each range [left, right) are below ``bound``."""
        total = np.zeros(len(left), np.int64)
        l, r = left, right
        for level, zeros in enumerate(self.zeros):
            up = (bound >> (self.bits - 1 - level) & 1).astype(bool)
            l1, r1 = self._ones_before(level, l), self._ones_before(level, r)
            total += np.where(up, (r - l) - (r1 - l1), 0)
            l, r = np.where(up, zeros + l1, l - l1), np.where(up, zeros + r1, r - r1)
        return np.where(bound >> self.bits > 0, right - left, total)

    def smallest(self, left: np.ndarray, right: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The value of rank ``k`` (from 0) in each range."""
        value = np.zeros(len(left), np.int64)
        l, r = left, right
        for level, zeros in enumerate(self.zeros):
            l1, r1 = self._ones_before(level, l), self._ones_before(level, r)
            low = (r - l) - (r1 - l1)
            up = k >= low
            value = value * 2 + up
            k = np.where(up, k - low, k)
            l, r = np.where(up, zeros + l1, l - l1), np.where(up, zeros + r1, r - r1)
        return value


class RepeatedSuffixes:
    """Suffix array of the suffixes whose first four words recur in their document, and the range of every dyadic block."""

    def __init__(self, words: np.ndarray, starts: np.ndarray, ends: np.ndarray, deepest: int):
        """``words`` differ between documents; ``starts`` and ``ends`` are those of each word's document."""
        n = len(words)
        counts = np.bincount(words)
        whole = starts.dtype
        rank = (np.cumsum(counts) - counts).astype(whole)[words]  # where its group begins in the suffix array
        active = np.flatnonzero(counts[words] > 1).astype(whole)
        order, held = np.zeros(n, whole), np.zeros(n, bool)
        self.blocks: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}  # place, begin of the range, its size
        width = 1
        while len(active) and width < max(FIRST_BLOCK, deepest):
            behind = active + width
            inside = behind < ends[active]
            key = rank[active].astype(np.int64) * (n + 1)
            key[inside] += rank[behind[inside]].astype(np.int64) + 1
            del behind, inside
            by = np.argsort(key, kind="stable")
            key, active = key[by], active[by]
            del by
            group, at = rank[active], np.arange(len(active), dtype=whole)
            first = np.ones(len(active), bool)
            first[1:] = group[1:] != group[:-1]
            slot = group + at - np.maximum.accumulate(np.where(first, at, 0))
            order[slot] = active
            first[1:] = key[1:] != key[:-1]
            del key, group, at
            rank[active] = np.maximum.accumulate(np.where(first, slot, 0))
            size = np.diff(np.append(np.flatnonzero(first), len(active))).astype(whole)
            size = np.repeat(size, size)
            many = size > 1
            width *= 2
            if width == FIRST_BLOCK:
                held[slot[many]] = True
            active, size = active[many], size[many]
            if width >= FIRST_BLOCK:
                here = (active - starts[active]) % (2 if width == FIRST_BLOCK else width) == 0
                self.blocks[width] = active[here], rank[active[here]], size[here]
        # Suffixes left at the first block's length keep their slots as a whole; no other one is in any block's range.
        self.slots = np.cumsum(np.append(False, held), dtype=whole)
        self.places = np.sort(order[held])
        self.matrix = WaveletMatrix(np.searchsorted(self.places, order[held]))

    def progressions(self, left: np.ndarray, size: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Occurrences of each block that start in [low, high]: how many, the first one, and the step to the next."""
        l = self.slots[left].astype(np.int64)
        r = l + size
        skipped = self.matrix.count_below(l, r, np.searchsorted(self.places, low))
        many = self.matrix.count_below(l, r, np.searchsorted(self.places, high, side="right")) - skipped
        first, step = np.zeros(len(l), np.int64), np.zeros(len(l), np.int64)
        some = np.flatnonzero(many > 0)
        first[some] = self.places[self.matrix.smallest(l[some], r[some], skipped[some])]
        more = np.flatnonzero(many > 1)
        step[more] = self.places[self.matrix.smallest(l[more], r[more], skipped[more] + 1)] - first[more]
        return many, first, step


def matching(words: np.ndarray, here: np.ndarray, there: np.ndarray, limit: np.ndarray, way: int) -> np.ndarray:
    """How many words from ``here`` and from ``there`` on are equal, ``limit`` at most, forwards or backwards."""
    total = np.zeros(len(here), np.int64)
    alive, width = np.flatnonzero(limit > 0), 8
    while len(alive):
        going = []
        for part in np.array_split(alive, 1 + len(alive) * width // (1 << 20)):
            ahead = total[part][:, None] + np.arange(width)
            fits = ahead < limit[part][:, None]
            ahead = np.where(fits, ahead, 0) * way
            same = (words[here[part][:, None] + ahead] == words[there[part][:, None] + ahead]) & fits
            whole = same.all(1)
            total[part] += np.where(whole, width, same.argmin(1))
            going.append(part[whole & (total[part] < limit[part])])
        alive, width = np.concatenate(going), min(2 * width, 1 << 14)
    return total


def _joined(q: np.ndarray, first: np.ndarray, last: np.ndarray, stride: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of blocks (period, first block, last block), successive ones of a period made one."""
    by = np.lexsort((first, q))
    q, first, last = q[by], first[by], last[by]
    head = np.ones(len(q), bool)
    head[1:] = (q[1:] != q[:-1]) | (first[1:] != last[:-1] + stride)
    return q[head], first[head], last[np.append(head[1:], True)] if len(q) else last


def _chains(
    array: RepeatedSuffixes, p: np.ndarray, left: np.ndarray, size: np.ndarray, m: int, stride: int,
    windows: tuple[tuple[int, int], ...], behind: np.ndarray, ends: np.ndarray,
) -> np.ndarray:
    """(period, first block, last block) of successive blocks at ``p`` that occur again in a window, at one distance."""
    found = []
    for near, far in windows:
        low, high = np.maximum(p + near, behind), np.minimum(p + far, ends[p] - m)
        some = np.flatnonzero(low <= high)
        many, first, step = array.progressions(left[some], size[some], low[some], high[some])
        which = np.repeat(np.arange(len(some)), many)
        turn = np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many)
        block = p[some][which].astype(np.int64)
        found.append(np.stack((first[which] + turn * step[which] - block, block)))
    q, block = np.concatenate(found, axis=1)
    return np.stack(_joined(q, block, block, stride))


def find_runs(words: np.ndarray, starts: np.ndarray, ends: np.ndarray, min_length: int = MIN_LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, last word, period) of every run, by place and period.

    ``words`` are numbers that differ between documents; ``starts`` and ``ends`` are those of each word's document.
    """
    if min_length < MIN_LENGTH:
        raise ValueError(f"blocks of {FIRST_BLOCK} words find runs of {MIN_LENGTH} words or more")
    begin = end = period = np.zeros(0, np.int64)
    longest = int((ends - starts).max()) if len(words) else 0
    deepest = 1 << max(0, ((longest // 2 + 1) // 2).bit_length() - 1)
    array = RepeatedSuffixes(words, starts, ends, deepest)
    for m, (place, left, size) in sorted(array.blocks.items()):
        # (stride of the blocks, windows of first distances)
        plans = [(2, ((1, 4), (5, 6))), (4, ((7, 10), (11, 14)))] if m == FIRST_BLOCK else [(m, ((2 * m - 1, 3 * m - 2), (3 * m - 1, 4 * m - 2)))]
        for stride, windows in plans:
            mine = (place - starts[place]) % stride == 0
            p, l, n = place[mine], left[mine], size[mine]
            by = np.argsort(p)
            short = period <= m
            reach = np.concatenate(([-1], np.maximum.accumulate(end[short]))) if short.any() else np.array([-1])
            chains = [
                _chains(array, p[part], l[part], n[part], m, stride, windows, reach[np.searchsorted(begin[short], p[part], side="right")] - m + 2, ends)
                for part in np.array_split(by, 1 + len(by) // BLOCKS)
            ]
            q, a, b = _joined(*np.concatenate(chains, axis=1), stride)
            if not len(q):
                continue
            b += m
            i = a - matching(words, a - 1, a - 1 + q, np.minimum(stride, a - starts[a]), -1)
            j = b - 1 + q + matching(words, b, b + q, np.clip(ends[a] - q - b, 0, stride), 1)
            good = j - i + 1 >= np.maximum(min_length, 2 * q)
            begin, end, period = (np.concatenate(x) for x in ((begin, i[good]), (end, j[good]), (period, q[good])))
            by = np.lexsort((period, end, begin))
            begin, end, period = begin[by], end[by], period[by]
            new = np.ones(len(by), bool)
            new[1:] = (begin[1:] != begin[:-1]) | (end[1:] != end[:-1])
            begin, end, period = begin[new], end[new], period[new]
    by = np.lexsort((period, begin))
    return begin[by], end[by], period[by]


def _group_runs(texts: list[bytes], min_length: int) -> tuple[list[int], list[np.ndarray], list[bytes]]:
    """Per text: its words, its runs as rows (start, length, period), and the words that no run repeats."""
    lists, offset = [], 0
    for t in texts:
        own, distinct = numbered(t)
        lists.append(own + offset)
        offset += distinct
    sizes = np.array([len(x) for x in lists])
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    words = np.concatenate(lists)
    del lists
    whole = np.int32 if len(words) < 1 << 30 else np.int64
    begin, end, period = find_runs(words, np.repeat(bounds[:-1].astype(whole), sizes), np.repeat(bounds[1:].astype(whole), sizes), min_length)
    change = np.zeros(len(words) + 1, np.int32)
    np.add.at(change, begin + period, 1)
    np.add.at(change, end + 1, -1)
    gone = np.cumsum(change[:-1]) > 0
    own = np.searchsorted(begin, bounds)
    runs, kept = [], []
    for d, text in enumerate(texts):
        mine = slice(own[d], own[d + 1])
        runs.append(np.stack((begin[mine] - bounds[d], end[mine] - begin[mine] + 1, period[mine]), axis=1))
        at, left = bounds[d], []
        for piece in word_lists(text):
            cut = gone[at : at + len(piece)]
            left += [w for w, g in zip(piece, cut.tolist(), strict=True) if not g] if own[d] < own[d + 1] and cut.any() else piece
            at += len(piece)
        kept.append(b" ".join(left))
    return sizes.tolist(), runs, kept


def _grouped(texts: list[bytes]) -> Iterator[list[bytes]]:
    """Neighbouring texts together, as many as have ``GROUP_WORDS`` words at six bytes each, or one."""
    group, held = [], 0
    for t in texts:
        if group and held + len(t) > 6 * GROUP_WORDS:
            yield group
            group, held = [], 0
        group.append(t)
        held += len(t)
    if group:
        yield group


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH) -> DataFrame:
    """Per row ``id``, ``n_words``, ``runs`` (start, length, period; by start, then period) and ``kept_text``: the words
    that are in no run after its first period, joined by single spaces."""
    taken = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([taken.schema["id"], *T.StructType.fromDDL(FOUND).fields])
    arrow = to_arrow_schema(schema)
    triple = arrow.field("runs").type.value_type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, at = [t or b"" for t in as_bytes(batch.column(1))], 0
            for group in _grouped(texts):
                sizes, runs, kept = _group_runs(group, min_length)
                flat = np.concatenate(runs)
                lists = pa.ListArray.from_arrays(
                    pa.array(np.concatenate(([0], np.cumsum([len(r) for r in runs]))), pa.int32()),
                    pa.StructArray.from_arrays([pa.array(flat[:, i], pa.int64()) for i in range(3)], fields=list(triple)),
                ).cast(arrow.field("runs").type)
                columns = [batch.column(0).slice(at, len(group)), pa.array(sizes, pa.int64()), lists, pa.array(kept, pa.binary()).cast(arrow.field("kept_text").type)]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)
                at += len(group)

    return taken.mapInArrow(run, schema)
