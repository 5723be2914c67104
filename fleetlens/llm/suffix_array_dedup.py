"""Suffix-array dedup by a common-prefix-aware distributed merge sort over bytes.

Of a text's suffixes, those that start at an anchor (the gram of ``gram`` bytes with the smallest hash in some window) are
sorted: any two equal windows hold the same anchor at the same place. A run sorts its suffixes and sends them front-coded:
the length of the prefix shared with the one before, and the rest. A group merges the runs with a loser tree whose nodes
keep how much a loser shares with the last winner, so a prefix known to be equal is never compared again; the merge yields
the sorted suffixes with their common prefixes, a suffix array with its LCP array. Places where r bytes behind the anchor
and 50 - r bytes before it agree, read off the LCP arrays of the suffixes and of the reversed bytes before them, are the
same 50-byte string; it goes wherever a smaller document id has it.

Defined results: a NULL text has no bytes; a NULL id comes after all others; rows of one id do not count against
each other; a text of fewer than 50 bytes loses nothing. An empty table gives an empty result. Ids are integers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm import repeats
from fleetlens.llm.substring_dedup import common_prefix, front_code, front_decode


def merge(runs: list[tuple[list[bytes], list[int]]]) -> tuple[list[tuple[int, int]], list[int]]:
    """Places (run, index) of all strings in order, and what each shares with the one before.

    Each run holds sorted strings and what each shares with the one before it.
    """
    leaves = 1
    while leaves < len(runs):
        leaves *= 2
    at = [0] * leaves
    head: list[bytes | None] = [r[0][0] if r[0] else None for r in runs] + [None] * (leaves - len(runs))
    loser, loser_shared = [0] * leaves, [-1] * leaves

    def play(a: int, sa: int, b: int, sb: int) -> tuple[int, int, int, int]:
        """Winner and loser with what they share with the last winner (-1: the run has ended)."""
        if sa != sb:
            return (a, sa, b, sb) if sa > sb else (b, sb, a, sa)
        if sa < 0:
            return a, sa, b, sb
        x, y = head[a], head[b]
        n = common_prefix(x, y, sa)
        if n == len(y) and n < len(x) or n < len(x) and n < len(y) and y[n] < x[n]:
            return b, sb, a, n
        return a, sa, b, n

    def first(node: int) -> tuple[int, int]:
        if node >= leaves:
            k = node - leaves
            return k, 0 if head[k] is not None else -1
        winner, shared, loser[node], loser_shared[node] = play(*first(2 * node), *first(2 * node + 1))
        return winner, shared

    k, shared = first(1)
    order, lcp = [], []
    while shared >= 0:
        order.append((k, at[k]))
        lcp.append(shared)
        at[k] += 1
        strings, prefixes = runs[k]
        if at[k] < len(strings):
            head[k], shared = strings[at[k]], prefixes[at[k]]
        else:
            head[k], shared = None, -1
        node = k + leaves >> 1
        while node:
            j, sj = loser[node], loser_shared[node]
            if sj > shared:
                loser[node], loser_shared[node], k, shared = k, shared, j, sj
            elif sj == shared and sj >= 0:
                k, shared, loser[node], loser_shared[node] = play(k, shared, j, sj)
            node >>= 1
    return order, lcp


def _sorted_lcp(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    order = sorted(range(len(strings)), key=strings.__getitem__)
    shared, last = [], b""
    for i in order:
        shared.append(common_prefix(last, strings[i], 0))
        last = strings[i]
    return np.array(order, np.int64), np.array(shared, np.int64)


class ByteRepeats(repeats.Kind):
    symbol_bytes = 1

    def __init__(self, window: int = 50, gram: int = 20):
        if not 0 < gram <= window or window - gram >= 64:
            raise ValueError("a window holds the gram and has at most 64 of them")
        self.window, self.gram = window, gram
        self.codes = np.random.default_rng(7).integers(0, 1 << 64, 256, np.uint64)

    def lay_out(self, texts):
        self.text, self.lengths = b"".join(texts), [len(t) for t in texts]
        self.ends = np.cumsum(self.lengths)
        return self.codes[np.frombuffer(self.text, np.uint8)], self.lengths

    def content(self, start, end, anchor):
        return self.text[anchor:end], self.text[start:anchor]

    def weigh(self, ids, entry, n):
        least = np.full(n, repeats.NO_ID)
        np.minimum.at(least, entry, ids)
        return least

    def always(self, ids, entry, weights):
        return ids > weights

    def encode(self, contents, weights):
        shared, tails = front_code([right for right, _ in contents])
        left = [x for _, x in contents]
        return repeats.packed(("p", pa.array(shared, pa.int16())), ("t", pa.array(tails, pa.binary())), ("l", pa.array(left, pa.binary())), ("w", pa.array(weights, pa.int64())))

    def settle(self, blocks):
        runs, lefts, ids, first = [], [], [], [0]
        for block in blocks:
            batch = repeats.unpacked(block)
            shared = batch.column(0).to_pylist()
            runs.append((front_decode(shared, batch.column(1).to_pylist()), shared))
            lefts += batch.column(2).to_pylist()
            ids.append(batch.column(3).to_numpy())
            first.append(first[-1] + len(shared))
        ids, n = np.concatenate(ids), first[-1]
        order, lcp = merge(runs)
        order, lcp = np.fromiter((first[r] + i for r, i in order), np.int64, n), np.array(lcp, np.int64)
        behind = np.fromiter((len(s) for strings, _ in runs for s in strings), np.int64, n)
        before = np.fromiter(map(len, lefts), np.int64, n)
        back_order, back_lcp = _sorted_lcp([x[::-1] for x in lefts])
        right, left = np.empty(n, np.int64), np.empty(n, np.int64)
        masks = np.zeros(n, np.uint64)
        for o in range(self.window - self.gram + 1):
            # Windows that start o bytes before the anchor.
            has = np.flatnonzero((before >= o) & (behind >= self.window - o))
            if not len(has):
                continue
            right[order] = np.cumsum(lcp < self.window - o)
            left[back_order] = np.cumsum(back_lcp < o)
            _, same = np.unique(right[has] * (n + 2) + left[has], return_inverse=True)
            least = np.full(same.max() + 1, repeats.NO_ID)
            np.minimum.at(least, same, ids[has])
            gone = has[least[same] < ids[has]]
            masks[gone] |= np.uint64(1) << (before[gone] - o).astype(np.uint64)
        return np.split(masks, first[1:-1])

    def kept(self, doc, cover):
        text = self.text[self.ends[doc] - self.lengths[doc] : self.ends[doc]]
        return text if not cover.any() else np.frombuffer(text, np.uint8)[~cover].tobytes()


def drop_repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, gram: int = 20, **sizes: int) -> DataFrame:
    """Per document ``id``, ``n_bytes``, ``n_removed``, removed byte ``spans`` and the ``kept`` bytes."""
    out = repeats.remove_repeats(docs, ByteRepeats(window, gram), id_col, text_col, **sizes)
    return out.select("id", F.col("n").alias("n_bytes"), "n_removed", "spans", "kept")
