"""Substring dedup by prefix-partitioned suffix trees over words.

A suffix's prefix runs from its first word to the end of the gram of 8 words that has the smallest hash in its first 35
words, so prefixes are 8 to 35 words long; suffixes are dealt to groups by that gram, which keeps neighbouring suffixes
of a text in one slice. Each group builds the tree of its suffixes breadth-first: node numbers at depths 1, 2, 4, ...
words come from pairs of nodes of half the depth. The nodes at depth 35 with two leaves or more, the deep internal ones,
are the repeats; windows below them go. Nodes are told apart by words, not hashes.

Defined results: a NULL or empty text has no words; a text repeated under any id repeats its windows; NULL ids are
rows like any other; a text of fewer than 35 words loses nothing. An empty table gives an empty result. Ids are integers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm import repeats


def nodes_at(tokens: np.ndarray, depth: int) -> np.ndarray:
    """Numbers of the tree's nodes at ``depth``: equal for places followed by equal tokens. Shorter by depth - 1."""
    nodes, at = np.unique(tokens, return_inverse=True)[1].astype(np.int64), 1
    while at < depth:
        step = min(at, depth - at)
        left, right = nodes[: len(nodes) - step], nodes[step:]
        nodes = np.unique(left * (len(tokens) + 1) + right, return_inverse=True)[1].astype(np.int64)
        at += step
    return nodes


class WordRepeats(repeats.Kind):
    symbol_bytes = 8

    def __init__(self, window: int = 35, gram: int = 8):
        if not 0 < gram <= window or window - gram >= 64:
            raise ValueError("a window holds the gram and has at most 64 of them")
        self.window, self.gram = window, gram

    def lay_out(self, texts):
        split = [t.split() for t in texts]
        self.words = [w for ws in split for w in ws]
        self.lengths = [len(ws) for ws in split]
        self.ends = np.cumsum(self.lengths)
        digest = xxhash.xxh3_64_intdigest
        return np.fromiter((digest(w) for w in self.words), np.uint64, len(self.words)), self.lengths

    def content(self, start, end, anchor):
        return (b" ".join(self.words[start:end]),)

    def weigh(self, ids, entry, n):
        return np.bincount(entry, minlength=n)

    def always(self, ids, entry, weights):
        return weights > 1

    def encode(self, contents, weights):
        texts = [c for (c,) in contents]
        shared, tails = front_code(texts)
        return repeats.packed(("p", pa.array(shared, pa.int32())), ("t", pa.array(tails, pa.binary())), ("w", pa.array(np.minimum(weights, 2), pa.int8())))

    def settle(self, blocks):
        vocabulary: dict[bytes, int] = {}
        tokens: list[int] = []
        sizes, weights, entries = [], [], []
        for block in blocks:
            batch = repeats.unpacked(block)
            texts = front_decode(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            for t in texts:
                words = t.split(b" ")
                tokens += [vocabulary.setdefault(w, len(vocabulary)) for w in words]
                sizes.append(len(words))
            weights += batch.column(2).to_pylist()
            entries.append(len(texts))
        sizes, weights = np.array(sizes), np.array(weights)
        nodes = nodes_at(np.array(tokens, np.int64), self.window)
        counts = sizes - self.window + 1
        begins = np.cumsum(sizes) - sizes
        owner = np.repeat(np.arange(len(sizes)), counts)
        offset = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
        at = nodes[begins[owner] + offset]
        repeated = np.bincount(at, weights[owner])[at] > 1
        masks = np.zeros(len(sizes), np.uint64)
        np.bitwise_or.at(masks, owner[repeated], np.uint64(1) << offset[repeated].astype(np.uint64))
        return np.split(masks, np.cumsum(entries)[:-1])

    def kept(self, doc, cover):
        words = self.words[self.ends[doc] - self.lengths[doc] : self.ends[doc]]
        return b" ".join(words if not cover.any() else [w for w, c in zip(words, cover.tolist(), strict=True) if not c])


def front_code(texts: list[bytes]) -> tuple[list[int], list[bytes]]:
    """Of each of the sorted texts the bytes shared with the one before, and the rest."""
    shared, tails, last = [], [], b""
    for t in texts:
        n = common_prefix(last, t, 0)
        shared.append(n)
        tails.append(t[n:])
        last = t
    return shared, tails


def front_decode(shared: list[int], tails: list[bytes]) -> list[bytes]:
    out, last = [], b""
    for n, t in zip(shared, tails, strict=True):
        last = last[:n] + t
        out.append(last)
    return out


def common_prefix(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix, of which ``known`` bytes need no comparing."""
    end = min(len(a), len(b))
    differing = int.from_bytes(a[known:end], "big") ^ int.from_bytes(b[known:end], "big")
    return end - (differing.bit_length() + 7 >> 3)


def drop_repeated_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35, gram: int = 8, **sizes: int) -> DataFrame:
    """Per document ``id``, ``n_words``, ``n_removed``, removed word ``spans`` and the ``kept_text``."""
    out = repeats.remove_repeats(docs, WordRepeats(window, gram), id_col, text_col, **sizes)
    return out.select("id", F.col("n").alias("n_words"), "n_removed", "spans", F.decode("kept", "UTF-8").alias("kept_text"))
