"""Periodic runs against brute force: random and periodic texts, odd rows, and the whole registered query."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

from pyspark.sql import functions as F

from fleetlens.llm import periodic_runs
from fleetlens.llm.queries import QUERIES, table

SMALL = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(words):
    """(start, length, period) of each run: for every period, the maximal stretches that keep it."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        t = 0
        while t + q < n:
            i = t
            while t + q < n and words[t] == words[t + q]:
                t += 1
            if t > i and t - i + q >= max(12, 2 * q):
                found.setdefault((i, t - i + q), q)
            t += t == i
    return sorted((i, length, q) for (i, length), q in found.items())


def collapsed(words, runs):
    gone = {k for i, length, q in runs for k in range(i + q, i + length)}
    return " ".join(w for k, w in enumerate(words) if k not in gone)


def random_text(r):
    n, kind = r.randrange(120), r.random()
    if kind < 0.4:
        return [r.choice("ab" if kind < 0.2 else "abc") for _ in range(n)]
    if kind < 0.5:
        return ["a"] * n
    if kind < 0.7:  # words of Fibonacci, with an error now and then
        a, b = "a", "ab"
        for _ in range(r.randint(2, 8)):
            a, b = b, b + a
        words = list(b[:n])
        if words and kind < 0.6:
            words[r.randrange(len(words))] = "c"
        return words
    words = []
    while len(words) < n:
        unit = [r.choice("abcd") for _ in range(r.randint(1, 25))]
        words += (unit * 10)[: r.randint(1, 3 * len(unit) + 4)]
    return words


def test_groups_of_texts():
    r = random.Random(5)
    texts = [random_text(r) for _ in range(600)]
    at = 0
    while at < len(texts):  # documents of one group share the arrays, but nothing crosses from one to the next
        group = texts[at : at + r.randint(1, 9)]
        at += len(group)
        sizes, runs, kept = periodic_runs._group_runs([" ".join(w).encode() for w in group], 12)
        assert sizes == [len(w) for w in group]
        for words, mine, left in zip(group, runs, kept, strict=True):
            want = brute(words)
            assert [tuple(x) for x in mine.tolist()] == want
            assert left.decode() == collapsed(words, want)


def test_long_texts(monkeypatch):
    """Texts read in pieces; the closed form of their runs is known."""
    monkeypatch.setattr(periodic_runs, "PIECE", 1000)
    monkeypatch.setattr(periodic_runs, "BLOCKS", 64)
    unit = [f"w{i}" for i in range(777)]
    own = [f"x{i}" for i in range(500)]
    for words, run in (
        (["a"] * 60000, (0, 60000, 1)), (["a", "b", "c"] * 9000, (0, 27000, 3)), (own + unit * 7 + own, (500, 777 * 7, 777)), (own * 2, (0, 1000, 500)),
    ):
        _, runs, kept = periodic_runs._group_runs(["\n ".join(words).encode()], 12)
        assert [tuple(x) for x in runs[0].tolist()] == [run]
        assert kept[0].decode() == collapsed(words, [run])


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "a " * 11), (5, "a " * 12), (5, "a " * 12), (None, "x y " * 6), (6, "É漢 😀 b " * 9), (7, "a\x0bb\x0ca\rb\t" * 4)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    for clash in ("runs", "n_words", "id", "kept_text", "KEPT_text_"):
        docs = docs.withColumn(clash, F.lit("mine"))
    out = periodic_runs.periodic_runs(docs).collect()
    rest = [(i, WORD.findall(t or "")) for i, t in rows]
    want = [(i, len(w), brute(w), collapsed(w, brute(w))) for i, w in rest]
    assert sorted((str(r.id), r.n_words, [tuple(x) for x in r.runs], r.kept_text) for r in out) == sorted((str(i), *w) for i, *w in want)
    assert periodic_runs.periodic_runs(docs.limit(0)).count() == 0


def test_query_matches_brute_force(spark):
    want = {}
    for r in table(spark, SMALL, "documents").collect():
        words, h = WORD.findall(r.text or ""), zlib.crc32(str(r.doc_id).encode())
        n, g = len(words), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        runs = brute(words) if n < 2500 else [tuple(x) for x in periodic_runs._group_runs([" ".join(words).encode()], 12)[1][0].tolist()]
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=None)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want[r.doc_id] = (
            len(runs), *(best or (None, None, None)), 1000 * best[1] // best[2] if best else None,
            sha("".join(f"{i},{length},{q}\n" for i, length, q in runs)), sha(collapsed(words, runs)),
        )
    got = {r[0]: tuple(r)[1:] for r in QUERIES["op12_periodic_runs"](spark, SMALL).collect()}
    assert got == want and any(v[0] for v in want.values())
