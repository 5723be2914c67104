"""The conversation trie against brute force: several column blocks, ties, NULLs, copies, long conversations, odd columns."""

from __future__ import annotations

import hashlib
import math
import random
import zlib

import pytest
from pyspark.sql import functions as F

from fleetlens.llm import prefix_trie
from fleetlens.llm.queries import QUERIES, table, with_borrowed_heads

SMALL = "/root/testdata/sf0.001"
SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def ordered(rows):
    """Turns of each conversation, in order; those of equal number by their turn id."""
    by = {}
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            key = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()[:16] + len(text.encode()).to_bytes(4, "big")
            by.setdefault(c, []).append((t is not None, t or 0, key, (role, text)))
    return {c: [x[3] for x in sorted(turns, key=lambda x: x[:3])] for c, turns in by.items()}


def rebuilt(by):
    out = {}
    for c, turns in by.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = by.get(c - int(math.fmod(c, 5)), [])[:h] + turns[h:]
    return out


def brute(convs):
    members, children, sums = {}, {}, {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    for path in members:
        if path:
            children.setdefault(path[:-1], []).append(path)
    for path in sorted(members, key=len, reverse=True):
        below = [sums[k] for k in children.get(path, ())]
        own = (len(members[path]) - 1) * len(path[-1][1].encode()) if path else 0
        sums[path] = (sum(x[0] for x in below) if below else 1, own + sum(x[1] for x in below))
    return sorted(
        (
            min(m), len(path), min(members[path[:-1]]) if path else None, len(m), len(children.get(path, ())), *sums[path],
            hashlib.sha256(",".join(str(c) for c in sorted(m) if len(convs[c]) == len(path)).encode()).hexdigest(),
        )
        for path, m in members.items()
    )


def found(df):
    assert df.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r) for r in df.collect()), key=lambda r: (r[0], r[1]))


def random_rows(seed):
    r, rows = random.Random(seed), []
    for c in range(60):
        if c % 3 == 0:  # copies, some cut short
            rows += [(c, t, "user" if t % 2 else None, f"shared {t}") for t in range(r.choice((3, 8, 20, 23)))]
        else:
            rows += [(c, r.choice((t, t, None)), r.choice(("user", "assistant")), r.choice(("a", "bé", "", None, "ccc"))) for t in range(r.randrange(1, 14))]
    rows += [(100 + i, t, "user", "x" * (t + 1)) for i in range(2) for t in range(90)]  # two long ones, equal to their end
    rows += [(200, t, "user", "alone") for t in range(300)] + [(-7, 1, "user", "a"), (-7, 1, "user", "a"), (None, 1, "user", "a")]
    return rows


@pytest.mark.parametrize("widths", ((2, 3), prefix_trie.WIDTHS))
def test_trie(spark, widths):
    rows = random_rows(3)
    conversations = spark.createDataFrame(rows, SCHEMA).repartition(7)
    for clash in ("prior", "pos", "d", "t1", "node", "KEY_"):
        conversations = conversations.withColumn(clash, F.lit(1))
    assert found(prefix_trie.prefix_trie(conversations, widths)) == brute(ordered(rows))


def test_borrowed_heads(spark):
    rows = random_rows(4)
    turns, convs = prefix_trie.numbered_turns(spark.createDataFrame(rows, SCHEMA))
    assert found(prefix_trie.trie(*with_borrowed_heads(turns, convs))) == brute(rebuilt(ordered(rows)))


def test_hot_conversation_and_rows(spark):
    """A third of all rows in one conversation, and as many equal rows without a turn number."""
    rows = [(5, t, "user", f"t{t}") for t in range(3000)] + [(6, None, "user", "same")] * 3000 + [(10 + i, t, "user", f"c{t}") for i in range(1000) for t in range(3)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        turns, convs = prefix_trie.numbered_turns(spark.createDataFrame(rows, SCHEMA))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert turns.groupBy("conv_id").agg(F.count_distinct("pos").alias("n"), F.max("pos").alias("last")).filter("n <> last").isEmpty()
    assert {r.conv_id: r.n_turns for r in convs.filter("conv_id < 10").collect()} == {5: 3000, 6: 3000}
    nodes = prefix_trie.trie(turns, convs)
    assert nodes.count() == 1 + 3000 + 3000 + 3
    ends = hashlib.sha256(",".join(str(10 + i) for i in range(1000)).encode()).hexdigest()
    assert [tuple(r) for r in nodes.filter("conv_id = 10 AND depth > 0").orderBy("depth").collect()] == [
        (10, 1, 5, 1000, 1, 1, 999 * 6, prefix_trie.NO_ENDS), (10, 2, 10, 1000, 1, 1, 999 * 4, prefix_trie.NO_ENDS), (10, 3, 10, 1000, 0, 1, 999 * 2, ends),
    ]


def test_long_list_of_ends(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE", 50)
    members = spark.range(4000).selectExpr("CAST(concat('n', id % 3) AS BINARY) AS node", "id AS conv_id").repartition(9)
    want = {f"n{k}": hashlib.sha256(",".join(str(i) for i in range(k, 4000, 3)).encode()).hexdigest() for k in range(3)}
    assert {bytes(r.node).decode(): r.ends for r in prefix_trie._ends(members).collect()} == want


def test_empty_and_single(spark):
    assert prefix_trie.prefix_trie(spark.createDataFrame([], SCHEMA)).count() == 0
    assert found(prefix_trie.prefix_trie(spark.createDataFrame([(None, 1, "a", "b")], SCHEMA))) == []
    rows = [(3, 2, "u", "b"), (3, 1, None, None)]
    assert found(prefix_trie.prefix_trie(spark.createDataFrame(rows, SCHEMA))) == brute(ordered(rows))


def test_query_matches_brute_force(spark):
    rows = [tuple(r) for r in table(spark, SMALL, "conversations").select("conv_id", "turn", "role", "text").collect()]
    assert found(QUERIES["op13_prefix_trie"](spark, SMALL)) == brute(rebuilt(ordered(rows)))
