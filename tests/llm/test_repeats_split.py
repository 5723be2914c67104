"""Anchors with many contexts are split by size, whatever number of runs holds them, and results stay the same."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from fleetlens.llm import repeats, substring_dedup, suffix_array_dedup

from test_corpus_operators import make

KINDS = {
    "bytes": (suffix_array_dedup.ByteRepeats, suffix_array_dedup.drop_repeated_bytes, "one frequent phrase of text"),
    "words": (substring_dedup.WordRepeats, substring_dedup.drop_repeated_words, " ".join(f"common{i}" for i in range(20))),
}


def frequent(phrase):
    """A phrase between ever new words, and some texts that repeat its surroundings."""
    rng = random.Random(2)
    other = lambda n: " ".join(f"x{rng.getrandbits(60):x}" for _ in range(n))
    texts = [f"{other(12)} {phrase} {other(12)}" for _ in range(400)]
    texts += [f"{t} {other(6)}" for t in texts[::40]] + [f"{other(3)} {t[9:-5]}" for t in texts[1::40]] + [phrase * 3] * 3
    return [(i, t, "a") for i, t in enumerate(texts)]


@pytest.mark.parametrize("kind", KINDS)
def test_groups_stay_small_and_results_equal(spark, monkeypatch, kind, tmp_path):
    make_kind, drop, phrase = KINDS[kind]
    docs = make(spark, frequent(phrase)).repartition(3).cache()
    docs.count()

    def result(**sizes):
        return sorted(map(tuple, drop(docs, **sizes).withColumn("spans", F.col("spans").cast("string")).collect()))

    whole = result()
    assert sum(r[2] for r in whole) > 0
    largest = {}
    compare = repeats._compare

    for name, most in (("classes", 150), ("windows", 20)):
        folder = tmp_path / name
        folder.mkdir()

        def logged(k, parts, folder=str(folder), inner=compare, unpack=repeats.unpacked):
            run = inner(k, parts)

            def counted(table):
                if table["part"][0].as_py() < parts:
                    entries = [unpack(b).num_rows for b in table["block"].to_pylist()]
                    with open(f"{folder}/{table['part'][0].as_py()}", "w") as out:
                        out.write(str(sum(entries)))
                return run(table)

            return counted

        monkeypatch.setattr(repeats, "_compare", logged)
        size = make_kind().entry_bytes
        # Many groups beside a bound of ``most`` entries an anchor; hot_runs is beyond the runs there are.
        monkeypatch.setattr(repeats.math, "ceil", lambda x: 4000)
        assert result(run_bytes=8000, part_bytes=most * size) == whole
        monkeypatch.undo()
        largest[name] = max(int(f.read_text()) for f in folder.iterdir())
    # Unsplit, one anchor's 400 contexts were one group.
    assert largest["classes"] < 150 and largest["windows"] < 150
