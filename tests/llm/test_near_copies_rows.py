"""The pipeline keeps one row of each class of near copies, also where ids are NULL or repeated."""

from __future__ import annotations

import corpus_pipeline

from test_corpus_operators import make


def test_one_row_a_class(spark):
    text = {n: " ".join(f"{n}{(i * k) % 89}x" for i in range(90)) for n, k in (("a", 7), ("b", 11), ("c", 13), ("d", 17))}
    rows = [
        (1, text["a"], "first"), (1, text["a"], "same row again"), (None, text["a"], "NULL id beside an id"), (2, text["a"], "copy"),
        (None, text["b"], "NULL ids alone"), (None, text["b"], "NULL ids alone"),
        (5, text["c"], "kept"), (7, text["c"], "id 7 is no first row here"), (7, text["d"], "but here"), (8, text["d"], "copy"),
    ]
    docs = make(spark, rows)
    kept = corpus_pipeline.without_near_copies(spark, docs, "")
    assert kept.columns == docs.columns
    want = sorted([(1, text["a"]), (None, text["b"]), (5, text["c"]), (7, text["d"])], key=str)
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == want
