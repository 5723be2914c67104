"""A rated id that is repeated in the documents sends one row to the driver."""

from __future__ import annotations

from fleetlens.llm import quality_classifier

from test_corpus_operators import make


def test_repeated_id_is_one_training_row(spark, monkeypatch):
    held = []
    monkeypatch.setattr(quality_classifier, "fit_ordinal", lambda rows, grades, n: held.append((len(rows), sorted(grades.tolist()))))
    docs = make(spark, [(1, f"text {i}", "s") for i in range(50)] + [(2, None, "s"), (None, "x", "s")])
    quality_classifier.train(docs, spark.createDataFrame([(1, 0), (1, 2), (2, 1), (3, 1)], "doc_id bigint, grade int"))
    assert held == [(3, [0, 1, 2])]
