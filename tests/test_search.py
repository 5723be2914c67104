"""The trigram index finds what a scan finds, and reads what it names alone."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from fleetlens.filters import where
from fleetlens.functions.text import contains_text
from fleetlens.operators import explore as ex
from fleetlens.operators import search
from fleetlens.sources.catalog import MartCatalog


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    """Rows with blank, short, accented, repeated and long texts, and marks of their own, in several parts."""
    r = random.Random(7)
    letters = "abABé %_'\\\x00漢😀1"
    texts = [None, "", " ", "a", "ab", "\x00", "a\x00", "Straße", "İstanbul", *("".join(r.choice(letters) for _ in range(r.randrange(12))) for _ in range(300))]
    rows = [(i, t, r.choice(texts)) for i, t in enumerate(texts)] + [(1000 + i, "the same text", None) for i in range(50)]
    folder = str(tmp_path_factory.mktemp("search"))
    spark.createDataFrame(rows, "id bigint, name string, other string").repartition(3).write.parquet(f"{folder}/rows")
    table = spark.read.parquet(f"{folder}/rows")
    made = search.text_index(table, "some", {"id": F.col("id"), "name": F.col("name"), "other": F.col("other")}, MartCatalog(spark, f"{folder}/catalog"))
    return table, made, texts


def test_index_finds_what_a_scan_finds(index):
    table, made, texts = index
    r = random.Random(8)
    known = [t for t in texts if t]
    queries = ["a", "A", "ab", "%", "_a", "é", "the same", "SAME TEXT", "no such text", "10", "\x00", "a\x00\x00", "ß", "i̇s", "漢", "😀"]
    for _ in range(25):
        t = r.choice(known)
        at = r.randrange(len(t))
        queries.append(t[at : at + r.randint(1, 5)])
    wanted = {q: {x.id for x in where(table, contains_text(("name", "other", "id"), q, 1)).collect()} for q in queries}
    for q in queries:
        found = [x.id for x in made.search(q, min_length=1).collect()]
        assert sorted(found) == sorted(wanted[q]), q
    one = where(table, contains_text(("other",), "ab"))
    assert sorted(x.id for x in made.search("AB", ["other"]).collect()) == sorted(x.id for x in one.collect())
    assert made.search("a").count() == table.count() and made.search("").columns == table.columns


def test_lists_are_bounded_by_parts(spark, monkeypatch):
    monkeypatch.setattr(search, "_BITS", 6)
    rows = search.numbered_rows(spark.range(1000).selectExpr("'common' AS t", "id").repartition(2)).persist()
    lists = search.postings(rows, {"t": F.col("t")})
    assert lists.agg(F.max(F.size("places"))).first()[0] == 64 and lists.filter("gram = 'omm'").count() > 10
    found = search.TextIndex(rows, lists, {"t": F.col("t")}).search("MMO")
    assert found.count() == 1000
    rows.unpersist()


def test_search_reads_posting_lists(index):
    _, made, _ = index
    plan = made.search("same")._jdf.queryExecution().executedPlan().toString()
    assert "gram" in plan and "PushedFilters: [In(" in plan or "In(gram" in plan
    short = made.search("sa")._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(gram,sa)" in short


def test_lookups_by_index(tables, spark, tmp_path):
    folder = str(tmp_path / "centers")
    tables.centers.write.parquet(folder)
    t = tables.replacing({"center_details": spark.read.parquet(folder)})
    made = search.center_index(t, MartCatalog(spark, str(tmp_path / "catalog")))
    for q in ("", "4", "44", "State 1", "hub 1", "nothing"):
        assert [tuple(r) for r in ex.find_centers(made, q).collect()] == [tuple(r) for r in ex.find_centers(t.centers, q).collect()]
        for c, also in (("HubName", "HubID"), ("DeviceID", None)):
            assert ex.find_values(made, c, "v", q, also).collect() == ex.find_values(t.centers, c, "v", q, also).collect()
