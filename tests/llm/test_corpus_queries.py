"""Registered queries against their SQL on the smallest tables, and the pipeline against brute force over its stages."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest
import xxhash
from check import rows_of
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from fleetlens.llm import check_sql, decontaminate, quality_classifier
from fleetlens.llm.queries import QUERIES, graded, table

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SMALL}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", check_sql.ORACLES)
def test_query_matches_its_sql(spark, duck, name):
    df = QUERIES[name](spark, SMALL)
    result = duck.execute(check_sql.ORACLES[name])
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of([d[0] for d in result.description], result.fetchall())


def test_registered(spark):
    assert set(QUERIES) | {"pipeline"} <= set(__spark_entry__.queries()) and set(check_sql.ORACLES) <= set(__spark_entry__.oracle_sql())
    native = ("op3_mixing", "op5_url_filter", "op7_license_scan", "op9_secret_scan")
    for name in native:
        plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
        assert not any(bad in plan for bad in ("EvalPython", "MapInArrow", "CartesianProduct", "BroadcastNestedLoopJoin"))


def test_pipeline(spark):
    """Stage by stage: what each keeps follows from its operator's definition, and the last rows are those of run()."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    names = docs.columns
    model = quality_classifier.train(docs, graded(spark.read.parquet(f"{SMALL}/labels.parquet")))
    scores = [float(model.above([(r.text or "").encode()])[0][-1]) for r in docs.collect()]
    good = corpus_pipeline.good_quality(spark, docs, SMALL)
    assert good.columns == names and good.count() == sum(s >= 0.5 for s in scores)

    def simhash(text):
        words = (text or "").encode().lower().split()
        hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(max(1, len(words) - 2))] if words else []
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    rows = sorted((r.doc_id, simhash(r.text)) for r in good.collect())
    root = list(range(len(rows)))
    for _ in rows:
        new = [min(root[j] for j in range(len(rows)) if (rows[i][1] ^ rows[j][1]).bit_count() <= 3) for i in range(len(rows))]
        if new == root:
            break
        root = new
    single = corpus_pipeline.without_near_copies(spark, good, SMALL)
    assert single.columns == names and sorted(r.doc_id for r in single.collect()) == [rows[i][0] for i in sorted(set(root))]

    items = [r.text.encode() for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    grams = {tuple(w[k : k + 13]) for t in items for w in (decontaminate.fold_words(t),) for k in range(len(w) - 12)}
    assert all(len(decontaminate.fold_words(t)) >= 13 for t in items)

    def clean(text):
        words, hit = decontaminate.fold_words((text or "").encode()), set()
        for k in range(len(words) - 12):
            if tuple(words[k : k + 13]) in grams:
                hit |= set(range(k, k + 13))
        return not hit or 20 * len(hit) < len(words)

    fair = corpus_pipeline.without_benchmark(spark, single, SMALL)
    assert fair.columns == names and {r.doc_id for r in fair.collect()} == {r.doc_id for r in single.collect() if clean(r.text)}
    safe = corpus_pipeline.without_secrets(spark, fair, SMALL)
    assert safe.columns == names and safe.dtypes == docs.dtypes and safe.count() == fair.count()
    assert safe.filter(F.col("text").rlike("AKIA[A-Z0-9]{16}|[0-9a-f]{24}")).count() == 0
    last = sorted(tuple(r) for r in corpus_pipeline.mixed(spark, safe, SMALL).collect())
    assert last == sorted(tuple(r) for r in corpus_pipeline.run(spark, SMALL).collect()) and len(last) == safe.count()


def test_stages_leave_clashing_columns_alone(spark):
    docs = table(spark, SMALL, "documents")
    names = ("_quality", "_kept", "_Hits", "_blob", "_findings", "id", "component")
    wide = docs.select("*", *(F.concat(F.lit(n), F.col("doc_id").cast("string")).alias(n) for n in names))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        plain, out = stage(spark, docs, SMALL), stage(spark, wide, SMALL)
        assert out.columns == wide.columns
        assert sorted(map(tuple, out.select(docs.columns).collect())) == sorted(map(tuple, plain.collect()))
        assert out.filter(" OR ".join(f"{n} <> concat('{n}', doc_id)" for n in names)).isEmpty()
