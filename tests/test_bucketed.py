"""Fact tables in buckets: the builders return the same rows, and no exchange lies on the fact side."""

from __future__ import annotations

import re

import pytest

from fleetlens.operators import lineage as ln
from fleetlens.sources.bucketed import bucketed
from fleetlens.sources.catalog import MartCatalog


@pytest.fixture(scope="module")
def stored(spark, tables, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("facts"))
    frames = {}
    for name in ("source_heartbeats", "source_changelog", "support_tickets"):
        tables.scan(name).write.parquet(f"{folder}/{name}")
        frames[name] = spark.read.parquet(f"{folder}/{name}")
    return frames, MartCatalog(spark, f"{folder}/catalog")


def equal(a, b):
    b = b.select(a.columns)
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_builders_over_buckets(spark, tables, stored):
    frames, catalog = stored
    scan = tables.scan
    beats = bucketed(frames["source_heartbeats"], "heartbeats", ["DeviceID"], 8, 4, catalog)
    tickets = bucketed(frames["support_tickets"], "tickets", ["CenterID"], 8, 4, catalog)
    changes = bucketed(frames["source_changelog"], "changelog", ["project_key", "issue_key"], 8, 4, catalog)
    people = [scan(f"source_{n}") for n in ("centers", "members", "organizations", "managers")]
    built = {
        "h": (ln.build_heartbeats(beats, scan("source_devices"), scan("source_centers")), ln.build_heartbeats(scan("source_heartbeats"), scan("source_devices"), scan("source_centers"))),
        "t": (ln.build_support_tickets(tickets, *people), ln.build_support_tickets(tables.tickets, *people)),
        "r": (ln.build_register(scan("source_issues"), changes), ln.build_register(scan("source_issues"), scan("source_changelog"))),
    }
    for name, (by_bucket, plain) in built.items():
        assert sorted(by_bucket.columns) == sorted(plain.columns) and equal(plain, by_bucket), name


def test_facts_are_not_exchanged(spark, tables, stored):
    frames, catalog = stored
    tickets = bucketed(frames["support_tickets"], "tickets", ["CenterID"], 8, 4, catalog)
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false", "spark.sql.maxMetadataStringLength": "3000"}
    old = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        people = [tables.scan(f"source_{n}") for n in ("centers", "members", "organizations", "managers")]
        plan = ln.build_support_tickets(tickets, *people)._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    lines = plan.splitlines()
    at = next(i for i, x in enumerate(lines) if "FileScan parquet" in x and "Bucketed: true" in x and "ticketNumber" in x)
    depth = [len(re.match(r"[ :+\-|]*", x)[0]) for x in lines]
    above, least = [], depth[at]
    for i in range(at - 1, -1, -1):  # the scan's ancestors
        if depth[i] < least:
            above.append(lines[i])
            least = depth[i]
    assert any("SortMergeJoin" in x for x in above) and not any("Exchange" in x for x in above)


def test_a_hot_key_lies_in_several_buckets(spark, tmp_path):
    spark.range(3000).selectExpr("IF(id % 3 = 0, 7, id) AS k", "id AS v", "IF(id % 5 = 0, NULL, 'x') AS n").write.parquet(str(tmp_path / "f"))
    facts = spark.read.parquet(str(tmp_path / "f"))
    catalog = MartCatalog(spark, str(tmp_path / "c"))
    made = bucketed(facts, "hot", ["k"], 16, 8, catalog)
    held = made.read(spark).filter("k = 7").selectExpr("input_file_name() AS f").groupBy("f").count().collect()
    assert len(held) > 3 and max(r["count"] for r in held) < 700
    small = spark.createDataFrame([(7, "seven"), (8, "eight"), (None, "none")], "k bigint, name string")
    assert equal(facts.join(small, "k"), made.join(spark, small).select("k", "v", "n", "name"))
    again = bucketed(facts, "hot", ["k"], 16, 8, catalog)
    assert again == made
    spark.sql("DROP TABLE " + next(t.name for t in spark.catalog.listTables() if t.name.startswith("bucketed_") and spark.table(t.name).columns[0] == "k"))
    assert again.read(spark).count() == 3000  # as a session that did not write it would
