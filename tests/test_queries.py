"""Registered queries against their check SQL, on the smallest tables.

A sample runs by default; FLEETLENS_ALL_QUERIES=1 runs every one (so does check.py, at any scale).
"""

from __future__ import annotations

import glob
import os
import re

import duckdb
import pytest

import __spark_entry__
from check import rows_of
from conftest import SMALL
from fleetlens.plans.registry import load
from fleetlens.sources.proxy import BASE_TABLES, view

SAMPLE = (
    "T1_dedup_tickets", "T2_ticket_kpis_filtered", "T3_sla_kpis", "T6_sla_worklist_page", "T15_center_failures", "U2_merged_intervals",
    "U7_reliability", "N1_center_kpis", "N6_breakdown", "N11_center_360", "D1_device_index", "D5_batch_cohorts", "D12_telemetry_explorer",
    "V1_service_kpis", "V2_service_flow", "V9_escalation_explorer", "R3_customers_tree", "R6_account_totals", "G3_coverage", "G4_map_points",
    "P1_column_profile", "P3_service_customer_keys", "L8_custom_fields", "L9_config_columns", "L15_build_heartbeats", "L18_build_register",
    "F4_center_attributes", "J7_serial_map", "X6_find_centers",
)
QUERIES = load()
CHOSEN = [n for n in QUERIES if QUERIES[n].sql] if os.environ.get("FLEETLENS_ALL_QUERIES") else SAMPLE


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SMALL}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", CHOSEN)
def test_query_matches_its_check(spark, duck, name):
    df = QUERIES[name].run(spark, SMALL)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    result = duck.execute(QUERIES[name].oracle())
    assert got == rows_of([d[0] for d in result.description], result.fetchall())


def test_every_operator_has_a_query():
    wanted = {"S": 8, "L": 18, "F": 13, "C": 17, "J": 11, "T": 18, "U": 11, "N": 12, "D": 14, "V": 9, "R": 6, "G": 6, "X": 6, "P": 8}
    have = {re.match(r"[A-Z]\d+", n).group() for n in QUERIES}
    assert have == {f"{letter}{i}" for letter, n in wanted.items() for i in range(1, n + 1)}


def test_entry_contract(spark):
    row = __spark_entry__.entry(spark).first()
    assert row.scored > 0 and 0 <= row.avg_uptime <= 100
    queries, checks = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(QUERIES) <= set(queries) and all(n in checks for n in QUERIES)


@pytest.mark.parametrize("name", ("T3_sla_kpis_filtered", "N11_center_360", "G4_map_points", "R6_account_totals", "L9_config_columns", "V1_service_kpis"))
def test_plans_hold_no_cross_join_and_no_python(spark, name):
    plan = QUERIES[name].run(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "MapInPandas", "FlatMapGroupsInPandas"):
        assert bad not in plan


def test_building_a_query_starts_no_job(spark):
    for table in BASE_TABLES:  # the schema of a file is looked up once a process
        view(spark, SMALL, table)
    # Some write marts, or look up the version of those they read.
    marts = ("S8_", "N12_", "R2_", "R3_", "R6_", "G4_", "G6_", "T3_sla_kpis_filtered", "T5_", "T6_", "X1_search", "X6_", "P8_section_health")
    for name in QUERIES:
        if not name.startswith(marts):
            spark.sparkContext.setJobGroup(f"build {name}", name)
            QUERIES[name].run(spark, SMALL)
    spark.sparkContext.setJobGroup("after", "after")
    busy = [n for n in QUERIES if spark.sparkContext.statusTracker().getJobIdsForGroup(f"build {n}")]
    assert busy == []
