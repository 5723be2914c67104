"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR names the tables (default sf0.1), BENCH_CPUS the local cores. Each query runs in full into a
sink that discards the rows: once cold, then again; ``queries`` holds the second time, ``cold`` the first.
"""

from __future__ import annotations

import json
import os
import re
import time

from fleetlens.plans.registry import load
from fleetlens.session import local_session

HEADLINE = (
    "T1_dedup_tickets", "T2_ticket_kpis", "T3_sla_kpis", "T3_sla_kpis_filtered", "T4_breach_by_category", "T6_sla_worklist_page",
    "T7_monthly_trend", "T14_center_tickets", "T15_center_failures", "U2_merged_intervals", "U8_fleet_uptime", "U7_reliability",
    "N1_center_kpis", "N6_breakdown", "N11_center_360", "N12_center_explorer", "D1_device_index", "D5_batch_cohorts",
    "D7_telemetry_kpis", "D12_telemetry_explorer", "V1_service_kpis", "V2_service_flow", "V5_service_explorer", "V9_escalation_explorer",
    "R3_customers_tree", "R4_devices_tree", "R5_tickets_tree", "R6_accounts", "G4_map_points", "P1_column_profile_distinct",
    "L1_usage_by_center", "L3_latest_device", "L16_build_support_tickets", "L18_build_register",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session()
    registered = load()

    def timed(name: str) -> float:
        started = time.perf_counter()
        registered[name].run(spark, folder).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - started, 3)

    cold = {name: timed(name) for name in HEADLINE}
    warm = {name: timed(name) for name in HEADLINE}
    scale = re.search(r"sf([0-9.]+)", folder)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(warm.values()), 3), "unit": "sec", "queries": warm,
        "cold": cold, "cold_total": round(sum(cold.values()), 3), "sf": float(scale.group(1)) if scale else folder,
    }))


if __name__ == "__main__":
    main()
