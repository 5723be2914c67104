"""Large facts are thinned by a Bloom filter of the centers that pass."""

from __future__ import annotations

from fleetlens.filters import Filters, by_center
from helpers import rows


def test_facts_meet_a_bloom_filter_of_the_centers(spark, tables, tmp_path):
    for name in ("center_details", "support_tickets"):
        tables.scan(name).write.parquet(f"{tmp_path}/{name}")
    t = tables.replacing({name: spark.read.parquet(f"{tmp_path}/{name}") for name in ("center_details", "support_tickets")})
    wanted = Filters(segments=("LE",), states=("State 3", "State 4"))
    settings = {
        "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "1", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false",
    }
    old = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        found = by_center(t.tickets, t, wanted).select("ticketNumber", "CenterID")
        assert "might_contain" in found._jdf.queryExecution().executedPlan().toString()
        passing = {r.CenterID for r in t.centers.filter(wanted.center()).select("CenterID").collect()}
        want = sorted((r.ticketNumber or -1, r.CenterID) for r in t.tickets.select("ticketNumber", "CenterID").collect() if r.CenterID in passing)
        assert want and rows(found.fillna(-1)) == want
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
