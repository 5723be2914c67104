"""Run registered queries on Spark and their checks on DuckDB, and compare: python check.py [sf_dir] [name prefix ...]"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

from fleetlens.plans.registry import load
from fleetlens.session import local_session


def canonical(value: object) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return "NULL" if math.isnan(value) else repr(round(value, 9) + 0.0)
    if isinstance(value, int):
        return repr(float(value))
    return str(value) if not hasattr(value, "as_tuple") else repr(round(float(value), 9) + 0.0)


def rows_of(columns: list[str], rows: list[tuple]) -> list[str]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted("|".join(canonical(r[i]) for i in order) for r in rows)


def main(folder: str, prefixes: list[str]) -> int:
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    spark = local_session()
    if os.environ.get("CHECK_TIME_ZONE"):
        spark.conf.set("spark.sql.session.timeZone", os.environ["CHECK_TIME_ZONE"])
    failed = []
    for name, q in load().items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        started = time.time()
        try:
            df = q.run(spark, folder)
            got = rows_of(df.columns, [tuple(r) for r in df.collect()])
            took = time.time() - started
            if q.sql is None:
                print(f"{name}: rows {len(got)} (no check) {took:.1f}s", flush=True)
                continue
            result = con.execute(q.oracle())
            names = [d[0] for d in result.description]
            types = {d[0]: str(d[1]) for d in result.description}
            want = rows_of(names, result.fetchall())
            odd = [c for c, t in types.items() if "HUGEINT" in t or "DECIMAL" in t or "INT128" in t]
            if sorted(names) != sorted(df.columns):
                failed.append(name)
                print(f"{name}: COLUMNS {sorted(set(names) ^ set(df.columns))}", flush=True)
            elif got != want:
                failed.append(name)
                left, right = sorted(set(got) - set(want)), sorted(set(want) - set(got))
                print(f"{name}: DIFFERENT rows {len(got)}/{len(want)} spark {left[:3]} check {right[:3]}", flush=True)
            else:
                print(f"{name}: ok {len(got)} rows {took:.1f}s {'types ' + str(odd) if odd else ''}", flush=True)
        except Exception as error:  # report and go on with the next query
            failed.append(name)
            print(f"{name}: ERROR {str(error)[:700]}", flush=True)
    print("failed:", failed)
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01", sys.argv[2:]))
