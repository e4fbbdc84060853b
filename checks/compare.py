"""Run checked queries on Spark and DuckDB and compare rows: ``python -m checks.compare [sf] [name ...]``."""

from __future__ import annotations

import sys
import time
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def normal(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, float):
        return float(f"{value:.12g}")
    if type(value).__name__ == "Decimal":
        return float(value)
    if isinstance(value, (list, tuple)):
        return tuple(normal(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((k, normal(v)) for k, v in value.items()))
    return value


def rows_of(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(normal(row[i]) for i in order) for row in rows)


def compare(spark, check, folder: str, con) -> tuple[bool, str, float]:
    from checks.views import Views

    start = time.time()
    frame = check.query(Views(spark, folder))
    got = rows_of(frame.columns, [tuple(r) for r in frame.collect()])
    took = time.time() - start
    oracle = check.oracle_sql()
    if oracle is None:
        return sum(got.values()) > 0, f"rows only: {sum(got.values())}", took
    start = time.time()
    cursor = con.execute(oracle)
    names = [d[0] for d in cursor.description]
    want = rows_of(names, cursor.fetchall())
    if sorted(names) != sorted(frame.columns):
        return False, f"columns {sorted(frame.columns)} / {sorted(names)}", took
    if got != want:
        return False, (f"{sum(got.values())} / {sum(want.values())} rows\n   spark only {list((got - want).items())[:2]}"
                       f"\n   duck only  {list((want - got).items())[:2]}"), took
    return True, f"{sum(got.values())} rows (duckdb {time.time() - start:.1f}s)", took


def main() -> int:
    from checks.catalog import CHECKS
    from tasklore.session import build_session

    args = sys.argv[1:] or ["0.01"]
    folder, names = f"/root/testdata/sf{args[0]}", args[1:]
    spark = build_session(**{"spark.ui.enabled": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    con.execute("SET threads = 4")
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet')")
    failed = []
    for check in CHECKS.values():
        if names and not any(check.name.startswith(n) for n in names):
            continue
        try:
            good, note, took = compare(spark, check, folder, con)
        except Exception as error:
            good, note, took = False, f"{type(error).__name__}: {str(error)[:600]}", 0.0
        print(f"{'ok  ' if good else 'FAIL'} {check.name:28s} {took:6.1f}s {note}", flush=True)
        if not good:
            failed.append(check.name)
    print("failed:", failed)
    return len(failed)


if __name__ == "__main__":
    sys.exit(main())
