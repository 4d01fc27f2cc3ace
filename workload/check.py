"""Run every query against its DuckDB twin: python -m workload.check [folder] [name ...]."""

from __future__ import annotations

import math
import sys
import time

import duckdb

from rowassay.session import build_session
from workload import derived as D
from workload.oracle import SQL
from workload.queries import QUERIES


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    return repr(value)


def rows_of(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


def main() -> int:
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:] or list(QUERIES)
    spark = build_session("local[8]")
    spark.sparkContext.setLogLevel("ERROR")
    duck = duckdb.connect()
    for t in D.TABLES:
        duck.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    bad = 0
    for name in wanted:
        started = time.time()
        try:
            df = QUERIES[name](spark, folder)
            got = rows_of(df.columns, df.collect())
        except Exception as error:  # report and go on with the next query
            bad += 1
            print(f"ERROR {name}: {str(error)[:600]}", flush=True)
            continue
        spent = time.time() - started
        if name not in SQL:
            print(f"rows  {name} {len(got)} rows {spent:.1f}s (no SQL)", flush=True)
            continue
        try:
            rel = duck.sql(SQL[name])
            want, columns = rows_of(rel.columns, rel.fetchall()), sorted(rel.columns)
        except Exception as error:
            bad += 1
            print(f"SQL   {name}: {str(error)[:600]}", flush=True)
            continue
        same = columns == sorted(df.columns) and got == want
        bad += not same
        print(f"{'ok   ' if same else 'DIFF '} {name} {len(got)} rows {spent:.1f}s", flush=True)
        if not same:
            print("   columns", sorted(df.columns), columns, len(got), len(want))
            for a, b in [(a, b) for a, b in zip(got, want) if a != b][:3]:
                print("   spark ", str(a)[:400])
                print("   duckdb", str(b)[:400])
    print("bad:", bad, "of", len(wanted))
    return bad


if __name__ == "__main__":
    sys.exit(min(main(), 1))
