"""Runs registered queries next to their SQL twin in DuckDB.

    python tests/oracle_check.py [folder] [name-part ...]
"""

from __future__ import annotations

import datetime
import decimal
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9) + 0.0)
    if isinstance(v, decimal.Decimal):
        return repr(round(float(v), 9) + 0.0)
    if isinstance(v, bool) or v is None:
        return repr(v)
    if isinstance(v, int):
        return repr(float(v)) if abs(v) < 2**53 else repr(v)
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(plain(x) for x in v) + "]"
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{plain(x)}" for k, x in sorted(v.items())) + "}"
    return str(v)


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in rows)


def compare(spark, con, name, fn, sql, folder):
    start = time.time()
    df = fn(spark, folder)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    took = time.time() - start
    if sql is None:
        return ("rows-only" if got[1] else "EMPTY"), len(got[1]), took, ""
    cur = con.execute(sql)
    want = rows_of([d[0] for d in cur.description], cur.fetchall())
    if got[0] != want[0]:
        return "COLUMNS", len(got[1]), took, f"{got[0]} != {want[0]}"
    if got[1] != want[1]:
        a, b = set(got[1]) - set(want[1]), set(want[1]) - set(got[1])
        return "DIFF", len(got[1]), took, f"{len(got[1])} vs {len(want[1])}\n  spark {sorted(a)[:2]}\n  sql   {sorted(b)[:2]}"
    return ("ok" if got[1] else "EMPTY"), len(got[1]), took, ""


def connect(folder):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def main():
    import __spark_entry__ as entry

    from staygrid.session import build_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    parts = sys.argv[2:]
    spark = build_session("check", "local[8]", **{"spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    queries, oracle = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in queries.items():
        if parts and not any(p in name for p in parts):
            continue
        try:
            status, n, took, note = compare(spark, con, name, fn, oracle.get(name), folder)
        except Exception as e:  # report and go on
            status, n, took, note = "ERROR", 0, 0.0, f"{type(e).__name__}: {str(e)[:1500]}"
        if status not in ("ok", "rows-only"):
            bad += 1
        print(f"{status:10s} {name:45s} {n:7d} {took:6.2f}s {note}", flush=True)
    print("bad:", bad, "of", len(queries))
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
