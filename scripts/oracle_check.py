"""Run each registered query on Spark and its SQL oracle on DuckDB and compare
column names, row counts and (order-insensitive) values.

usage: python scripts/oracle_check.py [sf_dir] [key ...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import sys
import time
from collections import Counter

import duckdb

from hourglass.plans.oracle import oracle_sql
from hourglass.plans.registry import queries
from hourglass.session import get_session
from hourglass.sources.tables import DRIVER_TABLES


def cell(v, digits=None):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, digits) if digits is not None else v
    if isinstance(v, decimal.Decimal):
        return ("DECIMAL", float(v))
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat(" ")
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, bool):
        return int(v)
    return v


def main(argv: list[str]) -> int:
    sf = argv[0] if argv else "/root/testdata/sf0.01"
    sqls = oracle_sql()
    keys = argv[1:] or list(sqls)
    spark = get_session(shuffle_partitions=8)
    con = duckdb.connect()
    for t in DRIVER_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    bad = []
    for k in keys:
        t0 = time.time()
        try:
            sdf = queries()[k](spark, sf)
            scols = sdf.columns
            srows = [tuple(r) for r in sdf.collect()]
            cur = con.execute(sqls[k])
            dcols = [d[0] for d in cur.description]
            drows = cur.fetchall()
        except Exception as e:  # noqa: BLE001
            bad.append(k)
            print(f"{k:36s} ERROR {type(e).__name__}: {str(e)[:600]}", flush=True)
            continue
        order_s = sorted(range(len(scols)), key=lambda i: scols[i])
        order_d = sorted(range(len(dcols)), key=lambda i: dcols[i])
        names_ok = sorted(scols) == sorted(dcols)
        status = []
        if not names_ok:
            status.append(f"COLS spark={sorted(scols)} duck={sorted(dcols)}")
        if len(srows) != len(drows):
            status.append(f"ROWS spark={len(srows)} duck={len(drows)}")
        exact = Counter(tuple(cell(r[i]) for i in order_s) for r in srows) == \
            Counter(tuple(cell(r[i]) for i in order_d) for r in drows)
        if not exact:
            close = Counter(tuple(cell(r[i], 6) for i in order_s) for r in srows) == \
                Counter(tuple(cell(r[i], 6) for i in order_d) for r in drows)
            status.append("VALUES~close" if close else "VALUES")
            if not close:
                a = Counter(tuple(cell(r[i], 6) for i in order_s) for r in srows)
                b = Counter(tuple(cell(r[i], 6) for i in order_d) for r in drows)
                print("   spark-only:", list((a - b).items())[:2])
                print("   duck-only :", list((b - a).items())[:2])
        types = [(scols[i], type(cell(srows[0][i])).__name__ if srows else "-",
                  type(cell(drows[0][j])).__name__ if drows else "-")
                 for i, j in zip(order_s, order_d)] if names_ok else []
        tdiff = [x for x in types if x[1] != x[2] and "NoneType" not in x[1:]]
        if tdiff:
            status.append(f"TYPES {tdiff[:3]}")
        if status:
            bad.append(k)
        print(f"{k:36s} rows={len(srows):7d} {time.time() - t0:6.2f}s {'OK' if not status else ' | '.join(status)}",
              flush=True)
    print(f"{len(keys) - len(bad)}/{len(keys)} match; bad: {bad}")
    return len(bad)


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
