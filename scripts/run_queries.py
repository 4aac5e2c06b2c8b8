"""Run registered queries and print rows / seconds / schema.

usage: python scripts/run_queries.py [sf_dir] [key ...]
"""

from __future__ import annotations

import sys
import time
import traceback

from hourglass.plans.registry import queries
from hourglass.session import get_session


def main(argv: list[str]) -> int:
    sf = argv[0] if argv else "/root/testdata/sf0.01"
    keys = argv[1:] or list(queries())
    spark = get_session(shuffle_partitions=8)
    bad = 0
    for k in keys:
        t = time.time()
        try:
            df = queries()[k](spark, sf)
            n = df.count()
            print(f"{k:36s} rows={n:7d} {time.time() - t:6.2f}s {df.schema.simpleString()[:160]}", flush=True)
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"{k:36s} ERROR {type(e).__name__}: {str(e)[:400]}", flush=True)
            traceback.print_exc(limit=3)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
