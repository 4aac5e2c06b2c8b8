"""Check that every lens table is identical in Spark and in its DuckDB rendering.

usage: python scripts/lens_check.py [sf_dir]
"""

from __future__ import annotations

import datetime as dt
import sys
from collections import Counter

import duckdb

from hourglass.plans import lens_sql
from hourglass.session import get_session
from hourglass.sources import lens
from hourglass.sources.tables import DRIVER_TABLES


def norm(v):
    if hasattr(v, "asDict"):
        v = v.asDict(recursive=True)
    if isinstance(v, dict):
        return tuple(sorted((k.lower(), norm(x)) for k, x in v.items()))
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, float):
        return round(v, 9)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat(" ")
    if isinstance(v, dt.date):
        return v.isoformat()
    return v


def main(sf_dir: str) -> int:
    spark = get_session(shuffle_partitions=8)
    con = duckdb.connect()
    for t in DRIVER_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    pairs = {
        "demographics": lens.demographics(spark, sf_dir),
        "patient_demographics": lens.patient_demographics(spark, sf_dir),
        "encounter": lens.encounter(spark, sf_dir),
        "encounter_locations": lens.encounter_locations(spark, sf_dir),
        "qualified_encounter": lens.qualified_encounter(spark, sf_dir),
        "condition": lens.condition(spark, sf_dir),
        "lab": lens.lab(spark, sf_dir),
        "medication": lens.medication(spark, sf_dir),
        "medication_administration": lens.medication_administration(spark, sf_dir),
        "procedure": lens.procedure(spark, sf_dir),
        "locations": lens.locations(spark, sf_dir),
        "vitals_long": lens.vitals_long(spark, sf_dir),
        "scored_documents": lens.scored_documents(spark, sf_dir),
    }
    for n in lens.VITALS:
        pairs[f"vital_{n}"] = lens.vital_table(spark, sf_dir, n)
    bad = 0
    for name, sdf in pairs.items():
        cols = sdf.columns
        s_rows = Counter(tuple(norm(r[c]) for c in cols) for r in sdf.collect())
        cur = con.execute(lens_sql.with_lens(f"SELECT {', '.join(cols)} FROM {name}", name))
        d_rows = Counter(tuple(norm(x) for x in r) for r in cur.fetchall())
        ok = s_rows == d_rows
        bad += not ok
        print(f"{name:28s} spark={sum(s_rows.values()):7d} duckdb={sum(d_rows.values()):7d} {'OK' if ok else 'DIFF'}")
        if not ok:
            print("  only spark :", list((s_rows - d_rows).items())[:2])
            print("  only duckdb:", list((d_rows - s_rows).items())[:2])
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"))
