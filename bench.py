"""Benchmark: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is fully evaluated with the ``noop`` sink (every row produced,
nothing collected).  Prints ONE JSON line:
{"metric": "total_query_seconds", "value": N, "unit": "sec", "queries": {...}, "sf": ...}
Set BENCH_QUERIES=all to time every registered query.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "condition_matrix", "condition_prevalence", "pediatric_icu_cohort", "demographic_profile",
    "patient_features", "panel_inner", "panel_outer", "panel_from_long", "icu_label_pairs",
    "icu_label_next", "first_observation", "trim_cascade", "boxplot_stats", "lab_wide_sum",
    "lab_wide_latest", "lab_positive_flag", "encounters_after_first_qualifying", "pediatric_crosstab",
    "drug_during_procedure", "tenant_semi_join", "roc_auc", "roc_curve", "icu_model_metrics",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8))
    from hourglass.plans.registry import queries
    from hourglass.session import get_session

    spark = get_session(master=f"local[{cpus}]", app="hourglass-bench", shuffle_partitions=2 * cpus,
                        extra={"spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "16g")})
    reg = queries()
    names = list(reg) if os.environ.get("BENCH_QUERIES") == "all" else [
        n for n in (os.environ.get("BENCH_QUERIES") or ",".join(HEADLINE)).split(",") if n in reg]
    # warm the JVM outside the timed region: class loading, parquet reader, codegen, one shuffle and one
    # broadcast join, on the two tiny dimension tables only (no measured table is touched)
    from pyspark.sql import functions as F
    region = spark.read.parquet(f"{sf_dir}/region.parquet")
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    (nation.join(region, nation.n_regionkey == region.r_regionkey)
     .groupBy("r_name").agg(F.count(F.lit(1)), F.max(F.regexp_replace("n_name", "[^A-Z]", "")))
     .write.format("noop").mode("overwrite").save())
    times: dict[str, float] = {}
    for n in names:
        t0 = time.perf_counter()
        reg[n](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[n] = round(time.perf_counter() - t0, 3)
        print(f"# {n}: {times[n]}s", file=sys.stderr, flush=True)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(m.group(1)) if m else sf_dir}))


if __name__ == "__main__":
    main()
