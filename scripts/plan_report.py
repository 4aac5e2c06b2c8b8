"""Summarise the physical plan of each registered query (shuffles, broadcasts,
joins, windows, pushed filters) as a markdown table.

usage: python scripts/plan_report.py [sf_dir] [key ...]  > PLANS.md
"""

from __future__ import annotations

import re
import sys

from hourglass.plans.registry import queries
from hourglass.session import get_session

SKIP = {"feature_table_roundtrip", "logistic_l2", "gbt_fit", "learning_rate_sweep", "grid_search_cv", "grid_best_report",
        "icu_model_metrics", "logit_inference", "category_index", "trim_cascade"}  # eager work at build time


def summarise(plan: str) -> dict[str, int]:
    def n(p):
        return len(re.findall(p, plan))
    return {
        "shuffle": n(r"Exchange hashpartitioning|Exchange rangepartitioning|Exchange SinglePartition"),
        "broadcast": n(r"BroadcastExchange"),
        "smj": n(r"SortMergeJoin"),
        "bhj": n(r"BroadcastHashJoin"),
        "window": n(r"\bWindow \["),
        "cartesian": n(r"CartesianProduct|BroadcastNestedLoopJoin"),
        "scans": n(r"FileScan parquet"),
        "pushed": n(r"PushedFilters: \[[^\]]+\]"),
        "python": n(r"ArrowEvalPython|BatchEvalPython|FlatMapGroupsInPandas"),
    }


def main(argv: list[str]) -> None:
    sf = argv[0] if argv else "/root/testdata/sf0.01"
    spark = get_session(shuffle_partitions=8)
    keys = argv[1:] or [k for k in queries() if k not in SKIP]
    cols = ["shuffle", "broadcast", "smj", "bhj", "window", "cartesian", "scans", "pushed", "python"]
    print("| query | " + " | ".join(cols) + " |")
    print("| --- | " + " | ".join("---" for _ in cols) + " |")
    for k in keys:
        df = queries()[k](spark, sf)
        plan = df._jdf.queryExecution().executedPlan().toString()
        s = summarise(plan)
        print(f"| `{k}` | " + " | ".join(str(s[c]) for c in cols) + " |", flush=True)


if __name__ == "__main__":
    main(sys.argv[1:])
