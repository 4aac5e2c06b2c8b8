"""Scale guards on the physical plans of every registered query: no cartesian /
nested-loop joins, no Python UDF operators, and projection pushdown into the scans."""

import re

import pytest

from hourglass.plans.registry import queries

SF = "/root/testdata/sf0.001"
EAGER = {"feature_table_roundtrip", "logistic_l2", "gbt_fit", "learning_rate_sweep", "grid_search_cv", "grid_best_report", "logit_model_input", "logit_threshold_table",
         "icu_model_metrics", "logit_inference", "category_index", "trim_cascade"}


@pytest.mark.parametrize("key", sorted(k for k in queries() if k not in EAGER))
def test_plan_has_no_pairs_or_python(spark, key):
    plan = queries()[key](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"CartesianProduct|BroadcastNestedLoopJoin", plan), key
    assert not re.search(r"BatchEvalPython|ArrowEvalPython|FlatMapGroupsInPandas|MapInPandas", plan), key


def test_scan_prunes_columns_and_pushes_filters(spark):
    plan = queries()["scan_parquet"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThanOrEqual(l_quantity,45.0)]" in plan
    read_schema = re.search(r"ReadSchema: struct<([^>]*)>", plan).group(1)
    assert read_schema.count(":") == 3  # only the three projected columns are read


def test_join_of_a_large_table_is_dealt_by_its_size(spark, tmp_path, monkeypatch):
    """The tasks of the join and of the distinct count after it hold a bounded piece of the table; the rows stay the same."""
    from hourglass.sources import tables
    items = [(i // 4 if i % 9 else None, i % 7, i % 7 + 1, float(i % 5 + 1), "RNA"[i % 3], "FO"[i % 2]) for i in range(400)]
    names = "l_orderkey long, l_partkey long, l_linenumber int, l_quantity double, l_returnflag string, l_linestatus string"
    spark.createDataFrame(items * 2, names).write.parquet(str(tmp_path / "lineitem.parquet"))
    orders = [(i, i % 3) for i in range(90)] + [(None, 1), (5, 2)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long").write.parquet(str(tmp_path / "orders.parquet"))
    query = queries()["top_k_concepts"]
    small = query(spark, str(tmp_path))
    assert "REPARTITION_BY_NUM" not in small._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(tables, "PART_BYTES", -(-tables.bytes_of(spark, str(tmp_path / "lineitem.parquet")) // 37))
    large = query(spark, str(tmp_path))
    plan = large._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"hashpartitioning\(l_orderkey#\d+L, 3[67]\), REPARTITION_BY_NUM", plan)
    assert large.collect() == small.collect()
