"""Every registered query against its DuckDB oracle on the smallest driver tables,
plus the driver contract of ``__spark_entry__``."""

import datetime as dt
import decimal
import os
import re
import shutil
import subprocess
import sys
from collections import Counter
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as E
from hourglass.plans.oracle import oracle_sql as registry_oracle
from hourglass.sources.tables import DRIVER_TABLES

SF = "/root/testdata/sf0.001"


def _cell(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, decimal.Decimal):
        return ("DECIMAL", float(v))
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat(" ")
    if isinstance(v, dt.date):
        return v.isoformat()
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in DRIVER_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def test_contract_keys():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 80
    unchecked = {k for k in set(q) - set(o) if k != "pipeline" and not re.match(r"op\d+_", k)}
    assert unchecked == {"gbt_fit", "learning_rate_sweep", "grid_search_cv", "grid_best_report", "icu_model_metrics",
                         "logit_model_input", "logit_threshold_table"}


@pytest.mark.parametrize("key", sorted(registry_oracle()))
def test_query_matches_oracle(spark, duck, key):
    sdf = E.queries()[key](spark, SF)
    cols = sdf.columns
    srows = sdf.collect()
    cur = duck.execute(E.oracle_sql()[key])
    dcols = [d[0] for d in cur.description]
    drows = cur.fetchall()
    assert sorted(cols) == sorted(dcols)
    si = sorted(range(len(cols)), key=lambda i: cols[i])
    di = sorted(range(len(dcols)), key=lambda i: dcols[i])
    assert Counter(tuple(_cell(r[i]) for i in si) for r in srows) == \
        Counter(tuple(_cell(r[i]) for i in di) for r in drows)


def test_entry_without_training_data_operators(tmp_path):
    """A copy without the optional folders still imports and lists the core queries, with and without the pipeline file."""
    root = Path(E.__file__).parent
    shutil.copytree(root / "hourglass", tmp_path / "hourglass", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    script = "import __spark_entry__ as E; q = E.queries(); assert set(E.oracle_sql()) <= set(q); print(len(q), any(k[:2] == 'op' and k[2].isdigit() for k in q))"
    said = []
    for extra in (False, True):
        if extra:
            (tmp_path / "corpus_pipeline.py").write_text("from hourglass.llm import packing\n")
        said.append(subprocess.run([sys.executable, "-c", script], cwd=tmp_path, capture_output=True, text=True, check=True,
                                   env={**os.environ, "PYTHONPATH": ""}).stdout.split())
    core = [k for k in E.queries() if k != "pipeline" and not re.match(r"op\d+_", k)]
    assert said == [[str(len(core)), "False"]] * 2


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["metric", "value"]
    assert df.count() > 0
