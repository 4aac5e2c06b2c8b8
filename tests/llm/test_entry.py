"""The entry registers every operator, and SQL results agree on the smallest tables."""

import re
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as E
from hourglass.llm.queries import oracle_sql, queries

SF = "/root/testdata/sf0.001"


def test_registered():
    names = [k for k in E.queries() if re.match(r"op\d+_", k)]
    assert sorted(int(re.match(r"op(\d+)_", k)[1]) for k in names) == list(range(1, 14))
    assert set(queries()) == set(names) and "pipeline" in E.queries() and set(oracle_sql()) <= set(names)


def cell(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    cur = con.execute(oracle_sql()[name])
    columns = [d[0] for d in cur.description]
    want = Counter(tuple(map(cell, r)) for r in cur.fetchall())
    got = queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    assert Counter(tuple(map(cell, r)) for r in got.select(*columns).collect()) == want
