"""Panel join policies and exact statistics (§2.13 #3, #4, #20; FIXTURES §3)."""

import datetime as dt
import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from hourglass.operators import panel, pivot, profile

H = dt.datetime(2024, 1, 1, 5)
K = "personid long, encounterid long, hour_mark timestamp_ntz"


def _tables(spark):
    a = spark.createDataFrame([(1, 1, H, "60"), (1, 1, H + dt.timedelta(hours=1), "61")], K + ", a string")
    b = spark.createDataFrame([(1, 1, H, "12")], K + ", b string")
    c = spark.createDataFrame([(1, 1, H, "97"), (2, 2, H, "98")], K + ", c string")
    return [a, b, c]


def test_join_policies(spark):
    t = _tables(spark)
    assert panel.panel_join(t, policy="inner").count() == 1
    outer = panel.panel_join(t, policy="outer")
    spine = panel.panel_join(t, policy="spine")
    assert outer.count() == spine.count() == 3
    assert sorted(map(tuple, outer.collect())) == sorted(map(tuple, spine.select(*outer.columns).collect()))
    # UNION ALL spine (as written): one output row per key row of every table -> 2 + 1 + 2
    assert panel.panel_join(t, policy="spine", spine_distinct=False).count() == 5


def test_from_long_equals_joins(spark):
    t = _tables(spark)
    long = None
    for name, df in zip("abc", t):
        d = df.select("personid", "encounterid", "hour_mark", F.lit(name).alias("vital"), F.col(name).alias("value"))
        long = d if long is None else long.unionByName(d)
    for pol in ("inner", "outer"):
        a = sorted(map(tuple, panel.panel_join(t, policy=pol).collect()))
        b = sorted(map(tuple, panel.panel_from_long(long, list("abc"), policy=pol).collect()))
        assert a == b


def test_pivot_fixed_reports_unseen_values(spark):
    df = spark.createDataFrame([(1, "x"), (1, None), (2, "y")], "k int, v string")
    out = pivot.pivot_indicator(df, ["k"], "v", [None, "x", "y", "z"])
    assert out.columns == ["k", "null", "x", "y", "z"]
    assert sorted(map(tuple, out.collect())) == [(1, 1, 1, 0, 0), (2, 0, 0, 1, 0)]


def test_trim_cascade_matches_pandas_sequential(spark):
    rnd = np.random.default_rng(3)
    pdf = pd.DataFrame({"a": rnd.integers(0, 30, 200), "b": rnd.integers(50, 60, 200)})
    exp = pdf.copy()
    for c in ("a", "b"):
        lo, hi = exp[c].quantile(0.01), exp[c].quantile(0.99)
        exp = exp[(exp[c] < hi) & (exp[c] > lo)]
    got = profile.trim_cascade(spark.createDataFrame(pdf), ["a", "b"]).toPandas()
    assert sorted(map(tuple, got.values)) == sorted(map(tuple, exp.values))


def test_quantile_bounds_match_pandas(spark):
    vals = [random.Random(1).random() * 100 for _ in range(101)]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    r = profile.quantile_bounds(df, ["x"]).first()
    s = pd.Series(vals)
    assert abs(r.q_low - s.quantile(0.01)) < 1e-9 and abs(r.q_high - s.quantile(0.99)) < 1e-9


def test_histogram_matches_numpy(spark):
    vals = [random.Random(2).randint(-3, 20) for _ in range(300)]
    df = spark.createDataFrame([(v,) for v in vals], "age int")
    got = [r["count"] for r in profile.histogram(df, "age", 18).orderBy("bin").collect()]
    exp, _ = np.histogram(vals, bins=18)
    assert got == list(exp)
    got_nonneg = [r["count"] for r in profile.histogram(df, "age", 18, drop_negative=True).orderBy("bin").collect()]
    assert got_nonneg == list(np.histogram([v for v in vals if v >= 0], bins=18)[0])


def test_null_profile_and_complete_cases(spark):
    df = spark.createDataFrame([(1, None, 2.0), (None, "a", float("nan")), (3, "b", 1.0)], "x int, y string, z double")
    got = {r.column: r.n_null for r in profile.null_profile(df).collect()}
    assert got == {"x": 1, "y": 1, "z": 0}
    assert profile.complete_cases(df).count() == 1  # NaN dropped as pandas dropna does


def test_box_stats(spark):
    vals = list(range(1, 21)) + [100]
    df = spark.createDataFrame([(0, v) for v in vals], "g int, v int")
    r = profile.box_stats(df, ["v"], "g").first()
    s = pd.Series(vals, dtype=float)
    q1, q3 = s.quantile(0.25), s.quantile(0.75)
    assert (r.q1, r.q3, r.median) == (q1, q3, s.quantile(0.5))
    assert r.n_outliers == 1 and r.whisker_high == 20 and r.whisker_low == 1


def test_quantiles_of_a_million_distinct_values(spark):
    df = spark.range(1_000_000).select((F.xxhash64("id") / F.lit(2.0 ** 63)).alias("a"), F.col("id").alias("b"))
    got = {r["column"]: (r.q_low, r.q_high) for r in profile.quantile_bounds(df, ["a", "b"]).collect()}
    p = df.toPandas()
    for c in ("a", "b"):
        assert np.allclose(got[c], p[c].quantile([0.01, 0.99]), rtol=1e-12, atol=0)
