"""Newton fit from Gram sums against a plain numpy Newton; aliased and separated terms by name."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from hourglass.operators import logit


def frame(spark, x, y, names):
    return spark.createDataFrame([(*map(float, r), int(v)) for r, v in zip(x, y, strict=True)],
                                 ", ".join(f"`{n}` double" for n in names) + ", y int").repartition(3)


def newton(x, y):
    b = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ b))
        h = (x * (p * (1 - p))[:, None]).T @ x
        b = b + np.linalg.solve(h, x.T @ (y - p))
    return b, np.sqrt(np.diag(np.linalg.inv(h)))


def data(n=400, k=25, seed=1):
    r = np.random.default_rng(seed)
    x = np.concatenate([r.normal(100, 10, (n, 3)), (r.random((n, k - 3)) < 0.4)], axis=1)
    y = (r.random(n) < 1 / (1 + np.exp(-(x[:, 3] - x[:, 4] + 0.02 * (x[:, 0] - 100))))).astype(int)
    return x, y


@pytest.mark.parametrize("intercept", [False, True])
def test_25_terms_equal_newton(spark, intercept):
    x, y = data()
    names = [f"t {i}" for i in range(25)]
    m = logit.fit(frame(spark, x, y, names), "y", names, intercept)
    b, e = newton(np.concatenate([x, np.ones((len(x), 1))], axis=1) if intercept else x, y)
    assert list(m.status.values()) == ["ok"] * len(b)
    assert np.allclose(list(m.coef.values()), b, atol=1e-6) and np.allclose(list(m.error.values()), e, atol=1e-6)
    p = frame(spark, x, y, names).withColumn("p", m.probability()).select(F.sum("p")).first()[0]
    assert p == pytest.approx((1 / (1 + np.exp(-x @ b[:25] - (b[25] if intercept else 0)))).sum())
    row = m.table(frame(spark, x, y, names)).where("term = 't 3'").first()
    assert row["p_value"] == round(math.erfc(abs(b[3] / e[3]) / math.sqrt(2)), 4)


def test_aliased_and_separated_terms(spark):
    x, y = data(300, 6)
    only = np.where((y == 1) & (np.arange(300) % 7 == 0), 1.0, 0.0)  # stands beside label 1 alone
    wide = np.column_stack([x, x[:, 3] + 2 * x[:, 4], np.zeros(300), only])
    names = ["a", "b", "c", "d", "e", "f", "sum", "zero", "only"]
    m = logit.fit(frame(spark, wide, y, names), "y", names)
    assert {t: s for t, s in m.status.items() if s != "ok"} == {"sum": "aliased", "zero": "aliased", "only": "separated"}
    rest = only == 0
    b, e = newton(x[rest], y[rest])
    assert np.allclose([m.coef[t] for t in names[:6]], b, atol=1e-6) and np.allclose([m.error[t] for t in names[:6]], e, atol=1e-6)
    p = frame(spark, wide, y, names).withColumn("p", m.probability())
    assert p.where("only = 1 AND p <> 1").count() == 0 and p.where("p IS NULL").count() == 0
    table = {r["term"]: r for r in m.table(p).collect()}
    assert table["sum"]["coef"] is None and table["only"]["std_err"] is None and len(table) == 9


def test_labels_separated_by_a_combination(spark):
    x = np.array([[a, b] for a in (-2.0, -1.0, 1.0, 2.0) for b in (-2.0, -1.0, 1.0, 2.0) if a + b])
    y = (x.sum(axis=1) > 0).astype(int)
    m = logit.fit(frame(spark, x, y, ["a", "b"]), "y", ["a", "b"])
    assert m.status == {"a": "separated", "b": "separated"} and m.coef == {}


def test_no_rows_and_incomplete_rows(spark):
    x, y = data(200, 5)
    names = list("abcde")
    df = frame(spark, x, y, names)
    assert set(logit.fit(df.where("a < 0"), "y", names).status.values()) == {"no rows"}
    gaps = df.unionByName(df.limit(5).withColumn("a", F.lit(None).cast("double"))).unionByName(df.limit(5).withColumn("b", F.lit(float("nan"))))
    assert np.allclose(list(logit.fit(gaps, "y", names).coef.values()), list(logit.fit(df, "y", names).coef.values()))
