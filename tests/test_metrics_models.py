"""Metrics against brute force; model fitting sanity."""

import random

from pyspark.sql import functions as F

from hourglass.operators import metrics, models


def brute_auc(ys, ss):
    pos = [s for y, s in zip(ys, ss) if y == 1]
    neg = [s for y, s in zip(ys, ss) if y == 0]
    tot = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
    return tot / (len(pos) * len(neg))


def _scored(spark, seed=0, n=300):
    rnd = random.Random(seed)
    rows = [(i, int(rnd.random() < 0.4), float(rnd.randint(0, 40))) for i in range(n)]  # many ties
    return rows, spark.createDataFrame(rows, "id long, y int, score double")


def test_auc_midrank_ties_and_symmetry(spark):
    rows, df = _scored(spark)
    exp = brute_auc([r[1] for r in rows], [r[2] for r in rows])
    a = metrics.roc_auc(df, "y", "score").first().auc
    b = metrics.roc_auc(df, "y", -F.col("score")).first().auc
    assert abs(a - exp) < 1e-6 and abs(a + b - 1) < 1e-6
    assert metrics.no_skill_auc(df, "y").first().auc == 0.5


def test_auc_single_class_is_null(spark):
    df = spark.createDataFrame([(1, 0.3), (1, 0.5)], "y int, score double")
    assert metrics.roc_auc(df, "y", "score").first().auc is None


def test_running_sums_equal_a_plain_loop(spark):
    rows, df = _scored(spark, 1, 500)
    g = metrics.score_counts(df, "y", "score")
    for buckets, down in ((2, False), (3, True), (64, False)):
        got = sorted(map(tuple, metrics.running_sums(g, "score", ["pos", "neg"], down, buckets).collect()))
        pos = neg = 0
        want = []
        for v in sorted({r[2] for r in rows}, reverse=down):
            p = sum(r[1] for r in rows if r[2] == v)
            n = sum(1 - r[1] for r in rows if r[2] == v)
            pos, neg = pos + p, neg + n
            want.append((v, p, n, pos, neg))
        assert got == sorted(want)


def test_auc_and_curve_of_a_million_distinct_scores(spark):
    df = spark.range(1_000_000).select((F.hash("id") % 3 == 0).cast("int").alias("y"),
                                       (F.xxhash64("id") / F.lit(2.0 ** 63)).alias("score"))
    p = df.toPandas()
    place, y = p.score.rank().to_numpy(), p.y.to_numpy()
    n1 = int(y.sum())
    exact = (place[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(y) - n1))
    assert {metrics.roc_auc(df).first().auc for _ in range(3)} == {round(exact, 6)}
    c = metrics.roc_curve(df).toPandas().sort_values("threshold", ascending=False)
    assert len(c) == 1_000_000 and c.fpr.is_monotonic_increasing and c.tpr.is_monotonic_increasing
    assert c.iloc[-1].fpr == c.iloc[-1].tpr == 1.0


def test_roc_curve_endpoints(spark):
    _, df = _scored(spark, 2)
    pts = metrics.roc_curve(df, "y", "score").orderBy(F.desc("threshold")).collect()
    assert pts[-1].fpr == 1.0 and pts[-1].tpr == 1.0
    assert all(a.fpr <= b.fpr and a.tpr <= b.tpr for a, b in zip(pts, pts[1:]))


def test_confusion_grid_and_report_zero_division(spark):
    df = spark.createDataFrame([(0, 0), (0, 0), (1, 0)], "y int, prediction int")
    grid = {(r.actual, r.predicted): r["count"] for r in metrics.confusion_matrix(df).collect()}
    assert grid == {(0, 0): 2, (0, 1): 0, (1, 0): 1, (1, 1): 0}
    rep = {r.label: r for r in metrics.classification_report(df).collect()}
    assert rep["1"].precision == 0.0 and rep["1"].recall == 0.0 and rep["1"].f1_score == 0.0
    assert rep["0"].precision == round(2 / 3, 6) and rep["accuracy"].f1_score == round(2 / 3, 6)
    assert rep["accuracy"].support == 3


def test_hash_split_repartition_invariant_and_fraction(spark):
    df = spark.range(0, 5000).withColumnRenamed("id", "k")
    a = models.hash_split(df, "k")
    b = models.hash_split(df.repartition(13), "k")
    sa = {r.k for r in a.where("is_test = 1").collect()}
    sb = {r.k for r in b.where("is_test = 1").collect()}
    assert sa == sb and 0.30 < len(sa) / 5000 < 0.36


def test_logistic_separates_planted_signal(spark):
    rnd = random.Random(4)
    rows = [(i, float(x), int(x + rnd.gauss(0, 0.5) > 0)) for i, x in enumerate(rnd.gauss(0, 1) for _ in range(400))]
    df = models.assemble(spark.createDataFrame(rows, "id long, x double, y int"), ["x"])
    m = models.fit_logistic(df, "y")
    p = models.with_probability(m, df)
    assert metrics.roc_auc(p, "y", "probability_1").first().auc > 0.85
    assert m.coefficients[0] > 0


def test_logit_inference_closed_form(spark):
    rows = [("a", 1)] * 30 + [("a", 0)] * 10 + [("b", 1)] * 5 + [("b", 0)] * 15
    df = spark.createDataFrame(rows, "g string, y int")
    t = {r.term: r for r in models.logit_inference(models.one_hot(df, "g", ["a", "b"]), "y", ["a", "b"]).collect()}
    import math
    assert abs(t["a"].coef - math.log(3)) < 1e-3 and abs(t["b"].coef - math.log(1 / 3)) < 1e-3
    assert abs(t["a"].std_err - math.sqrt(1 / 30 + 1 / 10)) < 1e-3


def test_gbt_beats_no_skill(spark):
    rnd = random.Random(5)
    rows = [(i, float(x), int(x > 0.2)) for i, x in enumerate(rnd.random() for _ in range(300))]
    df = models.assemble(spark.createDataFrame(rows, "id long, x double, y int"), ["x"])
    m = models.fit_gbt(df, "y", n_estimators=5, max_depth=2)
    p = models.with_probability(m, df)
    assert metrics.roc_auc(p, "y", "probability_1").first().auc > 0.9


def test_split_of_string_keys(spark):
    df = spark.range(4000).selectExpr("concat('person-', id) AS personid")
    a = models.hash_split(df, "personid")
    share = a.where("is_test = 1").count() / 4000
    assert 0.28 < share < 0.38
    assert a.exceptAll(models.hash_split(df.repartition(7), "personid")).count() == 0
