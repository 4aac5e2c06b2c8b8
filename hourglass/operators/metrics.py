"""Classifier evaluation as DataFrame queries.  [K5-K10 K15]

Rank-based metrics (ROC AUC, ROC curve) need counts accumulated in score
order.  Rows are first collapsed to one row per distinct score (partial
aggregation) and written to the checkpoint folder once.  The running sums are
then computed bucket-wise: at most ``BUCKETS`` bounds are read off the scores
and enter the plan as literals, so the bucket is a function of the score alone,
each bucket is accumulated by its own window task, and bucket offsets come from
a window over at most ``BUCKETS`` rows.  The bounds only spread the work: sums
are exact wherever they lie.  No step puts all scores into one task.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

BUCKETS = 256


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def running_sums(df: DataFrame, order: str, cols: Sequence[str], descending: bool = False,
                 buckets: int = BUCKETS, prefix: str = "cum_", by: Sequence[str] = ()) -> DataFrame:
    """Inclusive running sums of ``cols`` in ``order`` (one row per distinct ``order`` value), for each group of ``by``."""
    o = (-F.col(order) if descending else F.col(order)).cast("double")
    d = df.withColumn("_o", o)
    d = d.withColumn("_bucket", _bucket(F.col("_o"), _bounds(d, "_o", buckets)))
    tot = d.groupBy(*by, "_bucket").agg(*[F.sum(c).alias(f"_t_{c}") for c in cols])
    wo = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = tot.select(*by, "_bucket", *[F.coalesce(F.sum(f"_t_{c}").over(wo), F.lit(0)).alias(f"_off_{c}")
                                      for c in cols])
    wi = Window.partitionBy(*by, "_bucket").orderBy("_o").rowsBetween(Window.unboundedPreceding, 0)
    within = d.select("*", *[F.sum(c).over(wi).alias(f"_in_{c}") for c in cols])
    # without groups the offsets are at most BUCKETS rows
    return (within.join(offsets if by else F.broadcast(offsets), [*by, "_bucket"], "inner")
            .select(*df.columns, *[(F.col(f"_off_{c}") + F.col(f"_in_{c}")).alias(f"{prefix}{c}") for c in cols]))


def _bounds(df: DataFrame, col: str, buckets: int) -> list[float]:
    """At most ``buckets - 1`` different finite values that cut ``col`` into parts of about equal size (one small job)."""
    share = [k / buckets for k in range(1, buckets)]
    got = df.where(F.col(col).isNotNull() & ~F.isnan(col)).agg(F.percentile_approx(col, share, 10_000).alias("b")).first()["b"]
    return sorted(set(got or []))


def _bucket(x: Column, bounds: Sequence[float]) -> Column:
    """How many bounds lie below ``x``, in two steps over about the square root of their number; a null has none below."""
    if not bounds:
        return F.lit(0)
    step = math.isqrt(len(bounds)) + 1
    parts = [list(bounds[k:k + step]) for k in range(0, len(bounds), step)]
    coarse = F.lit([p[-1] for p in parts])
    part = F.size(F.filter(coarse, lambda b: b < x))
    fine = F.coalesce(F.get(F.array(*[F.lit(p) for p in parts]), part), F.array().cast("array<double>"))
    return F.when(x.isNull(), 0).otherwise(part * step + F.size(F.filter(fine, lambda b: b < x)))


def score_counts(df: DataFrame, y: str, score: str | Column) -> DataFrame:
    """One row per distinct score: (score, pos, neg), written to the checkpoint folder and read from there."""
    return materialize(df.groupBy(_c(score).cast("double").alias("score"))
                       .agg(F.sum(F.when(F.col(y) == 1, 1).otherwise(0)).cast("bigint").alias("pos"),
                            F.sum(F.when(F.col(y) == 1, 0).otherwise(1)).cast("bigint").alias("neg")))


def roc_auc(df: DataFrame, y: str = "y", score: str | Column = "score", digits: int = 6) -> DataFrame:
    """[K7] ROC AUC with ties counted one half (Mann-Whitney), one row ``auc``.

    NULL when only one class is present.
    """
    g = running_sums(score_counts(df, y, score), "score", ["neg"])
    return g.agg(F.try_divide(F.sum(F.col("pos") * (F.col("cum_neg") - F.col("neg") + F.lit(0.5) * F.col("neg"))),
                              (F.sum("pos") * F.sum("neg")).cast("double")).alias("_auc")) \
        .select(F.round("_auc", digits).alias("auc"))


def no_skill_auc(df: DataFrame, y: str = "y") -> DataFrame:
    """[K6] AUC of the constant (all-zero) predictor: 0.5 whenever both classes occur."""
    return roc_auc(df.withColumn("_zero", F.lit(0.0)), y, "_zero")


def roc_curve(df: DataFrame, y: str = "y", score: str | Column = "score", digits: int = 6) -> DataFrame:
    """[K8] ROC points per distinct score threshold: (threshold, fpr, tpr); predict 1 when score >= threshold."""
    sc = score_counts(df, y, score)
    g = running_sums(sc, "score", ["pos", "neg"], descending=True)
    totals = sc.agg(F.struct(F.sum("pos").alias("P"), F.sum("neg").alias("N"))).scalar()
    p_tot, n_tot = totals.getField("P"), totals.getField("N")
    return g.select(F.col("score").alias("threshold"),
                    F.round(F.try_divide(F.col("cum_neg"), n_tot.cast("double")), digits).alias("fpr"),
                    F.round(F.try_divide(F.col("cum_pos"), p_tot.cast("double")), digits).alias("tpr"))


def _cells(df: DataFrame, y: str, pred: Column) -> DataFrame:
    a = F.col(y)
    return df.agg(*[F.count(F.when((a == i) & (pred == j), F.lit(1))).cast("bigint").alias(f"c{i}{j}")
                    for i in (0, 1) for j in (0, 1)])


def confusion_matrix(df: DataFrame, y: str = "y", pred: str | Column = "prediction") -> DataFrame:
    """[K9] Full 2x2 grid (actual, predicted, count), zero cells included; one pass."""
    cells = _cells(df, y, _c(pred))
    return cells.select(F.explode(F.array(*[
        F.struct(F.lit(i).alias("actual"), F.lit(j).alias("predicted"), F.col(f"c{i}{j}").alias("count"))
        for i in (0, 1) for j in (0, 1)])).alias("_r")).select("_r.*")


def threshold_table(df: DataFrame, y: str = "y", prob: str | Column = "probability",
                    threshold: float = 0.5) -> DataFrame:
    """[K15] Confusion grid of ``prob > threshold`` (statsmodels ``pred_table``)."""
    return confusion_matrix(df, y, F.when(_c(prob) > F.lit(threshold), 1).otherwise(0))


def accuracy(df: DataFrame, y: str = "y", pred: str | Column = "prediction") -> DataFrame:
    """[K5] Share of rows with prediction == label."""
    return df.agg(F.avg(F.when(F.col(y) == _c(pred), 1.0).otherwise(0.0)).alias("accuracy"))


def classification_report(df: DataFrame, y: str = "y", pred: str | Column = "prediction",
                          digits: int = 6) -> DataFrame:
    """[K10] Per-class precision / recall / F1 / support, accuracy, macro and weighted averages.

    Ratios with a zero denominator are 0 (scikit-learn's ``zero_division``
    default after its warning).  Rows: ``0``, ``1``, ``accuracy``,
    ``macro avg``, ``weighted avg``.
    """
    c = _cells(df, y, _c(pred))

    def div(a: Column, b: Column) -> Column:
        return F.when(b > 0, a / b).otherwise(F.lit(0.0))

    tp = {0: F.col("c00"), 1: F.col("c11")}
    pred_n = {0: F.col("c00") + F.col("c10"), 1: F.col("c01") + F.col("c11")}
    act_n = {0: F.col("c00") + F.col("c01"), 1: F.col("c10") + F.col("c11")}
    total = F.col("c00") + F.col("c01") + F.col("c10") + F.col("c11")
    p = {k: div(tp[k], pred_n[k]) for k in (0, 1)}
    r = {k: div(tp[k], act_n[k]) for k in (0, 1)}
    f = {k: div(2 * p[k] * r[k], p[k] + r[k]) for k in (0, 1)}

    def row(label, pr, rc, f1, sup):
        return F.struct(F.lit(label).alias("label"), pr.cast("double").alias("precision"),
                        rc.cast("double").alias("recall"), f1.cast("double").alias("f1_score"),
                        sup.cast("bigint").alias("support"))

    rows = [row("0", p[0], r[0], f[0], act_n[0]), row("1", p[1], r[1], f[1], act_n[1]),
            row("accuracy", F.lit(None), F.lit(None), div(tp[0] + tp[1], total), total),
            row("macro avg", (p[0] + p[1]) / 2, (r[0] + r[1]) / 2, (f[0] + f[1]) / 2, total),
            row("weighted avg", div(p[0] * act_n[0] + p[1] * act_n[1], total),
                div(r[0] * act_n[0] + r[1] * act_n[1], total),
                div(f[0] * act_n[0] + f[1] * act_n[1], total), total)]
    out = c.select(F.explode(F.array(*rows)).alias("_r")).select("_r.*")
    return out.select("label", *[F.round(k, digits).alias(k) for k in ("precision", "recall", "f1_score")],
                      "support")
