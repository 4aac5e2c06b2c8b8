"""Exact DataFrame statistics: nulls, moments, quantiles, histograms, box plots,
outlier trimming, complete cases, melt.   [B10 B11 E9 E11 E14 E15 E16 J4 J16]

Bounds that feed a later filter are a few numbers that come to the driver from
small jobs and enter the plan as literals.  Quantiles are exact (linear
interpolation – pandas' default) and distributed: values are counted, the counts
are summed in value order over buckets (``metrics.running_sums``), and the two
values around each rank are picked, so no task holds the values of a column.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .metrics import running_sums


def null_profile(df: DataFrame, cols: Sequence[str] | None = None,
                 name_as: str = "column", count_as: str = "n_null") -> DataFrame:
    """[E9 C9] Null count of every column, one pass, as (column, n_null) rows."""
    cols = list(cols or df.columns)
    one = df.agg(*[F.count(F.when(F.col(f"`{c}`").isNull(), F.lit(1))).cast("bigint").alias(c) for c in cols])
    return one.unpivot([], cols, name_as, count_as)


def moments(df: DataFrame, col: str) -> DataFrame:
    """[E11] mean and sample standard deviation of one column."""
    return df.agg(F.avg(col).alias(f"mean_{col}"), F.stddev_samp(col).alias(f"stddev_{col}"))


def complete_cases(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """[B10] Drop rows with NULL (or NaN) in any of ``cols`` (default: every column)."""
    return df.na.drop("any", subset=list(cols) if cols else None)


def melt(df: DataFrame, id_vars: Sequence[str], value_vars: Sequence[str],
         var_name: str = "variable", value_name: str = "value") -> DataFrame:
    """[B11] Wide -> long (pandas ``melt``); values are cast to double first."""
    cast = df.select(*id_vars, *[F.col(c).cast("double").alias(c) for c in value_vars])
    return cast.unpivot(list(id_vars), list(value_vars), var_name, value_name)


def value_counts(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """Rows of each value in each group, ``n``, written to the checkpoint folder; null values are left out."""
    return materialize(df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n")))


def quantiles_of(counts: DataFrame, value: str, by: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """(by, q): exact interpolated quantiles of each group, an array in the order of ``probs``."""
    cum = running_sums(counts, value, ["n"], by=by)
    total = counts.groupBy(*by).agg(F.sum("n").alias("_total"))
    place = [(F.col("_total") - 1) * F.lit(float(p)) for p in probs]
    picks = []
    for i, at in enumerate(place):
        picks += [F.min(F.when(F.col("cum_n") > F.floor(at), F.col(value))).alias(f"_lo{i}"),
                  F.min(F.when(F.col("cum_n") > F.ceil(at), F.col(value))).alias(f"_hi{i}")]
    picked = cum.join(total, list(by)).groupBy(*by, "_total").agg(*picks)
    q = [F.when(F.floor(at) == F.ceil(at), F.col(f"_lo{i}")).otherwise(
        (F.ceil(at) - at) * F.col(f"_lo{i}") + (at - F.floor(at)) * F.col(f"_hi{i}")) for i, at in enumerate(place)]
    return picked.select(*by, F.array(*q).alias("q"))


def quantile_bounds(df: DataFrame, cols: Sequence[str], lo: float = 0.01, hi: float = 0.99,
                    exact: bool = True) -> DataFrame:
    """[E14] ``lo``/``hi`` quantiles of each column: (column, q_low, q_high), nulls for a column without values.

    Exact and interpolated by default (pandas ``quantile``); ``exact=False``
    uses ``percentile_approx`` in one pass.
    """
    if exact:
        long = melt(df, [], cols, "column", "_v")
        q = quantiles_of(value_counts(long, "_v", ["column"]), "_v", ["column"], (lo, hi))
        names = df.sparkSession.createDataFrame([(c,) for c in cols], "column string")
        return names.join(q, "column", "left").select("column", F.col("q")[0].alias("q_low"), F.col("q")[1].alias("q_high"))
    one = df.agg(*[F.percentile_approx(F.col(c).cast("double"), [lo, hi], 10000).alias(c) for c in cols])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c)[0].alias("q_low"),
                                        F.col(c)[1].alias("q_high")) for c in cols]))
    return one.select(rows.alias("_r")).select("_r.*")


def trim_bounds(df: DataFrame, cols: Sequence[str], lo: float = 0.01,
                hi: float = 0.99) -> list[tuple[str, float | None, float | None]]:
    """[J16] The cascade's bounds: for each column, in order, the exact ``lo``/``hi``
    quantiles over the rows that survive the bands of the columns before it.

    A few small jobs per column over ``df`` (materialise ``df`` first –
    ``checkpoint()`` – when it is expensive); only the bounds of the buckets and
    two numbers per column return to the driver.
    """
    bounds: list[tuple[str, float | None, float | None]] = []
    cond = None
    for c in cols:
        x = F.col(c).cast("double")
        src = df if cond is None else df.where(cond)
        counts = value_counts(src.select(x.alias("_v"), F.lit(0).alias("_g")), "_v", ["_g"])
        row = quantiles_of(counts, "_v", ["_g"], (lo, hi)).first()
        q = row["q"] if row else None
        b_lo, b_hi = (q[0], q[1]) if q is not None else (None, None)
        bounds.append((c, b_lo, b_hi))
        band = (x > F.lit(b_lo)) & (x < F.lit(b_hi)) if q is not None else F.lit(False)
        cond = band if cond is None else cond & band
    return bounds


def trim_cascade(df: DataFrame, cols: Sequence[str], lo: float = 0.01, hi: float = 0.99) -> DataFrame:
    """[J16 C10] Sequential open-band trim ``q_lo(c) < c < q_hi(c)`` over ``cols`` in order.

    Each column's bounds are computed on the rows that survived the previous
    columns, as the analysis did, so order matters and the passes are
    inherently sequential; the result is ``df`` filtered by all bands as
    literals (predicates Spark can push down).
    """
    cond = None
    for c, b_lo, b_hi in trim_bounds(df, cols, lo, hi):
        x = F.col(c).cast("double")
        band = (x > F.lit(b_lo)) & (x < F.lit(b_hi)) if b_lo is not None else F.lit(False)
        cond = band if cond is None else cond & band
    return df.where(cond) if cond is not None else df


def histogram(df: DataFrame, col: str, bins: int, drop_negative: bool = False) -> DataFrame:
    """[E15 J4] Equal-width histogram: (bin, lo, hi, count) for every bin, empty ones included.

    Width ``(max - min) / bins``, last bin closed (numpy / pandas ``hist``);
    a constant column gets the unit range around its value.  min and max come
    from one small aggregate job (two numbers to the driver) and enter the
    binning as literals, so the input plan is evaluated once more, not once
    per reference; the bin spine has ``bins`` rows.
    """
    src = df.where(F.col(col) >= 0) if drop_negative else df
    x = F.col(col).cast("double")
    r = src.agg(F.min(x).alias("mn"), F.max(x).alias("mx")).first()
    spine = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    if r["mn"] is None:
        return spine.select("bin", F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"),
                            F.lit(0).cast("bigint").alias("count"))
    mn, mx = (r["mn"], r["mx"]) if r["mx"] > r["mn"] else (r["mn"] - 0.5, r["mx"] + 0.5)
    lo, hi = F.lit(float(mn)), F.lit(float(mx))
    idx = F.least(F.floor((x - lo) * F.lit(float(bins)) / (hi - lo)), F.lit(bins - 1)).cast("int")
    counts = src.where(x.isNotNull()).groupBy(idx.alias("bin")).agg(F.count(F.lit(1)).cast("bigint").alias("count"))
    return (spine.join(counts, "bin", "left")
            .select("bin",
                    (lo + F.col("bin") * (hi - lo) / F.lit(float(bins))).alias("lo"),
                    (lo + (F.col("bin") + 1) * (hi - lo) / F.lit(float(bins))).alias("hi"),
                    F.coalesce("count", F.lit(0)).cast("bigint").alias("count")))


def box_stats(df: DataFrame, value_cols: Sequence[str], by: str, var_name: str = "variable",
              exact: bool = True) -> DataFrame:
    """[E16] Box-plot statistics per (variable, group) of a wide frame.

    quartiles (interpolated), IQR, whiskers at the most extreme values within
    1.5 IQR of the box, outlier count and n.  The long form is read once, into
    one row per (variable, group, value); quartiles and the aggregates against
    them come from those counts.  ``exact=False`` takes the quartiles from
    ``percentile_approx`` over the long form.
    """
    long = melt(df, [by], value_cols, var_name, "_v")
    c = value_counts(long, "_v", [var_name, by])
    if exact:
        q = quantiles_of(c, "_v", [var_name, by], (0.25, 0.5, 0.75))
    else:
        q = long.groupBy(var_name, by).agg(F.percentile_approx("_v", [0.25, 0.5, 0.75], 10000).alias("q"))
    q = q.select(var_name, by, F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"))
    j = c.join(q, [var_name, by], "inner")
    lo_f = F.col("q1") - F.lit(1.5) * (F.col("q3") - F.col("q1"))
    hi_f = F.col("q3") + F.lit(1.5) * (F.col("q3") - F.col("q1"))
    return (j.groupBy(var_name, by, "q1", "median", "q3")
            .agg(F.min(F.when(F.col("_v") >= lo_f, F.col("_v"))).alias("whisker_low"),
                 F.max(F.when(F.col("_v") <= hi_f, F.col("_v"))).alias("whisker_high"),
                 F.coalesce(F.sum(F.when((F.col("_v") < lo_f) | (F.col("_v") > hi_f), F.col("n"))), F.lit(0)).cast("bigint")
                 .alias("n_outliers"),
                 F.sum("n").cast("bigint").alias("n"))
            .withColumn("iqr", F.col("q3") - F.col("q1")))
