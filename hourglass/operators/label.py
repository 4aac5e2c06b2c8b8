"""Event-within-horizon labels and first observation per person.

[C3 C11 D7 E13 F1 J14 J15]

The labelling question is "does an ICU stay start within ``horizon`` after
this hour?".  The analysis answered it by pairing every hour with every ICU
stay of the encounter (a left join followed by a filter), which is quadratic
in the stays per encounter.  Here every answer is a difference of counts

    C(x) = number of stays of the encounter starting at or before x
    stays in (t, t + h]  = C(t + h) - C(t)
    stays ahead of t     = N - C(t)

and ``C`` is computed for all query points at once without forming pairs:
time is cut into buckets of width ``h``; per (encounter, bucket) the stays
are counted (map-side pre-aggregated, at most one row per bucket), a running
sum over those bucket rows gives the stays in earlier buckets, and a running
sum over the rows of one (encounter, bucket) – query points and stays only of
that bucket – gives the rest.  A busy encounter is spread over its buckets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.nested import to_ts_lenient

KEYS = ("personid", "encounterid")


def icu_stays(locations: DataFrame, pattern: str = "ICU", keys: Sequence[str] = KEYS, name: str = "name",
              start: str = "beginDate", end: str = "endDate") -> DataFrame:
    """[C3 E12] Distinct ICU stays (keys, icu_start, icu_end) from locations whose name matches."""
    return (locations.where(F.col(name).rlike(pattern))
            .select(*keys, F.col(start).alias("icu_start"), F.col(end).alias("icu_end")).distinct()
            .select(*keys, to_ts_lenient("icu_start").alias("icu_start"), to_ts_lenient("icu_end").alias("icu_end")))


def _epoch(c: Column) -> Column:
    """Whole seconds since 1970-01-01 of a wall-clock (NTZ) timestamp."""
    return F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), c.cast("timestamp_ntz"))


def count_at_or_before(points: DataFrame, stays: DataFrame, keys: Sequence[str], width: int,
                       point_col: str = "_x", stay_col: str = "_s", out: str = "_c",
                       carry: Sequence[str] = ()) -> DataFrame:
    """For every (keys, point) row: number of stays of the same keys with ``stay <= point``.

    ``points`` holds (keys, point_col, *carry) and ``stays`` (keys, stay_col),
    both as epoch seconds; ``carry`` columns ride along with the points.
    Stays are first collapsed to (keys, second, count), so a burst of stays
    becomes one weighted row per distinct second.  Exact, no pairs, skew
    spread over ``width``-second buckets.
    """
    keys = list(keys)
    carry = list(carry)
    p = points.select(*keys, *carry, F.col(point_col).alias("_t"), F.lit(0).alias("_is_stay"))
    s = (stays.groupBy(*keys, F.col(stay_col).alias("_t")).agg(F.count(F.lit(1)).alias("_is_stay"))
         .select(*keys, *[F.lit(None).alias(c) for c in carry], "_t", "_is_stay"))
    u = p.unionByName(s).withColumn("_b", F.floor(F.col("_t") / F.lit(width)))
    # stays per (keys, bucket) -> stays in all earlier buckets (one row per bucket)
    per_bucket = u.groupBy(*keys, "_b").agg(F.sum("_is_stay").alias("_nb"))
    wb = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    before = per_bucket.select(*keys, "_b", F.coalesce(F.sum("_nb").over(wb), F.lit(0)).alias("_before"))
    # within the bucket: stays at or before the point (stays sort first at equal time)
    ww = (Window.partitionBy(*keys, "_b").orderBy(F.col("_t"), F.col("_is_stay").desc())
          .rowsBetween(Window.unboundedPreceding, 0))
    within = u.withColumn("_within", F.sum("_is_stay").over(ww)).where(F.col("_is_stay") == 0)  # points only
    res = within.join(before, on=[*keys, "_b"], how="inner")
    return res.select(*keys, *carry, F.col("_t").alias(point_col),
                      (F.col("_before") + F.col("_within")).alias(out))


def _stay_counts(hours: DataFrame, stays: DataFrame, keys: Sequence[str], t: str, horizon_s: int) -> DataFrame:
    """keys, t -> _c_t (stays <= t), _c_th (stays <= t + horizon), _n (all stays), per distinct hour."""
    keys = list(keys)
    hk = hours.select(*keys, t).distinct()
    e = _epoch(F.col(t))
    pts = (hk.select(*keys, t, F.explode(F.array(
        F.struct(F.lit(0).alias("_w"), e.alias("_x")),
        F.struct(F.lit(1).alias("_w"), (e + F.lit(horizon_s)).alias("_x")))).alias("_p"))
        .select(*keys, t, "_p._w", "_p._x"))
    # distinct stays: the as-written GROUP BY over all columns counts a repeated (start, end) once
    st = (stays.where(F.col("icu_start").isNotNull()).select(*keys, "icu_start", "icu_end").distinct()
          .select(*keys, _epoch(F.col("icu_start")).alias("_s")))
    c = count_at_or_before(pts, st, keys, horizon_s, carry=[t, "_w"])
    cnt = c.groupBy(*keys, t).agg(F.max(F.when(F.col("_w") == 0, F.col("_c"))).alias("_c_t"),
                                   F.max(F.when(F.col("_w") == 1, F.col("_c"))).alias("_c_th"))
    totals = st.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return (cnt.join(totals, on=keys, how="left")
            .select(*keys, t, "_c_t", "_c_th", F.coalesce("_n", F.lit(0)).alias("_n")))


def label_next(hours: DataFrame, stays: DataFrame, keys: Sequence[str] = KEYS, t: str = "hour_mark",
               horizon_s: int = 3600, out: str = "outcome_tx_ICU", with_counts: bool = False) -> DataFrame:
    """[J14 as meant, C11 D7] One row per input hour; ``out = 1`` when a stay starts in (t, t + horizon].

    Hours of encounters without any stay, and hours after the last stay,
    are kept with label 0 (the analysis' own note on its pairing defect).
    """
    keys = list(keys)
    cnt = _stay_counts(hours, stays, keys, t, horizon_s)
    lab = cnt.select(*keys, t, F.when(F.col("_c_th") - F.col("_c_t") > 0, 1).otherwise(0).alias(out),
                     (F.col("_n") - F.col("_c_t")).alias("stays_ahead"))
    res = hours.join(lab, on=[*keys, t], how="inner")
    return res if with_counts else res.drop("stays_ahead")


def label_pairs(hours: DataFrame, stays: DataFrame, keys: Sequence[str] = KEYS, t: str = "hour_mark",
                horizon_s: int = 3600, out: str = "outcome_tx_ICU", count_as: str = "n_pairs") -> DataFrame:
    """[J14 as written, C11 D7 E13] The hour x stay pairing, de-duplicated over all columns, in counted form.

    As written, each distinct hour row yields one row per distinct stay that
    starts after it (hours with no stay ahead vanish, the outer join acts as
    inner), labelled 1 when that stay starts within ``horizon``.  After the
    stay columns are dropped those rows differ only by label, so the result
    is returned as (hour row, label, ``n_pairs``) – the same multiset, with
    the multiplicity as a column instead of repeated rows.
    """
    keys = list(keys)
    h = hours.distinct()
    cnt = _stay_counts(h, stays, keys, t, horizon_s)
    n_pos = F.col("_c_th") - F.col("_c_t")
    n_ahead = F.col("_n") - F.col("_c_t")
    lab = cnt.select(*keys, t, F.explode(F.array(
        F.struct(F.lit(1).alias(out), n_pos.alias(count_as)),
        F.struct(F.lit(0).alias(out), (n_ahead - n_pos).alias(count_as)))).alias("_l"))
    lab = lab.select(*keys, t, "_l.*").where(F.col(count_as) > 0)
    return h.join(lab, on=[*keys, t], how="inner")


def next_stay(hours: DataFrame, stays: DataFrame, keys: Sequence[str] = KEYS, t: str = "hour_mark", width: int = 3600,
              block: int = 1024) -> DataFrame:
    """[D7 J14] Every input hour with the nearest stay that starts after it: icu_start, icu_end, hours_to_go.

    As-of join without pairs.  Time is cut into buckets of ``width`` seconds and runs of ``block`` buckets.  A stay later
    in the hour's own bucket is found by a window over that bucket's rows.  Else the stay is the least one of the next
    bucket that has any; it is carried backwards over empty buckets by a window over the buckets of one run, and from run
    to run by a window over the runs.  All three are bounded by the bucket, the run and the number of runs, so a busy
    encounter is spread over its buckets.  Of stays that start together the one that ends first counts, nulls last.
    Hours without a following stay have nulls; repeated hours are kept, null hours and nulls among the keys match nothing.
    """
    keys = list(keys)
    far = F.lit(253402300799).cast("bigint")  # an open end sorts last
    s = stays.where(F.col("icu_start").isNotNull()).select(
        *keys, F.struct(_epoch(F.col("icu_start")).alias("at"), F.coalesce(_epoch(F.col("icu_end")), far).alias("upto"),
                        F.col("icu_start").alias("icu_start"), F.col("icu_end").alias("icu_end")).alias("stay"))
    # one stay for each second, pre-aggregated
    s = s.groupBy(*keys, F.col("stay.at").alias("_t")).agg(F.min("stay").alias("_stay"))
    points = hours.where(F.col(t).isNotNull()).select(*keys, t).distinct().withColumn("_t", _epoch(F.col(t)))
    rows = (points.select(*keys, t, "_t", F.lit(None).cast(s.schema["_stay"].dataType).alias("_stay"))
            .unionByName(s.select(*keys, F.lit(None).cast(points.schema[t].dataType).alias(t), "_t", "_stay"))
            .withColumn("_b", F.floor(F.col("_t") / F.lit(width))))
    # least stay of each bucket, then the least of the buckets after it in its run, then that of the runs after it
    first = rows.groupBy(*keys, "_b").agg(F.min("_stay").alias("_least")).withColumn("_r", F.floor(F.col("_b") / F.lit(block)))
    runs = first.groupBy(*keys, "_r").agg(F.min("_least").alias("_run"))
    after_run = Window.partitionBy(*keys).orderBy("_r").rowsBetween(1, Window.unboundedFollowing)
    runs = runs.select(*keys, "_r", F.first("_run", ignorenulls=True).over(after_run).alias("_later"))
    after = Window.partitionBy(*keys, "_r").orderBy("_b").rowsBetween(1, Window.unboundedFollowing)
    first = (first.withColumn("_rest", F.first("_least", ignorenulls=True).over(after)).join(runs, [*keys, "_r"])
             .select(*keys, "_b", F.coalesce("_rest", "_later").alias("_after")))
    # in the hour's own bucket: the least stay with a later second
    own = Window.partitionBy(*keys, "_b").orderBy("_t").rangeBetween(1, Window.unboundedFollowing)
    found = (rows.withColumn("_own", F.first("_stay", ignorenulls=True).over(own)).where(F.col(t).isNotNull())
             .join(first, [*keys, "_b"]).withColumn("_next", F.coalesce("_own", "_after"))
             .select(*keys, t, "_next.icu_start", "_next.icu_end",
                     ((F.col("_next.at") - F.col("_t")) / F.lit(3600.0)).alias("hours_to_go")))
    return hours.join(found, [*keys, t], "left")


def first_observation(df: DataFrame, key: str = "personid", order: Sequence[str] = ("hour_mark",),
                      tie: Sequence[str] = ("encounterid", "outcome_tx_ICU")) -> DataFrame:
    """[F1 J15] The earliest row per key (``row_number() = 1`` ordered by ``order``, then ``tie``).

    Computed as ``min(struct(order, tie, rest))`` per key: a plain aggregate
    with map-side partial aggregation, so a key owning a large share of rows
    is reduced inside every task instead of being sorted in one; remaining
    columns complete the ordering, so the pick is deterministic.
    """
    order_cols = [c for c in [*order, *tie] if c in df.columns]
    rest = [c for c in df.columns if c != key and c not in order_cols]
    s = F.struct(*[F.col(c) for c in order_cols + rest])
    return (df.groupBy(key).agg(F.min(s).alias("_first"))
            .select(key, *[F.col(f"_first.{c}").alias(c) for c in order_cols + rest])
            .select(*df.columns))
