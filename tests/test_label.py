"""ICU labelling: hand example of the analysis plus randomized comparison with the
brute-force hour x stay pairing (§2.13 #5-#7)."""

import datetime as dt
import random
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from hourglass.operators import label

H = dt.datetime(2022, 4, 28, 11, 0, 0)


def _hours(spark, rows):
    return spark.createDataFrame(rows, "personid long, encounterid long, hour_mark timestamp_ntz, v int")


def _stays(spark, rows):
    return spark.createDataFrame(rows, "personid long, encounterid long, icu_start timestamp_ntz, "
                                       "icu_end timestamp_ntz")


def brute(hours, stays, horizon=3600):
    """Reference semantics on Python lists: (next-label per hour, pair counts)."""
    nxt, pairs = {}, {}
    for (p, e, t, v) in hours:
        ahead = [s for (sp, se, s, _) in stays if sp == p and se == e and s is not None and s > t]
        nxt[(p, e, t, v)] = int(any((s - t).total_seconds() <= horizon for s in ahead))
        for s in set((s, en) for (sp, se, s, en) in stays if sp == p and se == e and s is not None and s > t):
            lab = int((s[0] - t).total_seconds() <= horizon)
            pairs[(p, e, t, v, lab)] = pairs.get((p, e, t, v, lab), 0) + 1
    return nxt, pairs


def _check(spark, hours, stays):
    h, s = _hours(spark, hours), _stays(spark, stays)
    exp_next, exp_pairs = brute(list(dict.fromkeys(hours)), stays)
    got_next = {(r.personid, r.encounterid, r.hour_mark, r.v): r.outcome_tx_ICU
                for r in label.label_next(h.distinct(), s).collect()}
    assert got_next == exp_next
    got_pairs = {(r.personid, r.encounterid, r.hour_mark, r.v, r.outcome_tx_ICU): r.n_pairs
                 for r in label.label_pairs(h, s).collect()}
    assert got_pairs == exp_pairs


def test_hand_example_boundaries(spark):
    hours = [(1, 1, H, 7), (2, 2, H, 8)]  # person 2 never goes to the ICU
    m = dt.timedelta
    stays = [(1, 1, H - m(days=4), H), (1, 1, H, H + m(hours=2)), (1, 1, H + m(minutes=30), H + m(hours=3)),
             (1, 1, H + m(hours=1), H + m(hours=4)), (1, 1, H + m(hours=1, seconds=1), H + m(hours=5)),
             (1, 1, None, H)]
    _check(spark, hours, stays)
    nxt = {r.personid: r.outcome_tx_ICU for r in label.label_next(_hours(spark, hours), _stays(spark, stays)).collect()}
    assert nxt == {1: 1, 2: 0}
    pairs = sorted((r.outcome_tx_ICU, r.n_pairs) for r in
                   label.label_pairs(_hours(spark, hours), _stays(spark, stays)).collect())
    # stays strictly after 11:00: +30 min, +1 h (label 1), +1 h 1 s (label 0); person 2 vanishes
    assert pairs == [(0, 1), (1, 2)]


@settings(max_examples=8, deadline=None)
@given(st.integers(min_value=0, max_value=10_000))
def test_random_against_brute_force(spark, seed):
    rnd = random.Random(seed)
    base = dt.datetime(2024, 1, 1)
    hours = [(rnd.randint(1, 3), 1, base + dt.timedelta(hours=rnd.randint(0, 30)), rnd.randint(0, 2))
             for _ in range(rnd.randint(1, 40))]
    stays = [(rnd.randint(1, 3), 1, base + dt.timedelta(seconds=rnd.choice([0, 1, 1800, 3599, 3600, 3601]) +
                                                          3600 * rnd.randint(0, 31)),
              base + dt.timedelta(hours=40)) for _ in range(rnd.randint(0, 25))]
    _check(spark, hours, stays)


def test_first_observation_deterministic_and_repartition_invariant(spark):
    rows = [(1, 2, H, 0, 5), (1, 1, H, 1, 6), (1, 1, H + dt.timedelta(hours=1), 0, 7), (2, 3, H, 0, 8)]
    df = spark.createDataFrame(rows, "personid long, encounterid long, hour_mark timestamp_ntz, "
                                     "outcome_tx_ICU int, v int")
    a = sorted(tuple(r) for r in label.first_observation(df).collect())
    b = sorted(tuple(r) for r in label.first_observation(df.repartition(7, "v")).collect())
    assert a == b == [(1, 1, H, 1, 6), (2, 3, H, 0, 8)]


@settings(max_examples=6, deadline=None)
@given(st.integers(min_value=0, max_value=10_000))
def test_random_unaligned_times_against_brute_force(spark, seed):
    """Time points need not be hour-aligned: the bucketed counts stay exact."""
    rnd = random.Random(seed)
    base = dt.datetime(2024, 1, 1)
    hours = [(rnd.randint(1, 2), 1, base + dt.timedelta(seconds=rnd.randint(0, 20 * 3600)), 0)
             for _ in range(rnd.randint(1, 30))]
    stays = []
    for _ in range(rnd.randint(0, 20)):
        p, t = rnd.choice(hours)[0], rnd.choice(hours)[2]
        off = rnd.choice([0, 1, 1799, 3599, 3600, 3601, 7200, -5])
        stays.append((p, 1, t + dt.timedelta(seconds=off), base + dt.timedelta(days=2)))
    _check(spark, hours, stays)


def test_labels_independent_of_session_time_zone(spark):
    from hourglass.session import sql_conf
    m = dt.timedelta
    hours = [(1, 1, H, 1), (1, 1, H + m(hours=1), 2)]
    stays = [(1, 1, H + m(minutes=50), H + m(hours=3)), (1, 1, H + m(hours=1, minutes=30), H + m(hours=4))]
    base = sorted(tuple(r) for r in label.label_next(_hours(spark, hours), _stays(spark, stays)).collect())
    with sql_conf(spark, **{"session.timeZone": "Asia/Kolkata"}):
        other = sorted(tuple(r) for r in label.label_next(_hours(spark, hours), _stays(spark, stays)).collect())
    assert base == other and [r[-1] for r in base] == [1, 1]


def test_next_stay_equals_nearest_following_pair(spark):
    """Random hours and stays with ties, gaps over many buckets, open ends and a busy encounter; small buckets and runs."""
    import datetime as dt
    rnd = random.Random(8)
    zero = dt.datetime(2021, 3, 1)
    hours, stays_ = [], []
    for e in range(6):
        for _ in range(200 if e == 0 else 20):
            hours.append((e % 3, e, zero + dt.timedelta(seconds=rnd.randrange(400_000))))
        for _ in range((150, 0, 1, 5, 5, 5)[e]):
            a = zero + dt.timedelta(seconds=rnd.choice([3600, 86400, rnd.randrange(400_000)]))
            stays_.append((e % 3, e, a, rnd.choice([None, a + dt.timedelta(hours=rnd.randrange(5))])))
    hours += hours[:3] + [(0, 0, None), (None, 0, zero)]
    stays_ += stays_[:3] + [(0, 0, None, zero), (None, 0, zero + dt.timedelta(hours=1), None)]
    h = spark.createDataFrame(hours, "personid int, encounterid int, hour_mark timestamp_ntz")
    s = spark.createDataFrame(stays_, "personid int, encounterid int, icu_start timestamp_ntz, icu_end timestamp_ntz")

    def nearest(p, e, t):
        ahead = [(a, b is None, b or zero, b) for q, f, a, b in stays_ if (q, f) == (p, e) and p is not None and t is not None and a is not None and a > t]
        if not ahead:
            return None, None, None
        a, _, _, b = min(ahead)
        return a, b, (a - t).total_seconds() / 3600

    want = Counter((*k, *nearest(*k)) for k in hours)
    for width, block in ((3600, 1024), (1000, 3), (50_000, 1)):
        got = label.next_stay(h, s, width=width, block=block).select("personid", "encounterid", "hour_mark", "icu_start", "icu_end", "hours_to_go")
        assert Counter(map(tuple, got.collect())) == want
