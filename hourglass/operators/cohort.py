"""Cohort construction: encounter x demographics, latest admission, ages,
site semi-joins, single-valued attributes, post-qualification encounters.

[D1 D2 D8 D9 D10 E5 E6 J3 J9 J10 J17]
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.codes import ENCOUNTER_TYPE_RULES, classify
from ..functions.dates import DEFAULT_AS_OF, age_years, as_date
from ..functions.nested import array_concat, to_ts_lenient

DISPLAY = "standard.primaryDisplay"


def encounter_person(encounter: DataFrame, demographics: DataFrame,
                     classification: str | None = "Inpatient",
                     class_path: str = "classification.standard.primaryDisplay",
                     with_locations: bool = True) -> DataFrame:
    """[J3 step 1: D1 C1 B1 B2 B7] Encounter x demographics, flattened.

    Inner join on personid (keys qualified on both sides), equality filter on
    the encounter class pushed below the join, nested displays projected by
    path, race / ethnicity / location arrays folded to ``';a;b'`` strings.
    ``classification=None`` keeps every class (the all-class variant).
    """
    e = encounter.alias("enc")
    d = demographics.alias("dem")
    if classification is not None:
        e = e.where(F.col(f"enc.{class_path}") == F.lit(classification))
    cols = [
        F.col("enc.personid").alias("personid"),
        F.col("enc.encounterid").alias("encounterid"),
        F.col(f"enc.reasonforvisit.{DISPLAY}").alias("reasonforvisit"),
        F.col(f"enc.financialclass.{DISPLAY}").alias("payer"),
        F.col(f"enc.admissionsource.{DISPLAY}").alias("admissionsource"),
        F.col("enc.hospitalizationstartdate").alias("hospitalizationstartdate"),
        F.col("dem.birthdate").alias("birthdate"),
        F.col("enc.dischargedate").alias("dischargedate"),
        F.col("enc.tenant").alias("tenant"),
        F.col(f"enc.status.{DISPLAY}").alias("status"),
        F.col(f"dem.birthsex.{DISPLAY}").alias("sex"),
        array_concat(F.col(f"dem.races.{DISPLAY}")).alias("race"),
        array_concat(F.col(f"dem.ethnicities.{DISPLAY}")).alias("ethnicity"),
    ]
    if with_locations:
        cols.append(array_concat(F.col("enc.locations.name")).alias("encounterLocations"))
    return e.join(d, F.col("enc.personid") == F.col("dem.personid"), "inner").select(*cols)


def latest_per_key(df: DataFrame, key: str | Sequence[str], ts: str, out: str) -> DataFrame:
    """[E5] key, max(lenient timestamp of ``ts``) – one partial aggregation."""
    keys = [key] if isinstance(key, str) else list(key)
    return df.groupBy(*keys).agg(F.max(to_ts_lenient(ts)).alias(out))


def attach_latest(df: DataFrame, key: str | Sequence[str], ts: str, out: str | None = None) -> DataFrame:
    """[D10 as written] Attach the per-key maximum of ``ts`` to every row; no row is removed.

    Aggregate + join back (the join is what the analysis did).  A key holding
    a large share of the rows is handled by AQE's skew-join split.
    """
    keys = [key] if isinstance(key, str) else list(key)
    out = out or f"latest_{ts}"
    return df.join(latest_per_key(df, keys, ts, out), on=keys, how="inner")


def keep_latest(df: DataFrame, key: str | Sequence[str], ts: str) -> DataFrame:
    """[D10 as meant] Keep only the rows at the per-key latest ``ts`` (ties all kept).

    Semi-join on (key, ts): the latest timestamp is part of the join key, so
    even a hot key spreads over its distinct timestamps.
    """
    keys = [key] if isinstance(key, str) else list(key)
    latest = latest_per_key(df, keys, ts, "_latest_ts")
    tagged = df.withColumn("_ts", to_ts_lenient(ts))
    cond = [tagged[k] == latest[k] for k in keys] + [tagged["_ts"] == latest["_latest_ts"]]
    return tagged.join(latest, cond, "left_semi").drop("_ts")


def with_age(df: DataFrame, birth: str = "birthdate", as_of: str | Column | _dt.date = DEFAULT_AS_OF,
             divisor: float = 365.25, out: str = "age") -> DataFrame:
    """[§2.9 age_years, B3] ``birthday = to_date(birth)``, ``age = floor(datediff(as_of, birthday)/divisor)``."""
    return (df.withColumn("birthday", F.to_date(to_ts_lenient(birth)))
            .withColumn(out, age_years("birthday", as_of, divisor)))


def sites_with(df: DataFrame, site: str, predicate: Column) -> DataFrame:
    """[D8] Distinct sites having at least one row matching ``predicate``."""
    return df.where(predicate).select(site).distinct()


def in_sites_with(df: DataFrame, site: str, predicate: Column) -> DataFrame:
    """[D8] Rows of ``df`` whose site has a row matching ``predicate`` (left semi join).

    The site list is bounded by the number of sites; AQE turns the semi join
    into a broadcast at run time when the measured list is small.
    """
    return df.join(sites_with(df, site, predicate), on=site, how="left_semi")


def pediatric_icu_cohort(encounter: DataFrame, demographics: DataFrame,
                         as_of: str | _dt.date = DEFAULT_AS_OF, icu_pattern: str = "ICU",
                         classification: str | None = "Inpatient", max_age: int = 18,
                         divisor: float = 365.25, latest: str = "attach",
                         min_stay_hours: float | None = None) -> DataFrame:
    """[J3 C6] Inpatient encounters of persons under ``max_age`` at hospitals with an ICU.

    encounter x demographics -> latest admission (``attach`` as written /
    ``keep`` as meant / ``none``) -> age at ``as_of`` -> ``age < max_age``
    (negative ages pass, as in the analysis) -> tenants with an encounter
    whose locations match ``icu_pattern``.  ``min_stay_hours`` optionally
    applies the length-of-stay exclusion the notes describe.
    """
    enc = encounter_person(encounter, demographics, classification)
    if min_stay_hours is not None:
        stay = F.timestamp_diff("SECOND", to_ts_lenient("hospitalizationstartdate"), to_ts_lenient("dischargedate"))
        enc = enc.where(stay > F.lit(min_stay_hours * 3600.0))
    if latest == "attach":
        enc = attach_latest(enc, "personid", "hospitalizationstartdate", "latest_admission")
    elif latest == "keep":
        enc = keep_latest(enc, "personid", "hospitalizationstartdate")
    enc = with_age(enc, "birthdate", as_of, divisor).where(F.col("age") < max_age)
    return in_sites_with(enc, "tenant", F.col("encounterLocations").rlike(icu_pattern))


def single_valued(df: DataFrame, key: str, attr: str, where: Column | None = None,
                  out: str | None = None) -> DataFrame:
    """[E6] Keys whose ``attr`` has exactly one distinct value: (key, min(timestamp(attr))).

    ``GROUP BY key HAVING count(DISTINCT attr) = 1``; Catalyst de-duplicates
    (key, attr) map-side before the shuffle.
    """
    src = df if where is None else df.where(where)
    return (src.groupBy(key)
            .agg(F.min(to_ts_lenient(attr)).alias(out or attr), F.count_distinct(attr).alias("_n"))
            .where(F.col("_n") == 1).drop("_n"))


def patient_features(demo: DataFrame, demographics: DataFrame, matrix: DataFrame,
                     as_of: str | _dt.date = DEFAULT_AS_OF, max_age: int = 18,
                     join: str = "inner", drop_unmatched: bool = True) -> DataFrame:
    """[J17 B5 B6 D2 D3] Person-level features: single-birthdate persons under ``max_age`` at
    ``as_of``, their age, joined to the condition matrix.

    One reference date for both the filter and the age (SURVEY §2.13 #25).
    The matrix join drops the duplicate key by DataFrame reference instead of
    flipping case sensitivity; ``join='left'`` keeps persons without
    conditions with zero indicators.
    """
    birth_ts = to_ts_lenient("birthdate")
    young = F.datediff(as_date(as_of), F.to_date(birth_ts)) / F.lit(365.25) < F.lit(max_age)
    bday = single_valued(demographics, "personid", "birthdate", where=young)
    d = (demo.join(bday, on="personid", how="inner")
         .withColumn("age", age_years(F.col("birthdate"), as_of))
         .drop("birthdate"))
    m = matrix.drop("null") if drop_unmatched and "null" in matrix.columns else matrix
    key = [c for c in m.columns if c.lower() == "personid"][0]
    m = m.withColumnRenamed(key, "_mkey")
    out = d.join(m, d["personid"] == m["_mkey"], join).drop("_mkey")
    if join == "left":
        out = out.na.fill(0, subset=[c for c in m.columns if c != "_mkey"])
    return out


def after_first(df: DataFrame, key: str, ts: str, qualifies: Column, by: str,
                counts: Sequence[str] = ("tenant", "personid", "encounterid"),
                names: Sequence[str] = ("tenants", "patients", "encounters")) -> DataFrame:
    """[J9 D9 C12 E5] Rows dated after the key's first qualifying date, distinct counts by ``by``.

    First date = ``min(ts)`` over qualifying rows per key (partial
    aggregation); the comma join becomes an equi-join on the key with the
    inequality as a join residual.
    """
    first = df.where(qualifies).groupBy(key).agg(F.min(ts).alias("_first"))
    e = df.join(first, on=key, how="inner").where(F.col(ts) > F.col("_first"))
    return e.groupBy(by).agg(*[F.count_distinct(c).cast("bigint").alias(n) for c, n in zip(counts, names)])


def distinct_counts_by(df: DataFrame, by: str | Sequence[str],
                       counts: Sequence[str] = ("tenant", "personid", "encounterid"),
                       names: Sequence[str] = ("tenants", "patients", "encounters"),
                       where: Column | None = None) -> DataFrame:
    """[E4] Several ``count(DISTINCT ..)`` per group in one aggregation."""
    src = df if where is None else df.where(where)
    by = [by] if isinstance(by, str) else list(by)
    return src.groupBy(*by).agg(*[F.count_distinct(c).cast("bigint").alias(n) for c, n in zip(counts, names)])


def pediatric_flags(demographics: DataFrame, encounter: DataFrame, divisor: float = 365.0,
                    max_age: int = 18) -> DataFrame:
    """[J10] person, encounter, class display, isPediatric (age at service < max_age)."""
    d = demographics.alias("dem")
    e = encounter.alias("enc")
    age = F.datediff(F.to_date(to_ts_lenient("enc.servicedate")), F.to_date(to_ts_lenient("dem.birthdate"))) \
        / F.lit(float(divisor))
    return (d.join(e, F.col("dem.personid") == F.col("enc.personid"), "inner")
            .select(F.col("dem.personid").alias("personid"), F.col("enc.encounterid").alias("encounterid"),
                    F.col("enc.classification.standard.primaryDisplay").alias("primaryDisplay"),
                    F.when(age < max_age, 1).otherwise(0).alias("isPediatric")))


def encounter_type(display: Column | str, rules=ENCOUNTER_TYPE_RULES) -> Column:
    """[§2.9 encounter_type_case] Ordered regex CASE, no ELSE (unmatched -> NULL)."""
    return classify(display, rules)


def birth_year_flag(demographics: DataFrame, before_year: int = 2003) -> DataFrame:
    """[J10] ``born_before_<year>`` flag per person, counted by flag (distinct persons).

    The analysis named this flag ``isPediatric`` although it marks births
    *before* the year; the output says what is tested.
    """
    flag = F.when(F.year(to_ts_lenient("birthdate")) < before_year, 1).otherwise(0)
    return (demographics.select("personid", flag.alias(f"born_before_{before_year}"))
            .groupBy(f"born_before_{before_year}").agg(F.count_distinct("personid").cast("bigint").alias("nPat")))
