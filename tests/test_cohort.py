"""Cohort operators on hand-made rows (§2.13 #1, #11, #25; FIXTURES §3)."""

from pyspark.sql import functions as F

from hourglass.operators import cohort


def _enc(spark):
    rows = [(1, 10, "2020-01-01 00:00:00"), (1, 11, "2021-05-01 00:00:00"), (1, 12, "2021-05-01 00:00:00"),
            (2, 20, "not a date"), (2, 21, "2019-03-03 00:00:00"), (3, 30, None)]
    return spark.createDataFrame(rows, "personid long, encounterid long, start string")


def test_attach_latest_keeps_every_row(spark):
    out = cohort.attach_latest(_enc(spark), "personid", "start", "latest")
    assert out.count() == 6
    got = {r.encounterid: str(r.latest) for r in out.collect()}
    assert got[10] == "2021-05-01 00:00:00" and got[20] == "2019-03-03 00:00:00" and got[30] == "None"


def test_keep_latest_keeps_ties_only(spark):
    out = cohort.keep_latest(_enc(spark), "personid", "start")
    assert sorted(r.encounterid for r in out.collect()) == [11, 12, 21]


def test_single_valued_birthdate(spark):
    rows = [(1, "2010-01-01"), (1, "2010-01-01"), (2, "2010-01-01"), (2, "2011-01-01"), (3, "2030-01-01")]
    df = spark.createDataFrame(rows, "personid long, birthdate string")
    got = {r.personid: str(r.birthdate) for r in cohort.single_valued(df, "personid", "birthdate").collect()}
    assert got == {1: "2010-01-01 00:00:00", 3: "2030-01-01 00:00:00"}


def test_in_sites_with_is_semi_join(spark):
    rows = [(1, "a", "Ward;PICU"), (2, "a", "Ward"), (3, "b", "Ward"), (4, "c", None)]
    df = spark.createDataFrame(rows, "id int, tenant string, locs string")
    out = cohort.in_sites_with(df, "tenant", F.col("locs").rlike("ICU"))
    assert sorted(r.id for r in out.collect()) == [1, 2]


def test_with_age_negative_ages_pass_under_18(spark):
    df = spark.createDataFrame([(1, "2025-01-01 00:00:00"), (2, "2000-01-01 00:00:00")], "p int, birthdate string")
    out = cohort.with_age(df, "birthdate", "2021-12-01").where("age < 18")
    assert [r.p for r in out.collect()] == [1]


def test_after_first_qualifying(spark):
    rows = [(1, "t1", 100, "2021-01-01", 1), (1, "t1", 101, "2021-02-01", 0), (1, "t2", 102, "2020-12-01", 0),
            (2, "t1", 200, "2021-01-01", 0)]
    df = spark.createDataFrame(rows, "personid long, tenant string, encounterid long, d string, q int") \
        .withColumn("servicedate", F.to_date("d")).withColumn("encountertype", F.lit("x"))
    out = cohort.after_first(df, "personid", "servicedate", F.col("q") == 1, "encountertype").first()
    assert (out.tenants, out.patients, out.encounters) == (1, 1, 1)


def _cohort_inputs(spark):
    from pyspark.sql import functions as F

    from hourglass.functions.nested import concept

    enc = spark.createDataFrame(
        [(1, 10, 100, "Inpatient", "2020-01-01 00:00:00", "2020-01-03 00:00:00", ["Ward", "PICU"]),
         (1, 11, 100, "Inpatient", "2021-01-01 00:00:00", "2021-01-01 00:30:00", ["Ward"]),
         (2, 20, 200, "Inpatient", "2021-02-01 00:00:00", "2021-02-05 00:00:00", ["Ward"]),
         (3, 30, 100, "Outpatient", "2021-03-01 00:00:00", None, ["PICU"])],
        "personid long, encounterid long, tenant long, cls string, start string, stop string, locs array<string>")
    enc = enc.select("personid", "encounterid", "tenant",
                     concept(F.col("cls"), F.col("cls")).alias("classification"),
                     *[concept(F.lit("x"), F.lit("x")).alias(c)
                       for c in ("reasonforvisit", "financialclass", "admissionsource", "status")],
                     F.col("start").alias("hospitalizationstartdate"), F.col("stop").alias("dischargedate"),
                     F.transform("locs", lambda n: F.struct(n.alias("name"))).alias("locations"))
    dem = spark.createDataFrame([(1, "2010-01-01 00:00:00"), (2, "2011-01-01 00:00:00"), (3, "2012-01-01 00:00:00")],
                                "personid long, birthdate string")
    dem = dem.select("personid", "birthdate", concept(F.lit("F"), F.lit("Female")).alias("birthsex"),
                     F.array(concept(F.lit("White"), F.lit("White"))).alias("races"),
                     F.array(concept(F.lit("x"), F.lit("x"))).alias("ethnicities"))
    return enc, dem


def test_pediatric_icu_cohort_options(spark):
    enc, dem = _cohort_inputs(spark)
    # as written: every inpatient encounter of an under-18 at a tenant with an ICU location (tenant 100)
    base = cohort.pediatric_icu_cohort(enc, dem, as_of="2021-12-01")
    assert sorted(r.encounterid for r in base.collect()) == [10, 11]
    # as meant: only the latest admission per person; the ICU sites are judged on that same cohort,
    # where tenant 100's only ICU location (encounter 10) is gone, so nothing remains
    keep = cohort.pediatric_icu_cohort(enc, dem, as_of="2021-12-01", latest="keep")
    assert sorted(r.encounterid for r in keep.collect()) == []
    # optional length-of-stay exclusion (> 24 h): encounter 11 lasted 30 minutes
    los = cohort.pediatric_icu_cohort(enc, dem, as_of="2021-12-01", min_stay_hours=24)
    assert sorted(r.encounterid for r in los.collect()) == [10]
    # all classes (no inpatient filter)
    allc = cohort.pediatric_icu_cohort(enc, dem, as_of="2021-12-01", classification=None)
    assert sorted(r.encounterid for r in allc.collect()) == [10, 11, 30]


def test_value_set_paths_agree(spark):
    from hourglass.operators import concepts
    rows = [(i, f"c{i % 300}") for i in range(900)]
    df = spark.createDataFrame(rows, "id int, code string")
    small = [f"c{i}" for i in range(0, 300, 7)]                 # <= 200 codes: InSet
    large = [f"c{i}" for i in range(0, 300)] [:250]              # > 200 codes: broadcast semi join
    as_df = spark.createDataFrame([(c,) for c in large], "code string")
    a = {r.id for r in concepts.in_value_set(df, "code", small).collect()}
    b = {r.id for r in concepts.in_value_set(df, "code", large).collect()}
    c = {r.id for r in concepts.in_value_set(df, "code", as_df).collect()}
    assert a == {i for i, c_ in rows if c_ in set(small)}
    assert b == c == {i for i, c_ in rows if c_ in set(large)}
