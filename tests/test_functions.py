"""Column helpers: folds, lenient casts, rule classification, ages (FIXTURES §3)."""

from pyspark.sql import functions as F

from hourglass.functions import codes
from hourglass.functions.dates import age_years, hours_between
from hourglass.functions.nested import array_concat, to_int_lenient, to_ts_lenient


def test_array_concat_semantics(spark):
    df = spark.createDataFrame([(1, ["a", "b", "a"]), (2, []), (3, None), (4, ["a", None])],
                               "id int, arr array<string>")
    got = dict(df.select("id", array_concat("arr").alias("s")).collect())
    assert got == {1: ";a;b", 2: "", 3: None, 4: ";a"}


def test_lenient_int(spark):
    df = spark.createDataFrame([("12",), ("12.7",), ("x",), (None,), ("-3.9",), ("1e10",)], "v string")
    got = [r[0] for r in df.select(to_int_lenient("v")).collect()]
    assert got == [12, 12, None, None, -3, None]


def test_lenient_timestamp(spark):
    df = spark.createDataFrame([("2022-04-28 11:00:00",), ("not a date",), (None,)], "v string")
    got = [r[0] for r in df.select(to_ts_lenient("v")).collect()]
    assert str(got[0]) == "2022-04-28 11:00:00" and got[1] is None and got[2] is None


def test_classifier_rule_order_and_normalisation(spark):
    rows = [("A00.1",), ("H05",), ("H60.2",), ("h60",), ("Z99",), ("250.00",), ("V01",), ("T-88",), (None,),
            ("S|x",), ("H5",)]
    df = spark.createDataFrame(rows, "code string")
    out = df.select(codes.classify(codes.normalize_code("code")).alias("c")).collect()
    got = [r[0] for r in out]
    assert got == ["CCC_INFECTION", "CCC_EYE", "CCC_EAR", None, None, None, "CCC_EXTERNAL", "CCC_INJURY", None,
                   "CCC_INJURY", None]


def test_code_prefix_escapes_dots():
    p = codes.code_prefix(["U07.1", "I63.6"])
    assert p == r"^U07\.1|^I63\.6"


def test_age_years_floor_and_negative(spark):
    df = spark.createDataFrame([("2003-12-01 00:00:00",), ("2003-12-02 00:00:00",), ("2022-01-01 00:00:00",),
                                ("2021-06-01",)], "b string")
    got = [r[0] for r in df.select(age_years("b", "2021-12-01")).collect()]
    # 18 years = 6575 days; 6575 / 365.25 = 18.001 -> 18 (boundary); one day less -> 17
    assert got == [18, 17, -1, 0]


def test_hours_between(spark):
    df = spark.createDataFrame([("2022-04-28 11:00:00", "2022-04-28 12:30:00")], "a string, b string")
    got = df.select(hours_between(to_ts_lenient("a"), to_ts_lenient("b"))).first()[0]
    assert got == 1.5


def test_rule_labels_complete():
    assert len(codes.rule_labels()) == 19
    assert len(codes.COVID_LAB_CODES_2) == 131 and len(codes.COVID_LAB_CODES_1) == 18
    assert len(codes.KIDNEY_LAB_CODES) == 14


def test_pick_prunes_the_scan(spark):
    """One leaf of a derived lab row needs the columns of the event that it is made of, and no others."""
    from hourglass.sources import lens
    df = lens.lab(spark, "/root/testdata/sf0.001").select(F.col("labcode.standard.id"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    read = plan[plan.index("ReadSchema"):].split("\n")[0]
    assert "event_type" in read and "value" in read and "props" not in read and "user_id" not in read
