"""Registered end-to-end queries: one callable ``(spark, sf_dir) -> DataFrame`` per
SURVEY §2 key.  Each reads the driver tables (through the clinical lens) so
its work grows with them; computed columns carry explicit aliases matching
``plans/oracle.py``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codes as K
from ..functions.dates import DEFAULT_AS_OF, age_years, hours_between
from ..functions.nested import array_concat, pick, to_int_lenient
from ..operators import boosting, cohort, concepts, label, logit, metrics, models, panel, profile
from ..operators.conditions import condition_matrix, condition_prevalence
from ..operators.pivot import pivot_indicator, pivot_sum, pivot_values
from ..session import ensure_checkpoint_dir, materialize
from ..sources import lens
from ..sources.sinks import write_feature_table
from ..sources.tables import publish, read, read_path, table

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}

VITALS = lens.VITALS
TRIM_ORDER = ("heart_rate", "respiratory_rate", "diastolic_blood_pressure", "systolic_blood_pressure",
              "temperature", "spo2")
LAB_NAMES = tuple(sorted({r[2] for r in lens.LAB_TYPES} | {r[4] for r in lens.LAB_TYPES}))
CLASS_NAMES = tuple(sorted({v for _, v in lens.PRIORITY_CLASS}))
RACE_PATTERNS = (  # fixed values: the race patterns profiled by the analysis
    ("n_asian", "%Asian%"), ("n_white", "%White%"), ("n_hispanic", "%Hispanic%"),
    ("n_black", "%Black%"), ("n_american_indian", "%American Indian%"),
    ("n_native_hawaiian", "%Native Hawaiian%"), ("n_caucasian", "%Caucasian%"),
    ("n_other_race", "%Other Race%"), ("n_mixed", "%Mixed racial group%"),
    ("n_unknown", "%Unknown racial group%"),
)
AFRICAN_AMERICAN_EXACT = "African American"
DOC_THRESHOLD = 1500.0


def register(name: str):
    def deco(fn: Query) -> Query:
        REGISTRY[name] = fn
        return fn
    return deco


# ---------------------------------------------------------------------------
# shared building blocks
# ---------------------------------------------------------------------------
def vitals_panel(spark: SparkSession, sf: str, policy: str = "inner", cast: bool = True) -> DataFrame:
    """[J13 B4] The six vital tables joined with one policy (temperature column renamed)."""
    t = lens.vital_tables(spark, sf)
    t["temperature"] = t["temperature"].withColumnRenamed("value", "temperature")
    frames = [t[n] for n in ("respiratory_rate", "heart_rate", "diastolic_blood_pressure",
                             "systolic_blood_pressure", "temperature", "spo2")]
    out = panel.panel_join(frames, policy=policy)
    return panel.cast_measurements(out, VITALS) if cast else out


def vitals_wide(spark: SparkSession, sf: str, policy: str = "outer") -> DataFrame:
    """[J13 single-aggregation form] the panel straight from the raw measurements:
    one shuffle with map-side max per (key, vital), ints."""
    w = panel.panel_from_long(lens.vital_measurements(spark, sf), VITALS, policy=policy)
    return w.withColumns({v: F.col(v).cast("int") for v in VITALS})


def stays(spark: SparkSession, sf: str) -> DataFrame:
    return label.icu_stays(lens.locations(spark, sf), "ICU")


def cohort_frame(spark: SparkSession, sf: str) -> DataFrame:
    return cohort.pediatric_icu_cohort(lens.encounter(spark, sf, with_locations=True),
                                       lens.demographics(spark, sf), as_of=DEFAULT_AS_OF)


def matrix(spark: SparkSession, sf: str) -> DataFrame:
    return condition_matrix(lens.condition(spark, sf))


def features(spark: SparkSession, sf: str) -> DataFrame:
    return cohort.patient_features(lens.patient_demographics(spark, sf), lens.demographics(spark, sf),
                                   matrix(spark, sf), as_of=DEFAULT_AS_OF)


def labelled_hours(spark: SparkSession, sf: str) -> DataFrame:
    """[J14] next-hour ICU label on the complete-hours panel (single-aggregation form)."""
    return label.label_next(vitals_wide(spark, sf, "inner"), stays(spark, sf))


def first_hours(spark: SparkSession, sf: str) -> DataFrame:
    """[J15] label -> patient features -> earliest hour per person."""
    j = labelled_hours(spark, sf).join(features(spark, sf), on="personid", how="inner")
    return label.first_observation(j, "personid", ("hour_mark",), ("encounterid", "outcome_tx_ICU"))


def docs(spark: SparkSession, sf: str) -> DataFrame:
    return lens.scored_documents(spark, sf)


# ---------------------------------------------------------------------------
# 2.1 scans and sinks
# ---------------------------------------------------------------------------
@register("scan_parquet")
def q_scan_parquet(spark, sf):
    """[A3] projection + filter pushed into the parquet scan."""
    return (read(spark, sf, "lineitem").where(F.col("l_quantity") >= 45)
            .select("l_orderkey", "l_linenumber", "l_quantity"))


@register("feature_table_roundtrip")
def q_feature_table_roundtrip(spark, sf):
    """[A6] write the condition matrix as a parquet feature table in the shared
    checkpoint folder and read it back."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{base}/feature_tables/chronic_conditions-{uuid.uuid4().hex}"
    write_feature_table(matrix(spark, sf).withColumnRenamed("personid", "PERSONID"), path)
    return read_path(spark, path)


# ---------------------------------------------------------------------------
# 2.2 projections
# ---------------------------------------------------------------------------
@register("nested_path_project")
def q_nested_path_project(spark, sf):
    """[B1] four leaves of the wide lab record."""
    return pick(lens.lab(spark, sf), {"Type": "labcode.standard.primaryDisplay",
                                      "Interpretation": "interpretation.standard.primaryDisplay",
                                      "value": "typedvalue.numericValue.value"},
                keep=("personid", "issueddate"))


@register("array_field_project")
def q_array_field_project(spark, sf):
    """[B2] field of every array element -> folded string and element count."""
    e = lens.encounter(spark, sf, with_locations=True)
    return e.select("encounterid", array_concat(F.col("locations.name")).alias("encounterLocations"),
                    F.size(F.col("locations.name")).cast("int").alias("n_locations"))


@register("array_distinct_concat")
def q_array_distinct_concat(spark, sf):
    """[§2.9] race / ethnicity arrays folded with a leading separator."""
    d = lens.demographics(spark, sf)
    return d.select("personid", "birthdate",
                    array_concat(F.col("races.standard.primaryDisplay")).alias("race"),
                    array_concat(F.col("ethnicities.standard.primaryDisplay")).alias("ethnicity"))


@register("code_normalize")
def q_code_normalize(spark, sf):
    """[§2.9] distinct (code, normalised code)."""
    c = lens.condition(spark, sf)
    return c.select(F.col("conditioncode.standard.id").alias("code"),
                    K.normalize_code("conditioncode.standard.id").alias("code_normalized")).distinct()


@register("lenient_numeric_cast")
def q_lenient_numeric_cast(spark, sf):
    """[B8] string results -> int without failing on '12.7' or 'see note'."""
    l = lens.lab(spark, sf).select(F.col("labcode.standard.primaryDisplay").alias("Type"),
                                   to_int_lenient("typedvalue.numericValue.value").alias("value"))
    return l.groupBy("Type").agg(F.count(F.lit(1)).cast("bigint").alias("n"),
                                 F.count("value").cast("bigint").alias("n_parsed"),
                                 F.sum("value").cast("bigint").alias("sum_value"))


@register("category_index")
def q_category_index(spark, sf):
    """[B8] categorical -> index (most frequent first, ties by value) via StringIndexer."""
    from pyspark.ml.feature import StringIndexer
    d = lens.patient_demographics(spark, sf)
    m = StringIndexer(inputCol="race", outputCol="race_index", stringOrderType="frequencyDesc").fit(d)
    return (m.transform(d).groupBy("race", F.col("race_index").cast("int").alias("race_index"))
            .agg(F.count(F.lit(1)).cast("bigint").alias("n")))


@register("complete_cases")
def q_complete_cases(spark, sf):
    """[B10] outer panel rows with no missing vital."""
    return profile.complete_cases(vitals_wide(spark, sf, "inner"), VITALS)


@register("melt_vitals")
def q_melt_vitals(spark, sf):
    """[B11] labelled hours, wide -> long (outcome, Vitals, Vitals Values)."""
    lab_ = labelled_hours(spark, sf)
    return profile.melt(lab_, ["outcome_tx_ICU"], list(VITALS), "Vitals", "Vitals Values")


@register("explode_nested_types")
def q_explode_nested_types(spark, sf):
    """[B13] explode(encountertypes) -> col.classification display, distinct encounters."""
    e = lens.encounter(spark, sf).select("encounterid", F.explode("encountertypes"))
    return (e.groupBy(F.col("col.classification.standard.primaryDisplay").alias("encounterClass2"))
            .agg(F.count_distinct("encounterid").cast("bigint").alias("n")))


@register("join_drop_duplicate_key")
def q_join_drop_duplicate_key(spark, sf):
    """[B6 D3] expression join on personid == PERSONID, right key dropped by reference."""
    demo = lens.patient_demographics(spark, sf)
    cond = matrix(spark, sf).withColumnRenamed("personid", "PERSONID").drop("null")
    return demo.join(cond, demo["personid"] == cond["PERSONID"]).drop(cond["PERSONID"])


# ---------------------------------------------------------------------------
# 2.3 filters
# ---------------------------------------------------------------------------
@register("inpatient_filter")
def q_inpatient_filter(spark, sf):
    """[C1] equality on a nested field."""
    e = lens.encounter(spark, sf)
    return (e.where(F.col("classification.standard.primaryDisplay") == "Inpatient")
            .select("encounterid", "personid", "tenant"))


@register("valueset_membership")
def q_valueset_membership(spark, sf):
    """[C2] labs in a 131-code value set: distinct (lab, id, interpretation, labvalue)."""
    l = concepts.concept_filter(lens.lab(spark, sf), "labcode", ids=K.COVID_LAB_CODES_2)
    return l.select(F.col("labcode.standard.primaryDisplay").alias("lab"), F.col("labcode.standard.id").alias("id"),
                    F.col("INTERPRETATION.STANDARD.PRIMARYDISPLAY").alias("interpretation"),
                    F.col("TYPEDVALUE.TEXTVALUE.VALUE").alias("labvalue")).distinct()


@register("valueset_interpretations")
def q_valueset_interpretations(spark, sf):
    """[C2] distinct interpretations of a 14-code value set."""
    l = concepts.concept_filter(lens.lab(spark, sf), "labcode", ids=K.KIDNEY_LAB_CODES)
    return l.select(F.col("interpretation.standard.primaryDisplay").alias("interpretation")).distinct()


@register("concept_search_regex")
def q_concept_search_regex(spark, sf):
    """[C3 J8] labs whose case-folded name matches a respiratory-virus pattern."""
    return concepts.concept_search(lens.lab(spark, sf), "labcode", include=K.RESPIRATORY_VIRUS_PATTERN)


@register("concept_include_exclude")
def q_concept_include_exclude(spark, sf):
    """[C4 J8] magnesium products, excluding combination / other salts."""
    return concepts.concept_search(lens.medication(spark, sf), "drugcode", include=K.MAGNESIUM_INCLUDE,
                                   exclude=K.MAGNESIUM_EXCLUDE)


@register("concept_search_counts")
def q_concept_search_counts(spark, sf):
    """[J8 E3] ICD-10 COVID diagnosis codes with distinct encounter counts."""
    return concepts.concept_search(lens.condition(spark, sf), "conditioncode", include=K.COVID_DX_PATTERN,
                                   systems=[K.ICD10CM], case_insensitive=False, on="id",
                                   count_distinct="encounterid")


@register("dual_coding_system_count")
def q_dual_coding_system_count(spark, sf):
    """[C7] persons with a kidney code under ICD-10 or ICD-9 rules."""
    return concepts.count_by_code_rules(lens.condition(spark, sf), "conditioncode",
                                        [([K.ICD10CM], K.KIDNEY_ICD10_PATTERN), (K.ICD9CM, K.KIDNEY_ICD9_PATTERN)],
                                        ["personid"], ["n_persons"])


@register("code_pattern_count")
def q_code_pattern_count(spark, sf):
    """[E4 J19] persons and encounters with a stroke code (either coding)."""
    return concepts.count_by_code_pattern(lens.condition(spark, sf), "conditioncode", K.STROKE_PATTERN,
                                          ["personid", "encounterid"], ["n_persons", "n_encounters"])


@register("open_interval_share")
def q_open_interval_share(spark, sf):
    """[J12 C8 E17]"""
    return concepts.open_interval_share(lens.procedure(spark, sf))


# ---------------------------------------------------------------------------
# 2.4 joins
# ---------------------------------------------------------------------------
@register("inner_join_person")
def q_inner_join_person(spark, sf):
    """[D1] inpatient encounters x demographics, flattened."""
    return cohort.encounter_person(lens.encounter(spark, sf), lens.demographics(spark, sf), "Inpatient",
                                   with_locations=False)


@register("panel_inner")
def q_panel_inner(spark, sf):
    """[D4 J13] hours with all six vitals, int casts."""
    return vitals_panel(spark, sf, "inner")


@register("panel_outer")
def q_panel_outer(spark, sf):
    """[D5 J13] full outer join of the six vitals."""
    return vitals_panel(spark, sf, "outer")


@register("panel_spine_left")
def q_panel_spine_left(spark, sf):
    """[D6 J13] left joins from the distinct key spine."""
    return vitals_panel(spark, sf, "spine")


@register("panel_from_long")
def q_panel_from_long(spark, sf):
    """[E8 rewrite of D5] the outer panel as one aggregation of the long table."""
    return vitals_wide(spark, sf, "outer")


@register("key_spine_all")
def q_key_spine_all(spark, sf):
    """[H1] UNION ALL of the six key sets (duplicates kept, as written)."""
    t = lens.vital_tables(spark, sf)
    return panel.key_spine(list(t.values()), distinct=False)


@register("key_spine_distinct")
def q_key_spine_distinct(spark, sf):
    """[H1] distinct key spine."""
    t = lens.vital_tables(spark, sf)
    return panel.key_spine(list(t.values()), distinct=True)


@register("tenant_semi_join")
def q_tenant_semi_join(spark, sf):
    """[D8] encounters at tenants having an ICU location; the tenants come from the stay rows, no array is folded."""
    e = lens.encounter(spark, sf).select("encounterid", "tenant")
    wards = lens.locations(spark, sf).where(F.col("name").rlike("ICU")).select("encounterid")
    return e.join(e.join(wards, "encounterid", "left_semi").select("tenant").distinct(), "tenant", "left_semi").select("encounterid", "tenant")


@register("attach_latest")
def q_attach_latest(spark, sf):
    """[D10 as written] latest admission attached to every inpatient encounter."""
    e = cohort.encounter_person(lens.encounter(spark, sf), lens.demographics(spark, sf), "Inpatient",
                                with_locations=False)
    return (cohort.attach_latest(e, "personid", "hospitalizationstartdate", "latest_admission")
            .select("personid", "encounterid", "birthdate", "hospitalizationstartdate", "latest_admission"))


@register("keep_latest")
def q_keep_latest(spark, sf):
    """[D10 as meant] only the latest admission rows (ties kept)."""
    e = cohort.encounter_person(lens.encounter(spark, sf), lens.demographics(spark, sf), "Inpatient",
                                with_locations=False)
    return (cohort.keep_latest(e, "personid", "hospitalizationstartdate")
            .select("personid", "encounterid", "birthdate", "hospitalizationstartdate"))


# ---------------------------------------------------------------------------
# 2.5 aggregations
# ---------------------------------------------------------------------------
@register("group_count")
def q_group_count(spark, sf):
    """[E2] cohort rows by sex."""
    return cohort_frame(spark, sf).groupBy("sex").agg(F.count(F.lit(1)).cast("bigint").alias("count"))


@register("distinct_count_by_class")
def q_distinct_count_by_class(spark, sf):
    """[E3 J19] distinct encounters per encounter class, most frequent first."""
    return concepts.frequency(lens.encounter(spark, sf), "classification.standard.primaryDisplay", "encounterid",
                              "primaryDisplay", "n_encounters")


@register("multi_distinct_by_type")
def q_multi_distinct_by_type(spark, sf):
    """[E4] distinct patients, encounters and tenants per class in one aggregation."""
    e = lens.encounter(spark, sf).withColumn("encountertype", F.col("classification.standard.primaryDisplay"))
    return cohort.distinct_counts_by(e, "encountertype")


@register("single_valued_attribute")
def q_single_valued_attribute(spark, sf):
    """[E6] persons under 18 at 2019-01-01 with exactly one distinct birth date."""
    d = lens.demographics(spark, sf)
    young = (F.datediff(F.lit("2019-01-01").cast("date"), F.to_date(F.col("birthdate").try_cast("timestamp_ntz")))
             / F.lit(365.25) < 18)
    return cohort.single_valued(d, "personid", "birthdate", where=young)


@register("pivot_indicator")
def q_pivot_indicator(spark, sf):
    """[E8] person x encounter-class 0/1 matrix (fixed value list)."""
    e = lens.encounter(spark, sf).select("personid", F.col("classification.standard.primaryDisplay").alias("cls"))
    return pivot_indicator(e, ["personid"], "cls", CLASS_NAMES)


@register("pivot_sum")
def q_pivot_sum(spark, sf):
    """[E8] person x vital sum of hourly values (fixed value list)."""
    v = lens.vitals_long(spark, sf).withColumn("value", to_int_lenient("value"))
    return pivot_sum(v, ["personid"], "vital", VITALS, "value")


@register("null_profile")
def q_null_profile(spark, sf):
    """[E9] null count per column of the outer panel."""
    return profile.null_profile(vitals_panel(spark, sf, "outer"))


@register("age_moments")
def q_age_moments(spark, sf):
    """[E11] mean / sample sd of age in the cohort."""
    m = profile.moments(cohort_frame(spark, sf), "age")
    return m.select(F.round("mean_age", 6).alias("mean_age"), F.round("stddev_age", 6).alias("stddev_age"))


@register("concept_vocabulary")
def q_concept_vocabulary(spark, sf):
    """[E12] distinct condition classification displays."""
    return (lens.condition(spark, sf)
            .select(F.col("classification.standard.primaryDisplay").alias("primaryDisplay")).distinct())


@register("quantile_bounds")
def q_quantile_bounds(spark, sf):
    """[E14] exact 1% / 99% quantiles of each vital (inner panel)."""
    return profile.quantile_bounds(vitals_panel(spark, sf, "inner"), VITALS)


@register("equal_width_histogram")
def q_equal_width_histogram(spark, sf):
    """[E15] 18 equal-width bins over event values."""
    h = profile.histogram(read(spark, sf, "events"), "value", 18)
    return h.select("bin", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"), "count")


@register("boxplot_stats")
def q_boxplot_stats(spark, sf):
    """[E16] box-plot statistics of each vital by outcome."""
    return profile.box_stats(labelled_hours(spark, sf), VITALS, "outcome_tx_ICU", "Vitals")


# ---------------------------------------------------------------------------
# 2.6-2.8 windows, sort, set ops
# ---------------------------------------------------------------------------
@register("first_observation")
def q_first_observation(spark, sf):
    """[F1 J15] earliest labelled hour per person with patient features."""
    f = first_hours(spark, sf)
    return f.select("personid", "encounterid", "hour_mark", "outcome_tx_ICU", *VITALS, "age", "gender")


@register("frequency_ranking")
def q_frequency_ranking(spark, sf):
    """[G1 J19] distinct encounters per financial class."""
    return concepts.frequency(lens.encounter(spark, sf), "financialclass.standard.primarydisplay", "encounterid",
                              "financialclass", "nEncounters")


@register("active_person_count")
def q_active_person_count(spark, sf):
    """[E3 J19] distinct persons by active flag."""
    return (lens.demographics(spark, sf).groupBy("active")
            .agg(F.count_distinct("personid").cast("bigint").alias("n_persons")))


@register("top_k_concepts")
def q_top_k_concepts(spark, sf):
    """[G3] 20 most frequent condition codes by distinct encounters (ties by code)."""
    c = concepts.concept_search(lens.condition(spark, sf), "conditioncode", count_distinct="encounterid")
    return concepts.top_k(c, 20, [F.desc("n"), F.asc("id"), F.asc("display")])


# ---------------------------------------------------------------------------
# 2.9 scalar functions
# ---------------------------------------------------------------------------
@register("age_years")
def q_age_years(spark, sf):
    """[§2.9] floor(datediff(as_of, birth)/365.25)."""
    d = lens.demographics(spark, sf)
    return d.select("personid", "birthdate", age_years("birthdate", DEFAULT_AS_OF).alias("age"))


@register("hours_between")
def q_hours_between(spark, sf):
    """[§2.9] ICU stay length in hours."""
    s = stays(spark, sf)
    return s.select("personid", "encounterid", "icu_start",
                    F.round(hours_between("icu_start", "icu_end"), 6).alias("hours"))


@register("encounter_type_case")
def q_encounter_type_case(spark, sf):
    """[§2.9] ordered regex CASE over encounter class (no ELSE)."""
    e = lens.encounter(spark, sf)
    return (e.groupBy(cohort.encounter_type(F.col("classification.standard.primaryDisplay")).alias("encounterType"))
            .agg(F.count_distinct("encounterid").cast("bigint").alias("nEncs")))


# ---------------------------------------------------------------------------
# 2.10 statistical learning and evaluation
# ---------------------------------------------------------------------------
@register("hash_split")
def q_hash_split(spark, sf):
    """[K2] deterministic 67/33 split on the integer key."""
    return models.hash_split(docs(spark, sf), "doc_id").select("doc_id", "y", "is_test")


@register("no_skill_auc")
def q_no_skill_auc(spark, sf):
    """[K6]"""
    return metrics.no_skill_auc(docs(spark, sf), "y")


@register("roc_auc")
def q_roc_auc(spark, sf):
    """[K7] AUC of document length for the quality label (ties midranked)."""
    return metrics.roc_auc(docs(spark, sf), "y", "score")


@register("roc_auc_continuous")
def q_roc_auc_continuous(spark, sf):
    """[K7] AUC of an event's value for the error type: thousands of different scores."""
    e = read(spark, sf, "events").select((F.col("event_type") == "error").cast("int").alias("y"), "value")
    return metrics.roc_auc(e, "y", "value")


@register("roc_curve")
def q_roc_curve(spark, sf):
    """[K8]"""
    return metrics.roc_curve(docs(spark, sf), "y", "score")


@register("confusion_matrix")
def q_confusion_matrix(spark, sf):
    """[K9] prediction = length >= threshold."""
    d = docs(spark, sf).withColumn("prediction", F.when(F.col("score") >= DOC_THRESHOLD, 1).otherwise(0))
    return metrics.confusion_matrix(d, "y", "prediction")


@register("classification_report")
def q_classification_report(spark, sf):
    """[K10]"""
    d = docs(spark, sf).withColumn("prediction", F.when(F.col("score") >= DOC_THRESHOLD, 1).otherwise(0))
    return metrics.classification_report(d, "y", "prediction")


@register("threshold_table")
def q_threshold_table(spark, sf):
    """[K15] pred_table(0.3) of a length-derived probability."""
    d = docs(spark, sf)
    mx = d.agg(F.max("score")).scalar()
    return metrics.threshold_table(d.withColumn("probability", F.col("score") / mx), "y", "probability", 0.3)


@register("logit_inference")
def q_logit_inference(spark, sf):
    """[K14] no-intercept logit on source indicators, one row for every source.

    Closed form: coef = ln(p / (1 - p)), std_err = sqrt(1/n_pos + 1/n_neg).  A source whose labels are all equal has no
    finite estimate: its row holds nulls.  The indicators are orthogonal, so those rows don't bear on the others' fit.
    """
    d = docs(spark, sf)
    by = d.groupBy("source").agg(F.avg("y").alias("p"))
    mixed = (F.col("p") > 0) & (F.col("p") < 1)
    sources = sorted(r[0] for r in by.where(mixed).select("source").collect())  # the columns of the model
    t = models.logit_inference(models.one_hot(d.where(F.col("source").isin(sources)), "source", sources), "y", sources,
                               fit_intercept=False, digits=3)
    none = F.lit(None).cast("double")
    return (t.select("term", "coef", "std_err")
            .unionByName(by.where(~mixed).select(F.col("source").alias("term"), none.alias("coef"), none.alias("std_err"))))


@register("logistic_l2")
def q_logistic_l2(spark, sf):
    """[K3 K4 K5] L2 logistic regression (C = 1) on length features: coefficients and test metrics."""
    d = models.hash_split(docs(spark, sf).withColumn("log_len", F.log1p("score")), "doc_id")
    a = models.assemble(d, ["log_len"])
    train, test = a.where("is_test = 0"), a.where("is_test = 1")
    m = models.fit_logistic(train, "y")
    p = models.with_probability(m, test)
    acc = metrics.accuracy(p, "y", "prediction").select(F.lit("accuracy").alias("metric"), F.round("accuracy", 6).alias("value"))
    auc = metrics.roc_auc(p, "y", "probability_1").select(F.lit("auc").alias("metric"), F.col("auc").alias("value"))
    fitted = spark.createDataFrame([("intercept", round(float(m.intercept), 3)), ("log_len", round(float(m.coefficients[0]), 3))],
                                   "metric string, value double")
    return acc.unionByName(auc).unionByName(fitted)


def model_columns(spark, sf):
    """[K1 K2] the trimmed model input with its 25 feature columns, label ``y`` and ``is_test``, written once."""
    from .icu_model import model_features, model_input
    d = models.hash_split(model_input(spark, sf), "personid").withColumnRenamed("outcome_tx_ICU", "y")
    return materialize(d.select("personid", "y", *model_features(), "is_test")), model_features()


def _test_metrics(p):
    acc = metrics.accuracy(p, "y", "prediction").select(F.lit("accuracy").alias("metric"), F.col("accuracy").alias("value"))
    auc = metrics.roc_auc(p, "y", "probability_1").select(F.lit("auc").alias("metric"), F.col("auc").alias("value"))
    return acc.unionByName(auc)


@register("gbt_fit")
def q_gbt_fit(spark, sf, n_estimators=1000, learning_rate=0.01, max_depth=6):
    """[K11] gradient-boosted trees on the model input at the analysis' own settings, test accuracy and AUC."""
    d, features = model_columns(spark, sf)
    m = boosting.fit(d.where("is_test = 0"), "y", features, "personid", n_estimators, learning_rate, max_depth)
    return _test_metrics(materialize(m.transform(d.where("is_test = 1")).select("y", "prediction", "probability_1")))


@register("learning_rate_sweep")
def q_learning_rate_sweep(spark, sf, n_estimators=1000, max_depth=3):
    """[K12 A5] accuracy at the six learning rates of the analysis: 1000 trees of depth 3, two features a split."""
    d, features = model_columns(spark, sf)
    found = boosting.sweep(d.where("is_test = 0"), "y", features, "personid", [0.05, 0.1, 0.25, 0.5, 0.75, 1.0],
                           n_estimators, max_depth, 2)

    def right(part):
        return F.avg(F.when(F.col("is_test") == part, (F.col("prediction") == F.col("y")).cast("double")))

    out = None
    for rate, m in found.items():
        one = m.transform(d).agg(right(0).alias("train_accuracy"), right(1).alias("test_accuracy")).select(
            F.lit(rate).alias("learning_rate"), "train_accuracy", "test_accuracy")
        out = one if out is None else out.unionByName(one)
    return materialize(out)


# The grid of the analysis.
GRID = {"learning_rate": [0.001, 0.01, 0.05, 0.1, 1], "max_depth": [2, 3, 5, 8, 10], "max_features": ["log2", "sqrt"],
        "n_estimators": [100, 200, 300, 500, 1000, 2000, 3000]}


@register("grid_search_cv")
def q_grid_search_cv(spark, sf, grid=None, folds=5):
    """[K13] mean accuracy over five folds of all 350 configurations of the analysis."""
    d, features = model_columns(spark, sf)
    return boosting.grid_search(d.where("is_test = 0"), "y", features, "personid", **(grid or GRID), folds=folds)[0]


@register("grid_best_report")
def q_grid_best_report(spark, sf, grid=None, folds=5):
    """[K13 K8 K9 K10] the best configuration refitted on all training rows: confusion cells, report and AUC on the test part.

    The grid's fits are shared with ``grid_search_cv`` through the checkpoint folder.
    """
    d, features = model_columns(spark, sf)
    _, m = boosting.grid_search(d.where("is_test = 0"), "y", features, "personid", **(grid or GRID), folds=folds)
    p = materialize(m.transform(d.where("is_test = 1")).select("y", "prediction", "probability_1"))
    cells = metrics.confusion_matrix(p, "y", "prediction").select(
        F.concat(F.lit("confusion "), F.col("actual"), F.lit(" "), F.col("predicted")).alias("metric"), F.col("count").cast("double").alias("value"))
    r = metrics.classification_report(p, "y", "prediction")
    report = r.unpivot(["label"], ["precision", "recall", "f1_score"], "part", "value").select(
        F.concat_ws(" ", "part", "label").alias("metric"), "value")
    return cells.unionByName(report).unionByName(_test_metrics(p))


@register("logit_model_input")
def q_logit_model_input(spark, sf):
    """[K14] unregularised logit without intercept on all rows of the 25-column input: coefficients, errors, z, p."""
    d, features = model_columns(spark, sf)
    return logit.fit(d, "y", features).table(d)


@register("logit_threshold_table")
def q_logit_threshold_table(spark, sf):
    """[K15] confusion cells of that fit at a threshold of 0.3, and the precision."""
    d, features = model_columns(spark, sf)
    p = materialize(d.withColumn("p", logit.fit(d, "y", features).probability()).select("y", "p"))
    cells = metrics.threshold_table(p, "y", "p", 0.3).select(
        F.concat(F.lit("actual "), F.col("actual"), F.lit(" predicted "), F.col("predicted")).alias("metric"), F.col("count").cast("double").alias("value"))
    hit = F.col("p") > 0.3
    precision = p.agg(F.try_divide(F.sum(F.when(hit & (F.col("y") == 1), 1.0).otherwise(0.0)), F.count(F.when(hit, 1)).cast("double")).alias("value"))
    return cells.unionByName(precision.select(F.lit("precision").alias("metric"), "value"))


# ---------------------------------------------------------------------------
# 2.11 composite queries
# ---------------------------------------------------------------------------
@register("condition_matrix")
def q_condition_matrix(spark, sf):
    """[J1]"""
    return matrix(spark, sf)


@register("condition_prevalence")
def q_condition_prevalence(spark, sf):
    """[J2]"""
    return condition_prevalence(matrix(spark, sf))


@register("pediatric_icu_cohort")
def q_pediatric_icu_cohort(spark, sf):
    """[J3]"""
    return cohort_frame(spark, sf).select(
        "personid", "encounterid", "tenant", "payer", "admissionsource", "status", "sex", "race", "ethnicity",
        "encounterLocations", "hospitalizationstartdate", "latest_admission", "birthday", "age")


@register("pediatric_icu_cohort_latest")
def q_pediatric_icu_cohort_latest(spark, sf):
    """[J3 D10 as meant] the cohort restricted to each person's latest admission (ties kept)."""
    c = cohort.pediatric_icu_cohort(lens.encounter(spark, sf, with_locations=True), lens.demographics(spark, sf),
                                    as_of=DEFAULT_AS_OF, latest="keep")
    return c.select("personid", "encounterid", "tenant", "payer", "admissionsource", "status", "sex", "race",
                    "ethnicity", "encounterLocations", "hospitalizationstartdate", "birthday", "age")


@register("age_histogram")
def q_age_histogram(spark, sf):
    """[J4] 18 bins over non-negative cohort ages."""
    h = profile.histogram(cohort_frame(spark, sf), "age", 18, drop_negative=True)
    return h.select("bin", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"), "count")


@register("negative_age_rows")
def q_negative_age_rows(spark, sf):
    """[J4 C6] cohort rows with a negative age (reported, then excluded)."""
    c = cohort_frame(spark, sf)
    return c.agg(F.count(F.when(F.col("age") < 0, F.lit(1))).cast("bigint").alias("n_negative"),
                 F.min("age").cast("int").alias("min_age"))


@register("demographic_profile")
def q_demographic_profile(spark, sf):
    """[J5 C5 E1 E11] cohort size, race pattern counts and age moments in one pass."""
    c = cohort_frame(spark, sf)
    race = F.col("race")
    aggs = [F.count(F.lit(1)).cast("bigint").alias("n_rows")]
    for name, pat in RACE_PATTERNS:
        cond = race.like(pat)
        if name == "n_black":
            cond = cond | race.like(AFRICAN_AMERICAN_EXACT)
        aggs.append(F.count(F.when(cond, F.lit(1))).cast("bigint").alias(name))
    aggs += [F.round(F.avg("age"), 6).alias("mean_age"), F.round(F.stddev_samp("age"), 6).alias("stddev_age")]
    return c.agg(*aggs)


@register("lab_wide_sum")
def q_lab_wide_sum(spark, sf):
    """[J6] person x lab type, sum of lenient int values."""
    l = pick(lens.lab(spark, sf), {"Type": "labcode.standard.primaryDisplay", "value": "typedvalue.numericValue.value"},
             keep=("personid", "issueddate"))
    return pivot_sum(l.withColumn("value", to_int_lenient("value")), ["personid"], "Type", pivot_values(l, "Type"), "value")


@register("lab_wide_latest")
def q_lab_wide_latest(spark, sf):
    """[J6 as meant] same, restricted to each person's latest issued time."""
    l = pick(lens.lab(spark, sf), {"Type": "labcode.standard.primaryDisplay", "value": "typedvalue.numericValue.value"},
             keep=("personid", "issueddate"))
    names = pivot_values(l, "Type")
    l = cohort.keep_latest(l, "personid", "issueddate")
    return pivot_sum(l.withColumn("value", to_int_lenient("value")), ["personid"], "Type", names, "value")


@register("lab_positive_flag")
def q_lab_positive_flag(spark, sf):
    """[J7 E7] COVID positivity per person / encounter / date over both COVID value sets."""
    return concepts.positive_flag(lens.lab(spark, sf), ids=K.COVID_LAB_CODES_1 + K.COVID_LAB_CODES_2)


@register("covid_positive_assays")
def q_covid_positive_assays(spark, sf):
    """[J7] assay names with at least one positive result."""
    return concepts.positive_assays(lens.lab(spark, sf), K.COVID_LAB_NAME_PATTERN)


@register("reference_range_values")
def q_reference_range_values(spark, sf):
    """[B1 J8] distinct upper reference values of one assay (4-level nested path)."""
    l = lens.lab(spark, sf).where(F.col("labcode.standard.id") == K.UREA_NITROGEN_CODE)
    return l.select(F.col("referencerange.typedreferencehighvalue.numericvalue.value").alias("value")).distinct()


@register("encounters_after_first_qualifying")
def q_encounters_after_first_qualifying(spark, sf):
    """[J9 D9] encounters after each child's first qualifying date, by type."""
    q = lens.qualified_encounter(spark, sf)
    qual = (F.col("age_at_encounter") < 18) & ((F.col("dx_qual_ind") == 1) | (F.col("lab_qual_ind") == 1))
    return cohort.after_first(q, "personid", "servicedate", qual, "encountertype")


@register("qualified_encounters_by_type")
def q_qualified_encounters_by_type(spark, sf):
    """[J9 E4 A1 A2 A4] qualified encounters by type: distinct tenants, patients, encounters; the
    encounter table is read by its database-qualified name (``global_temp.qualified_encounter``)."""
    db, name = publish(lens.qualified_encounter(spark, sf), "qualified_encounter").split(".")
    q = table(spark, name, db)
    return cohort.distinct_counts_by(q, "encountertype",
                                     where=(F.col("dx_qual_ind") == 1) | (F.col("lab_qual_ind") == 1))


@register("pediatric_crosstab")
def q_pediatric_crosstab(spark, sf):
    """[J10] distinct patients / encounters by encounter type x paediatric flag."""
    ab = cohort.pediatric_flags(lens.demographics(spark, sf), lens.encounter(spark, sf))
    ab = ab.withColumn("encounterType", cohort.encounter_type(F.col("primaryDisplay")))
    return cohort.distinct_counts_by(ab, ["encounterType", "isPediatric"], ("personid", "encounterid"),
                                     ("nPat", "nEncs"))


@register("pediatric_flag_counts")
def q_pediatric_flag_counts(spark, sf):
    """[J10] distinct patients / encounters by paediatric flag."""
    ab = cohort.pediatric_flags(lens.demographics(spark, sf), lens.encounter(spark, sf))
    return cohort.distinct_counts_by(ab, "isPediatric", ("personid", "encounterid"), ("nPat", "nEncs"))


@register("birth_year_crosstab")
def q_birth_year_crosstab(spark, sf):
    """[J10] distinct persons born before 2003 or not."""
    return cohort.birth_year_flag(lens.demographics(spark, sf), 2003)


@register("drug_during_procedure")
def q_drug_during_procedure(spark, sf):
    """[J11] drugs administered in encounters with CPT 61510 (array folded to text)."""
    d = concepts.drugs_during_procedure(lens.medication_administration(spark, sf), lens.procedure(spark, sf),
                                        K.CPT4, K.CRANIOTOMY_CPT, keep_encounter=True)
    return d.select("encounterid", F.concat_ws(";", "drugcode").alias("drugcode"), "startdate", "endDate")


@register("sedation_during_procedure")
def q_sedation_during_procedure(spark, sf):
    """[J11] sedation drugs (by reference) in encounters with CPT 61510."""
    return concepts.drugs_during_procedure(
        lens.medication_administration(spark, sf), lens.procedure(spark, sf), K.CPT4, K.CRANIOTOMY_CPT,
        drug_path="drugreference.drugCode.standard.primaryDisplay", drug_pattern=K.SEDATION_DRUG_PATTERN,
        drug_as="drug", keep_encounter=True)


@register("drug_route_search")
def q_drug_route_search(spark, sf):
    """[J11] propofol given by an intravenous route."""
    return concepts.drug_route_search(lens.medication(spark, sf), "propofol", K.IV_ROUTE_PATTERN)


@register("icu_label_pairs")
def q_icu_label_pairs(spark, sf):
    """[J14 as written] hour x stays-ahead pairing, counted."""
    return label.label_pairs(vitals_wide(spark, sf, "inner"), stays(spark, sf))


@register("next_icu_stay")
def q_next_icu_stay(spark, sf):
    """[D7 J14] every hour with the next ICU stay of its encounter: start, end, hours to go; nulls where none follows."""
    hours = vitals_wide(spark, sf, "inner").select("personid", "encounterid", "hour_mark")
    return label.next_stay(hours, stays(spark, sf)).withColumn("hours_to_go", F.round("hours_to_go", 6))


@register("icu_label_next")
def q_icu_label_next(spark, sf):
    """[J14 as meant] one label per hour, never-ICU hours kept."""
    return label.label_next(vitals_wide(spark, sf, "inner"), stays(spark, sf))


@register("trim_cascade")
def q_trim_cascade(spark, sf):
    """[J16] sequential 1%/99% trim of the inner panel's vitals."""
    return profile.trim_cascade(materialize(vitals_panel(spark, sf, "inner")), TRIM_ORDER)


@register("patient_features")
def q_patient_features(spark, sf):
    """[J17 B5 D3]"""
    return features(spark, sf)


@register("model_input")
def q_model_input(spark, sf):
    """[J15 J16 J18 up to the fit] the trimmed first hours with label and the 25 features."""
    from .icu_model import model_input
    return model_input(spark, sf)


@register("model_class_counts")
def q_model_class_counts(spark, sf):
    """[J18] rows of the model input by label."""
    return q_model_input(spark, sf).groupBy("outcome_tx_ICU").agg(F.count(F.lit(1)).alias("n"))


@register("icu_model_metrics")
def q_icu_model_metrics(spark, sf):
    """[J18] the whole modelling workload; metrics as (metric, value)."""
    from .icu_model import icu_model_metrics
    return icu_model_metrics(spark, sf)


# ---------------------------------------------------------------------------
# further vocabulary / frequency cells of the analysis (same operators)
# ---------------------------------------------------------------------------
@register("encounter_type_frequency")
def q_encounter_type_frequency(spark, sf):
    """[J19 G1] distinct encounters per encounter type display."""
    return concepts.frequency(lens.encounter(spark, sf), "type.standard.primaryDisplay", "encounterid",
                              "primaryDisplay", "n_encounters")


@register("route_vocabulary")
def q_route_vocabulary(spark, sf):
    """[J8 E12] distinct medication routes (display, id)."""
    return concepts.concept_search(lens.medication(spark, sf), "route", display_as="route")


@register("medication_status_vocabulary")
def q_medication_status_vocabulary(spark, sf):
    """[E12 G2] distinct medication order statuses."""
    return lens.medication(spark, sf).select("status").distinct()


@register("procedure_code_search")
def q_procedure_code_search(spark, sf):
    """[J8 C3] ECMO procedures by code prefix alternation (ICD-10-PCS and CPT-4 prefixes)."""
    return concepts.concept_search(lens.procedure(spark, sf), "procedurecode", include=K.ECMO_PROCEDURE_PATTERN,
                                   case_insensitive=False, on="id", display_as="procedure", id_as="procedure_id")


@register("glomerular_lab_search")
def q_glomerular_lab_search(spark, sf):
    """[J8 C3] case-sensitive display search ('lomerular')."""
    return concepts.concept_search(lens.lab(spark, sf), "labcode", include="lomerular", case_insensitive=False)


@register("valueset_membership_small")
def q_valueset_membership_small(spark, sf):
    """[C2] labs in the 18-code value set: distinct (lab, id, interpretation, labvalue)."""
    l = concepts.concept_filter(lens.lab(spark, sf), "labcode", ids=K.COVID_LAB_CODES_1)
    return l.select(F.col("labcode.standard.primaryDisplay").alias("lab"), F.col("labcode.standard.id").alias("id"),
                    F.col("interpretation.standard.primaryDisplay").alias("interpretation"),
                    F.col("typedvalue.textValue.value").alias("labvalue")).distinct()


@register("all_class_cohort")
def q_all_class_cohort(spark, sf):
    """[J3 variant] encounter x demographics for every encounter class."""
    return cohort.encounter_person(lens.encounter(spark, sf), lens.demographics(spark, sf), None,
                                   with_locations=False)


@register("location_frequency")
def q_location_frequency(spark, sf):
    """[E2] cohort rows per folded location string."""
    return (cohort_frame(spark, sf).groupBy("encounterLocations")
            .agg(F.count(F.lit(1)).cast("bigint").alias("count")))


@register("sickle_cell_person_count")
def q_sickle_cell_person_count(spark, sf):
    """[E3] distinct persons with a sickle-cell code prefix."""
    return concepts.count_by_code_pattern(lens.condition(spark, sf), "conditioncode", K.SICKLE_CELL_PATTERN,
                                          ["personid"], ["n_persons"])


def queries() -> dict[str, Query]:
    return dict(REGISTRY)
