"""Clinical-shaped views over the driver's star-schema tables.

The clinical extract the operators were designed for is not available, so
this module derives tables with the same *shape* (nested coded concepts,
arrays of structs, string timestamps, per-vital feature tables) from the
driver tables.  Every derivation is a deterministic rule on existing columns
and every table grows with its source, so all registered queries scale with
the inputs.  The mapping tables below are fixed values of the lens; the SQL
oracle (``plans/oracle.py``) renders the very same tables into DuckDB SQL.

Operators never depend on this module: they take DataFrames + column names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.nested import concept
from .tables import by_key, read

TS_FMT = "yyyy-MM-dd HH:mm:ss"
DATE_FMT = "yyyy-MM-dd"

# ---------------------------------------------------------------------------
# Fixed values of the lens.
# ---------------------------------------------------------------------------
BIRTH_BASE = "1995-01-01"          # birthdate = base + (personid * step) mod spread days
BIRTH_STEP = 37
BIRTH_SPREAD = 10000
CONFLICT_SHIFT_DAYS = 366          # second, conflicting birth record (negative balance)
ENCOUNTER_SHIFT_DAYS = 7305        # order dates 1995-2001 -> encounters 2015-2021
DISCHARGE_DAYS = 3
WEEK_BASE = "2024-01-01"           # event encounters = (user, week since base)
ENCOUNTER_PER_PERSON = 1000
TENANTS = 5000                     # tenant = customer mod 5000

SEX_SYSTEM = "2.16.840.1.113883.5.1"
SEGMENT_RACE = (
    ("AUTOMOBILE", "Asian"),
    ("BUILDING", "White"),
    ("FURNITURE", "Black or African American"),
    ("HOUSEHOLD", "Hispanic"),
    ("MACHINERY", "Caucasian"),
)
NATION_RACE = (  # (nationkey upper bound exclusive, race)
    (5, "American Indian or Alaska Native"),
    (10, "White"),
    (15, "Other Race"),
    (20, "Native Hawaiian or Other Pacific Islander"),
    (25, "Mixed racial group"),
)
PRIORITY_CLASS = (
    ("1-URGENT", "Inpatient"),
    ("2-HIGH", "Emergency"),
    ("3-MEDIUM", "Outpatient"),
    ("4-NOT SPECIFIED", "Pediatric clinic"),
    ("5-LOW", "Observation"),
)
STATUS_NAME = (("F", "Finished"), ("O", "In progress"), ("P", "Planned"))
ENCOUNTER_TYPE = (("F", "Admission"), ("O", "Visit"), ("P", "Pre-admission"))
ADMISSION_SOURCE = (("F", "Physician referral"), ("O", "Emergency room"), ("P", "Transfer from hospital"))
PAYER_BANDS = ((50000.0, "Self pay"), (150000.0, "Medicaid"), (300000.0, "Commercial"))
PAYER_TOP = "Medicare"
LOCATION_BANDS = ((4.0, "PICU"), (8.0, "NICU"))  # by line quantity, then by return flag
LOCATION_BY_FLAG = (("A", "Med Surg"), ("N", "Emergency Department"))
LOCATION_OTHER = "Ward 5 East"
ICD9_SYSTEMS = {"F": "2.16.840.1.113883.6.103", "O": "2.16.840.1.113883.6.2"}
ICD10_SYSTEM = "2.16.840.1.113883.6.90"
# (event_type, low code, low display, high code, high display); high = value >= 100
LAB_TYPES = (
    ("view", "2951-2", "Sodium [Moles/volume] in Serum or Plasma",
     "2823-3", "Potassium [Moles/volume] in Serum or Plasma"),
    ("click", "94500-6", "SARS-CoV-2 (COVID-19) RNA [Presence] in Respiratory specimen by NAA with probe detection",
     "94309-2", "SARS-CoV-2 (COVID-19) RNA [Presence] in Specimen by NAA with probe detection"),
    ("purchase", "33914-3", "Glomerular filtration rate/1.73 sq M.predicted [Volume Rate/Area] in Serum or Plasma",
     "3094-0", "Urea nitrogen [Mass/volume] in Serum or Plasma"),
    ("signup", "94509-7", "SARS coronavirus 2 N gene [Cycle Threshold #] in Specimen by NAA with probe detection",
     "92131-2", "Respiratory syncytial virus RNA [Presence] in Respiratory specimen by NAA with probe detection"),
    ("error", "80382-5", "Influenza virus A Ag [Presence] in Upper respiratory specimen by Rapid immunoassay",
     "718-7", "Hemoglobin [Mass/volume] in Blood"),
)
LAB_SYSTEM = "2.16.840.1.113883.6.1"
INTERPRETATION_BANDS = ((20.0, "Normal"), (50.0, "Abnormal"), (150.0, "Above high normal"), (250.0, None))
INTERPRETATION_TOP = "Positive"
TEXT_RESULT_TYPES = ("click", "error")
TEXT_RESULT_BANDS = ((100.0, "Not detected"), (200.0, "Detected"))
TEXT_RESULT_TOP = "Positive"
UNPARSABLE_FROM = 400.0            # numeric result text becomes 'see note'
DRUGS = (  # (rxnorm-like id, display) chosen by partkey mod 10
    ("1808217", "propofol 10 MG/ML Injectable Suspension"),
    ("1736854", "fentaNYL 0.05 MG/ML Injectable Solution"),
    ("871720", "magnesium sulfate 500 MG/ML Injectable Solution"),
    ("316945", "magnesium oxide 400 MG Oral Tablet"),
    ("1732136", "morphine sulfate 2 MG/ML Injectable Solution"),
    ("313782", "acetaminophen 325 MG Oral Tablet"),
    ("1721456", "sevoflurane 250 ML Inhalant Solution"),
    ("1247397", "magnesium hydroxide 80 MG/ML Oral Suspension"),
    ("312086", "ondansetron 4 MG Oral Tablet"),
    ("1234920", "Magnesium Citrate 58 MG/ML Oral Solution"),
)
DRUG_SYSTEM = "2.16.840.1.113883.6.88"
ROUTES = ("Intravenous", "Oral", "IV Push", "Continuous infusion", "Inhalation", "Oral", "Subcutaneous")
MED_STATUS = (("F", "completed"), ("O", "active"))
PROCEDURES = (  # chosen by orderkey mod 10
    ("61510", "Craniectomy, trephination, bone flap craniotomy; for excision of brain tumor", "2.16.840.1.113883.6.12"),
    ("33946", "Extracorporeal membrane oxygenation (ECMO) initiation, veno-venous", "2.16.840.1.113883.6.12"),
    ("5A1522F", "Extracorporeal Oxygenation, Membrane, Central", "2.16.840.1.113883.6.4"),
    ("99213", "Office or other outpatient visit, established patient", "2.16.840.1.113883.6.12"),
    ("36556", "Insertion of non-tunneled centrally inserted central venous catheter", "2.16.840.1.113883.6.12"),
    ("5A15223", "Extracorporeal Oxygenation, Membrane, Continuous", "2.16.840.1.113883.6.4"),
    ("71045", "Radiologic examination, chest; single view", "2.16.840.1.113883.6.12"),
    ("33952", "ECMO insertion of peripheral arterial and/or venous cannula(e)", "2.16.840.1.113883.6.12"),
    ("0BH17EZ", "Insertion of Endotracheal Airway into Trachea", "2.16.840.1.113883.6.4"),
    ("94002", "Ventilation assist and management, initiation of pressure or volume preset ventilators",
     "2.16.840.1.113883.6.12"),
)
# Vitals measured at an event, by event type (error events are ICU transfers).
VITALS = ("respiratory_rate", "heart_rate", "diastolic_blood_pressure",
          "systolic_blood_pressure", "temperature", "spo2")
VITALS_BY_EVENT = (
    ("view", VITALS),
    ("click", ("respiratory_rate", "heart_rate", "diastolic_blood_pressure",
               "systolic_blood_pressure", "spo2")),
    ("purchase", ("respiratory_rate", "heart_rate", "temperature", "spo2")),
    ("signup", ("heart_rate", "temperature")),
)
# An event belongs to one of EVENT_PERSONS persons of its user, so that there are as many persons as customers.
EVENT_PERSONS = 10
# vital = base + sign * ((hundredths of the event's value * factor) mod span): prime spans make the vitals independent
VITAL_FORMULA = {
    "respiratory_rate": (8, 1, 19, 47),
    "heart_rate": (60, 1, 31, 97),
    "diastolic_blood_pressure": (40, 1, 7, 61),
    "systolic_blood_pressure": (80, 1, 23, 83),
    "temperature": (80, 1, 11, 41),
    "spo2": (100, -1, 13, 37),
}
# A complete measurement ("view") sends the person to the ICU half an hour into its hour if the part of the heart rate
# above its base, plus a disturbance of 0, STEP or 2 * STEP by event id, reaches LEAST: a signal with noise.
ICU_EVENT, ICU_LEAST, ICU_STEP = "view", 110, 20
EVENT_LOCATION = (("error", "PICU"), ("signup", "Emergency Department"), ("purchase", "Radiology"))
EVENT_LOCATION_OTHER = "Ward 4 West"
PANEL_KEYS = ("personid", "encounterid", "hour_mark")


# ---------------------------------------------------------------------------
# small Column builders
# ---------------------------------------------------------------------------
def _case(col: Column, pairs, default=None) -> Column:
    out = None
    for k, v in pairs:
        cond = col == F.lit(k)
        out = F.when(cond, F.lit(v)) if out is None else out.when(cond, F.lit(v))
    return out.otherwise(F.lit(default)) if default is not None else out


def _bands(col: Column, bands, top) -> Column:
    out = None
    for bound, v in bands:
        cond = col < F.lit(bound)
        val = F.lit(v).cast("string")
        out = F.when(cond, val) if out is None else out.when(cond, val)
    return out.otherwise(F.lit(top))


def _pick(values, index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), index.cast("int") + 1)


def _fmt_shift(ts: Column, days: int | Column) -> Column:
    return F.date_format(F.date_add(F.to_date(ts), days), TS_FMT)


def event_encounter(user: Column, ts: Column) -> Column:
    """(user, week since WEEK_BASE) -> encounter id."""
    week = F.floor(F.datediff(F.to_date(ts), F.lit(WEEK_BASE).cast("date")) / F.lit(7.0))
    return (user * F.lit(ENCOUNTER_PER_PERSON) + week).cast("bigint")


# ---------------------------------------------------------------------------
# person level
# ---------------------------------------------------------------------------
def demographics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """personid, birthdate (string), birthsex, races, ethnicities, active.

    Persons with a negative account balance carry a second, conflicting birth
    record (as multi-source registries do); their races are NULL.  Balances
    in [0, 100) give an empty race list.
    """
    c = read(spark, sf_dir, "customer")
    days = (F.col("c_custkey") * BIRTH_STEP % BIRTH_SPREAD).cast("int")
    shift = F.explode(F.when(F.col("c_acctbal") < 0, F.array(F.lit(0), F.lit(CONFLICT_SHIFT_DAYS)))
                      .otherwise(F.array(F.lit(0))))
    seg_race = _case(F.col("c_mktsegment"), SEGMENT_RACE)
    nat_race = _bands(F.col("c_nationkey"), NATION_RACE[:-1], NATION_RACE[-1][1])
    races = F.array(concept(seg_race, seg_race), concept(nat_race, nat_race))
    female = F.col("c_nationkey") % 2 == 0
    eth = F.when(F.col("c_nationkey") % 3 == 0, F.lit("Hispanic or Latino")).otherwise(F.lit("Not Hispanic or Latino"))
    return (c.select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment", days.alias("_d"), shift.alias("_s"))
            .select(
                F.col("c_custkey").alias("personid"),
                F.date_format(F.date_add(F.lit(BIRTH_BASE).cast("date"), F.col("_d") + F.col("_s")), TS_FMT)
                .alias("birthdate"),
                concept(F.when(female, "F").otherwise("M"), F.when(female, "Female").otherwise("Male"),
                        F.lit(SEX_SYSTEM)).alias("birthsex"),
                F.when(F.col("c_acctbal") < 0, F.when(F.lit(False), races))
                .when(F.col("c_acctbal") < 100, F.filter(races, lambda x: F.lit(False)))
                .otherwise(races).alias("races"),
                F.array(concept(eth, eth)).alias("ethnicities"),
                (F.col("c_acctbal") >= 0).alias("active"),
            ))


def patient_demographics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat person feature table: personid, gender, race, ethnicity (one row per person)."""
    c = read(spark, sf_dir, "customer")
    return c.select(
        F.col("c_custkey").alias("personid"),
        F.when(F.col("c_nationkey") % 2 == 0, "Female").otherwise("Male").alias("gender"),
        _case(F.col("c_mktsegment"), SEGMENT_RACE).alias("race"),
        F.when(F.col("c_nationkey") % 3 == 0, "Hispanic or Latino").otherwise("Not Hispanic or Latino")
        .alias("ethnicity"))


# ---------------------------------------------------------------------------
# encounter level
# ---------------------------------------------------------------------------
def encounter(spark: SparkSession, sf_dir: str, with_locations: bool = False) -> DataFrame:
    """One row per order: coded encounter attributes, string dates, arrays.

    ``with_locations`` adds ``locations: array<struct<seq, name, beginDate,
    endDate>>`` aggregated from the order's line items (one shuffle of
    lineitem on the order key, co-partitioned with the join to orders).
    """
    o = read(spark, sf_dir, "orders")
    start = F.col("o_orderdate")
    cls = _case(F.col("o_orderpriority"), PRIORITY_CLASS)
    etype = _case(F.col("o_orderstatus"), ENCOUNTER_TYPE)
    price = F.col("o_totalprice")
    payer = _bands(price, PAYER_BANDS, PAYER_TOP)
    reason = F.lower(F.substring(F.col("o_orderpriority"), 3, 100))
    enc = o.select(
        F.col("o_orderkey").alias("encounterid"),
        F.col("o_custkey").alias("personid"),
        (F.col("o_custkey") % TENANTS).alias("tenant"),
        concept(F.col("o_orderpriority"), cls).alias("classification"),
        concept(F.col("o_orderstatus"), etype).alias("type"),
        concept(F.col("o_orderstatus"), _case(F.col("o_orderstatus"), STATUS_NAME)).alias("status"),
        concept(F.col("o_orderpriority"), reason).alias("reasonforvisit"),
        concept(payer, payer).alias("financialclass"),
        concept(F.col("o_orderstatus"), _case(F.col("o_orderstatus"), ADMISSION_SOURCE)).alias("admissionsource"),
        _fmt_shift(start, ENCOUNTER_SHIFT_DAYS).alias("hospitalizationstartdate"),
        F.when(F.col("o_orderstatus") == "O", F.lit(None).cast("string"))
        .otherwise(_fmt_shift(start, ENCOUNTER_SHIFT_DAYS + DISCHARGE_DAYS)).alias("dischargedate"),
        _fmt_shift(start, ENCOUNTER_SHIFT_DAYS).alias("servicedate"),
        F.array(F.struct(concept(F.col("o_orderpriority"), cls).alias("classification")),
                F.struct(concept(F.col("o_orderstatus"), etype).alias("classification"))).alias("encountertypes"),
    )
    if not with_locations:
        return enc
    return enc.join(encounter_locations(spark, sf_dir), on="encounterid", how="left")


def location_name(quantity: Column, flag: Column) -> Column:
    out = None
    for bound, name in LOCATION_BANDS:
        cond = quantity <= F.lit(bound)
        out = F.when(cond, F.lit(name)) if out is None else out.when(cond, F.lit(name))
    for f, name in LOCATION_BY_FLAG:
        out = out.when(flag == F.lit(f), F.lit(name))
    return out.otherwise(F.lit(LOCATION_OTHER))


def encounter_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """encounterid, locations: every stay of the encounter, as a sorted array of
    struct(seq, name, beginDate, endDate).

    The nested array is the data model of the source; it holds one encounter's own stays.
    """
    li = read(spark, sf_dir, "lineitem")
    name = location_name(F.col("l_quantity"), F.col("l_returnflag"))
    stay = F.struct(
        F.col("l_linenumber").alias("seq"),
        name.alias("name"),
        _fmt_shift(F.col("l_shipdate"), ENCOUNTER_SHIFT_DAYS).alias("beginDate"),
        _fmt_shift(F.col("l_shipdate"), F.lit(ENCOUNTER_SHIFT_DAYS) + F.col("l_quantity").cast("int"))
        .alias("endDate"))
    return (li.select(F.col("l_orderkey").alias("encounterid"), stay.alias("stay")).groupBy("encounterid")
            .agg(F.sort_array(F.collect_list("stay")).alias("locations")))


def qualified_encounter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat encounter table of the second database: personid, tenant, encounterid,
    encountertype, servicedate (DATE), age_at_encounter, dx_qual_ind, lab_qual_ind."""
    o = read(spark, sf_dir, "orders")
    c = read(spark, sf_dir, "customer").select(
        F.col("c_custkey"),
        F.date_add(F.lit(BIRTH_BASE).cast("date"), (F.col("c_custkey") * BIRTH_STEP % BIRTH_SPREAD).cast("int"))
        .alias("birth"))
    svc = F.date_add(F.to_date("o_orderdate"), ENCOUNTER_SHIFT_DAYS)
    return (o.join(c, o.o_custkey == c.c_custkey, "inner")
            .select(F.col("o_custkey").alias("personid"),
                    (F.col("o_custkey") % TENANTS).alias("tenant"),
                    F.col("o_orderkey").alias("encounterid"),
                    _case(F.col("o_orderpriority"), PRIORITY_CLASS).alias("encountertype"),
                    svc.alias("servicedate"),
                    F.floor(F.datediff(svc, F.col("birth")) / F.lit(365.25)).cast("int").alias("age_at_encounter"),
                    F.when(F.col("o_totalprice") >= 300000, 1).otherwise(0).alias("dx_qual_ind"),
                    F.when((F.col("o_orderstatus") == "P") & F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), 1)
                    .otherwise(0).alias("lab_qual_ind")))


# ---------------------------------------------------------------------------
# event tables
# ---------------------------------------------------------------------------
def condition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """personid, encounterid, conditioncode, classification (one row per line item)."""
    li, o = by_key(spark, sf_dir, "lineitem", "l_orderkey",
                   read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_orderkey")
    letter = F.expr("char(65 + pmod(l_partkey, 26))")
    num = F.lpad((F.lit(2) * F.col("l_quantity") - 1).cast("int").cast("string"), 2, "0")
    code10 = F.concat(letter, num, F.lit("."), F.col("l_linenumber").cast("string"))
    code10 = F.when(F.col("l_linenumber") == 7, F.lower(code10)).otherwise(code10)
    code9 = F.concat((F.lit(400) + F.col("l_partkey") % 300).cast("string"), F.lit("."),
                     F.col("l_linenumber").cast("string"))
    icd9 = F.col("l_returnflag") == "R"
    code = F.when(icd9, code9).otherwise(code10)
    system = F.when(icd9, _case(F.col("l_linestatus"), tuple(ICD9_SYSTEMS.items()))).otherwise(F.lit(ICD10_SYSTEM))
    cls = F.when(F.col("l_linestatus") == "F", "Problem list").otherwise("Diagnosis")
    return (li.join(o, li.l_orderkey == o.o_orderkey, "inner")
            .select(F.col("o_custkey").alias("personid"),
                    F.col("l_orderkey").alias("encounterid"),
                    concept(code, F.concat(F.lit("Condition "), code), system).alias("conditioncode"),
                    concept(F.col("l_linestatus"), cls).alias("classification")))


def _lab_code(high: Column, which: int) -> Column:
    out = None
    for row in LAB_TYPES:
        et = row[0]
        val = F.when(high, F.lit(row[which + 2])).otherwise(F.lit(row[which]))
        cond = F.col("event_type") == F.lit(et)
        out = F.when(cond, val) if out is None else out.when(cond, val)
    return out


def lab(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lab results with typed value unions and reference ranges (one row per event)."""
    e = read(spark, sf_dir, "events")
    v = F.col("value")
    high = v >= 100
    interp = _bands(v, INTERPRETATION_BANDS, INTERPRETATION_TOP)
    numeric = (F.when(F.col("event_type") == "error", F.lit(None).cast("string"))
               .when(v >= UNPARSABLE_FROM, F.lit("see note"))
               .otherwise(v.cast("string")))
    text = F.when(F.col("event_type").isin(*TEXT_RESULT_TYPES), _bands(v, TEXT_RESULT_BANDS, TEXT_RESULT_TOP))
    high_ref = (F.lit(40) + F.lit(10) * F.floor(v / F.lit(100.0))).cast("string")
    return e.select(
        F.col("user_id").alias("personid"),
        event_encounter(F.col("user_id"), F.col("ts")).alias("encounterid"),
        F.date_format("ts", DATE_FMT).alias("servicedate"),
        F.date_format("ts", TS_FMT).alias("issueddate"),
        concept(_lab_code(high, 1), _lab_code(high, 2), F.lit(LAB_SYSTEM)).alias("labcode"),
        concept(interp, interp).alias("interpretation"),
        F.struct(F.struct(numeric.alias("value")).alias("numericValue"),
                 F.struct(text.alias("value")).alias("textValue")).alias("typedvalue"),
        F.struct(F.struct(F.struct(high_ref.alias("value")).alias("numericvalue"))
                 .alias("typedreferencehighvalue")).alias("referencerange"),
    )


def _drug(li_partkey: Column) -> Column:
    idx = li_partkey % len(DRUGS)
    return concept(_pick([d[0] for d in DRUGS], idx), _pick([d[1] for d in DRUGS], idx), F.lit(DRUG_SYSTEM))


def medication(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Medication orders: encounterid, drugcode, route, startdate, stopdate, status."""
    li = read(spark, sf_dir, "lineitem")
    route = _pick(ROUTES, F.col("l_linenumber") - 1)
    return li.select(
        F.col("l_orderkey").alias("encounterid"),
        _drug(F.col("l_partkey")).alias("drugcode"),
        concept(route, route).alias("route"),
        _fmt_shift(F.col("l_shipdate"), ENCOUNTER_SHIFT_DAYS).alias("startdate"),
        _fmt_shift(F.col("l_shipdate"), F.lit(ENCOUNTER_SHIFT_DAYS) + F.col("l_quantity").cast("int"))
        .alias("stopdate"),
        _case(F.col("l_linestatus"), MED_STATUS).alias("status"))


def medication_administration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Administrations: encounterid, drugreference.drugCode, medications[].drugCode,
    effectivetime.administeredperiod.{startdate, endDate}."""
    li = read(spark, sf_dir, "lineitem")
    drug = _drug(F.col("l_partkey"))
    return li.select(
        F.col("l_orderkey").alias("encounterid"),
        F.struct(drug.alias("drugCode")).alias("drugreference"),
        F.array(F.struct(drug.alias("drugCode"))).alias("medications"),
        F.struct(F.struct(
            _fmt_shift(F.col("l_shipdate"), ENCOUNTER_SHIFT_DAYS).alias("startdate"),
            _fmt_shift(F.col("l_shipdate"), ENCOUNTER_SHIFT_DAYS + 1).alias("endDate"),
        ).alias("administeredperiod")).alias("effectivetime"))


def procedure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Procedures, one per encounter: encounterid, procedurecode, serviceenddate ('' / NULL / date)."""
    o = read(spark, sf_dir, "orders")
    idx = F.col("o_orderkey") % len(PROCEDURES)
    end = (F.when(F.col("o_orderstatus") == "O", F.lit(None).cast("string"))
           .when(F.col("o_orderstatus") == "P", F.lit(""))
           .otherwise(_fmt_shift(F.col("o_orderdate"), ENCOUNTER_SHIFT_DAYS + DISCHARGE_DAYS)))
    return o.select(
        F.col("o_orderkey").alias("encounterid"),
        concept(_pick([p[0] for p in PROCEDURES], idx), _pick([p[1] for p in PROCEDURES], idx),
                _pick([p[2] for p in PROCEDURES], idx)).alias("procedurecode"),
        end.alias("serviceenddate"))


# ---------------------------------------------------------------------------
# hourly vitals and ICU locations
# ---------------------------------------------------------------------------
def _vital_value(name: str) -> Column:
    base, sign, factor, span = VITAL_FORMULA[name]
    return (F.lit(base) + F.lit(sign) * ((_hundredths() * F.lit(factor)) % F.lit(span))).cast("int")


def _hundredths() -> Column:
    return F.floor(F.col("value") * F.lit(100.0) + F.lit(0.5)).cast("bigint")


def _event_person() -> Column:
    return (F.col("user_id") * F.lit(EVENT_PERSONS) + F.col("event_id") % F.lit(EVENT_PERSONS)).cast("bigint")


def _goes_to_icu() -> Column:
    _, _, factor, span = VITAL_FORMULA["heart_rate"]
    return (F.col("event_type") == F.lit(ICU_EVENT)) & (
        (_hundredths() * F.lit(factor)) % F.lit(span) + F.lit(ICU_STEP) * (F.col("event_id") % F.lit(3)) >= F.lit(ICU_LEAST))


def _measured(name: str) -> Column:
    types = [et for et, kinds in VITALS_BY_EVENT if name in kinds]
    return F.col("event_type").isin(*types)


def _event_keys() -> list[Column]:
    return [_event_person().alias("personid"),
            event_encounter(_event_person(), F.col("ts")).alias("encounterid"),
            F.date_trunc("hour", F.col("ts")).cast("timestamp_ntz").alias("hour_mark")]


def vital_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One vital feature table: personid, encounterid, hour_mark, <name> (string).

    Unique per key (max within the hour); the temperature table names its
    value column ``value`` like the source it imitates.
    """
    e = read(spark, sf_dir, "events").where(_measured(name))
    out_col = "value" if name == "temperature" else name
    return (e.select(*_event_keys(), _vital_value(name).alias("_v"))
            .groupBy(*PANEL_KEYS).agg(F.max("_v").cast("string").alias(out_col)))


def vital_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {n: vital_table(spark, sf_dir, n) for n in VITALS}


def vital_events(events: DataFrame) -> DataFrame:
    """events -> one row per (event, measured vital): personid, encounterid, hour_mark, ts, vital, value (int).

    Works on batch and streaming frames alike (no aggregation)."""
    kinds = None
    for et, names in VITALS_BY_EVENT:
        arr = F.array(*[F.lit(n) for n in names])
        cond = F.col("event_type") == F.lit(et)
        kinds = F.when(cond, arr) if kinds is None else kinds.when(cond, arr)
    value = None
    for n in VITALS:
        cond = F.col("vital") == F.lit(n)
        value = F.when(cond, _vital_value(n)) if value is None else value.when(cond, _vital_value(n))
    return (events.select(*_event_keys(), "ts", "value", F.explode(kinds).alias("vital"))
            .select(*PANEL_KEYS, "ts", "vital", value.alias("value")))


def vital_measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw long vitals: personid, encounterid, hour_mark, vital, value (int).  Not unique per
    key; ``max`` per (key, vital) gives the feature tables."""
    return vital_events(read(spark, sf_dir, "events")).drop("ts")


def vitals_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long vitals: personid, encounterid, hour_mark, vital, value (string), unique per (key, vital)."""
    return (vital_measurements(spark, sf_dir)
            .groupBy(*PANEL_KEYS, "vital").agg(F.max("value").cast("string").alias("value")))


def locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Location stays from events: personid, encounterid, name, beginDate, endDate (strings)."""
    e = read(spark, sf_dir, "events")
    icu = _goes_to_icu()
    begin = F.when(icu, F.date_trunc("hour", F.col("ts")).cast("timestamp_ntz") + F.make_dt_interval(mins=F.lit(30))
                   ).otherwise(F.col("ts"))
    end = F.col("ts") + F.make_dt_interval(hours=F.when(icu, 1).otherwise(0), mins=F.floor(F.col("value")).cast("int"))
    return e.select(
        _event_person().alias("personid"),
        event_encounter(_event_person(), F.col("ts")).alias("encounterid"),
        F.when(icu, F.lit("PICU")).otherwise(_case(F.col("event_type"), EVENT_LOCATION, EVENT_LOCATION_OTHER)).alias("name"),
        F.date_format(begin, TS_FMT).alias("beginDate"),
        F.date_format(end, TS_FMT).alias("endDate"))


# ---------------------------------------------------------------------------
# classifier scores
# ---------------------------------------------------------------------------
def scored_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source, y (quality label), score (n_chars) for metric checks."""
    lab_ = read(spark, sf_dir, "labels")
    d = read(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    return (lab_.join(d, "doc_id", "inner")
            .select("doc_id", "source", F.col("quality").alias("y"),
                    F.col("n_chars").cast("double").alias("score")))
