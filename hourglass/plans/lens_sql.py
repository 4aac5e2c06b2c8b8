"""The clinical lens (``sources/lens.py``) rendered as DuckDB SQL CTEs.

The oracle queries are written independently of the Spark operators, but
they must read the same derived tables; those are generated here from the
very same fixed mapping tables, so the two sides cannot drift apart.
"""

from __future__ import annotations

from ..sources import lens as L

FMT = "'%Y-%m-%d %H:%M:%S'"


def lit(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, str):
        return "'" + v.replace("'", "''") + "'"
    return repr(v)


def case(expr: str, pairs, default=None) -> str:
    whens = " ".join(f"WHEN {expr} = {lit(k)} THEN {lit(v)}" for k, v in pairs)
    tail = f" ELSE {lit(default)}" if default is not None else ""
    return f"(CASE {whens}{tail} END)"


def bands(expr: str, bs, top) -> str:
    whens = " ".join(f"WHEN {expr} < {lit(b)} THEN CAST({lit(v)} AS VARCHAR)" for b, v in bs)
    return f"(CASE {whens} ELSE {lit(top)} END)"


def pick(values, idx: str) -> str:
    return "[" + ", ".join(lit(v) for v in values) + f"][CAST({idx} AS INTEGER) + 1]"


def concept(code: str, display: str, system: str = "NULL") -> str:
    return ("{'standard': {'id': CAST(" + code + " AS VARCHAR), 'primaryDisplay': CAST(" + display +
            " AS VARCHAR), 'codingSystemId': CAST(" + system + " AS VARCHAR)}}")


def fmt_shift(ts: str, days: str) -> str:
    return f"strftime(CAST({ts} AS DATE) + CAST({days} AS INTEGER), {FMT})"


def event_encounter(user: str = "user_id", ts: str = "ts") -> str:
    return (f"({user} * {L.ENCOUNTER_PER_PERSON} + CAST(floor(date_diff('day', DATE '{L.WEEK_BASE}', "
            f"CAST({ts} AS DATE)) / 7.0) AS BIGINT))")


def vital_value(name: str, v: str = "value") -> str:
    base, sign, factor, span = L.VITAL_FORMULA[name]
    return f"CAST({base} + ({sign}) * (({hundredths(v)} * {factor}) % {span}) AS INTEGER)"


def hundredths(v: str = "value") -> str:
    return f"CAST(floor({v} * 100.0::DOUBLE + 0.5::DOUBLE) AS BIGINT)"


def goes_to_icu() -> str:
    _, _, factor, span = L.VITAL_FORMULA["heart_rate"]
    return (f"(event_type = {lit(L.ICU_EVENT)} AND ({hundredths()} * {factor}) % {span} + {L.ICU_STEP} * (event_id % 3) "
            f">= {L.ICU_LEAST})")


EVENT_PERSON = f"(user_id * {L.EVENT_PERSONS} + event_id % {L.EVENT_PERSONS})"


def measured(name: str) -> str:
    types = [et for et, kinds in L.VITALS_BY_EVENT if name in kinds]
    return "event_type IN (" + ", ".join(lit(t) for t in types) + ")"


def _seg_race() -> str:
    return case("c_mktsegment", L.SEGMENT_RACE)


def _nat_race() -> str:
    return bands("c_nationkey", L.NATION_RACE[:-1], L.NATION_RACE[-1][1])


def _location_name() -> str:
    w = " ".join(f"WHEN l_quantity <= {lit(b)} THEN {lit(n)}" for b, n in L.LOCATION_BANDS)
    w += " " + " ".join(f"WHEN l_returnflag = {lit(f)} THEN {lit(n)}" for f, n in L.LOCATION_BY_FLAG)
    return f"(CASE {w} ELSE {lit(L.LOCATION_OTHER)} END)"


def _lab_code(which: int) -> str:
    w = " ".join(f"WHEN event_type = {lit(r[0])} THEN (CASE WHEN value >= 100 THEN {lit(r[which + 2])} "
                 f"ELSE {lit(r[which])} END)" for r in L.LAB_TYPES)
    return f"(CASE {w} END)"


def _drug() -> str:
    idx = f"l_partkey % {len(L.DRUGS)}"
    return concept(pick([d[0] for d in L.DRUGS], idx), pick([d[1] for d in L.DRUGS], idx), lit(L.DRUG_SYSTEM))


_female = "c_nationkey % 2 = 0"
_eth = "(CASE WHEN c_nationkey % 3 = 0 THEN 'Hispanic or Latino' ELSE 'Not Hispanic or Latino' END)"
_races = f"[{concept(_seg_race(), _seg_race())}, {concept(_nat_race(), _nat_race())}]"
_cls = case("o_orderpriority", L.PRIORITY_CLASS)
_etype = case("o_orderstatus", L.ENCOUNTER_TYPE)
_payer = bands("o_totalprice", L.PAYER_BANDS, L.PAYER_TOP)
_c10 = ("(chr(CAST(65 + l_partkey % 26 AS INTEGER)) || lpad(CAST(CAST(2 * l_quantity - 1 AS INTEGER) AS VARCHAR), 2, '0')"
        " || '.' || CAST(l_linenumber AS VARCHAR))")
_code = (f"(CASE WHEN l_returnflag = 'R' THEN CAST(400 + l_partkey % 300 AS VARCHAR) || '.' || CAST(l_linenumber AS VARCHAR)"
         f" WHEN l_linenumber = 7 THEN lower({_c10}) ELSE {_c10} END)")
_icd_sys = (f"(CASE WHEN l_returnflag = 'R' THEN {case('l_linestatus', tuple(L.ICD9_SYSTEMS.items()))} "
            f"ELSE {lit(L.ICD10_SYSTEM)} END)")
_interp = bands("value", L.INTERPRETATION_BANDS, L.INTERPRETATION_TOP)
_numeric = (f"(CASE WHEN event_type = 'error' THEN NULL WHEN value >= {L.UNPARSABLE_FROM} THEN 'see note' "
            f"ELSE CAST(value AS VARCHAR) END)")
_text = (f"(CASE WHEN event_type IN ({', '.join(lit(t) for t in L.TEXT_RESULT_TYPES)}) THEN "
         f"{bands('value', L.TEXT_RESULT_BANDS, L.TEXT_RESULT_TOP)} END)")
_proc_idx = f"o_orderkey % {len(L.PROCEDURES)}"
_vital_kinds = "(CASE " + " ".join(
    f"WHEN event_type = {lit(et)} THEN [{', '.join(lit(n) for n in names)}]" for et, names in L.VITALS_BY_EVENT) + " END)"
_vital_long_value = "(CASE " + " ".join(
    f"WHEN vital = {lit(n)} THEN {vital_value(n)}" for n in L.VITALS) + " END)"

CTES: dict[str, str] = {
    "demographics": f"""SELECT c_custkey AS personid,
  strftime(DATE '{L.BIRTH_BASE}' + CAST((c_custkey * {L.BIRTH_STEP}) % {L.BIRTH_SPREAD} + sh.s AS INTEGER), {FMT}) AS birthdate,
  {concept(f"CASE WHEN {_female} THEN 'F' ELSE 'M' END", f"CASE WHEN {_female} THEN 'Female' ELSE 'Male' END", lit(L.SEX_SYSTEM))} AS birthsex,
  CASE WHEN c_acctbal < 0 THEN NULL WHEN c_acctbal < 100 THEN {_races}[1:0] ELSE {_races} END AS races,
  [{concept(_eth, _eth)}] AS ethnicities,
  c_acctbal >= 0 AS active
FROM customer, (VALUES (0), ({L.CONFLICT_SHIFT_DAYS})) sh(s)
WHERE sh.s = 0 OR c_acctbal < 0""",
    "patient_demographics": f"""SELECT c_custkey AS personid,
  CASE WHEN {_female} THEN 'Female' ELSE 'Male' END AS gender, {_seg_race()} AS race, {_eth} AS ethnicity
FROM customer""",
    "encounter": f"""SELECT o_orderkey AS encounterid, o_custkey AS personid, o_custkey % {L.TENANTS} AS tenant,
  {concept('o_orderpriority', _cls)} AS classification,
  {concept('o_orderstatus', _etype)} AS type,
  {concept('o_orderstatus', case('o_orderstatus', L.STATUS_NAME))} AS status,
  {concept('o_orderpriority', 'lower(substring(o_orderpriority, 3, 100))')} AS reasonforvisit,
  {concept(_payer, _payer)} AS financialclass,
  {concept('o_orderstatus', case('o_orderstatus', L.ADMISSION_SOURCE))} AS admissionsource,
  {fmt_shift('o_orderdate', str(L.ENCOUNTER_SHIFT_DAYS))} AS hospitalizationstartdate,
  CASE WHEN o_orderstatus = 'O' THEN NULL ELSE {fmt_shift('o_orderdate', str(L.ENCOUNTER_SHIFT_DAYS + L.DISCHARGE_DAYS))} END AS dischargedate,
  {fmt_shift('o_orderdate', str(L.ENCOUNTER_SHIFT_DAYS))} AS servicedate,
  [{{'classification': {concept('o_orderpriority', _cls)}}}, {{'classification': {concept('o_orderstatus', _etype)}}}] AS encountertypes
FROM orders""",
    "encounter_locations": f"""SELECT encounterid, list(stay ORDER BY stay) AS locations
FROM (SELECT l_orderkey AS encounterid,
        {{'seq': l_linenumber, 'name': {_location_name()},
          'beginDate': {fmt_shift('l_shipdate', str(L.ENCOUNTER_SHIFT_DAYS))},
          'endDate': {fmt_shift('l_shipdate', f'{L.ENCOUNTER_SHIFT_DAYS} + CAST(l_quantity AS INTEGER)')}}} AS stay
      FROM lineitem)
GROUP BY encounterid""",
    "encounter_full": """SELECT e.*, l.locations FROM encounter e LEFT JOIN encounter_locations l USING (encounterid)""",
    "qualified_encounter": f"""SELECT o_custkey AS personid, o_custkey % {L.TENANTS} AS tenant, o_orderkey AS encounterid,
  {_cls} AS encountertype,
  CAST(o_orderdate AS DATE) + {L.ENCOUNTER_SHIFT_DAYS} AS servicedate,
  CAST(floor(date_diff('day', DATE '{L.BIRTH_BASE}' + CAST((c_custkey * {L.BIRTH_STEP}) % {L.BIRTH_SPREAD} AS INTEGER),
       CAST(o_orderdate AS DATE) + {L.ENCOUNTER_SHIFT_DAYS}) / 365.25) AS INTEGER) AS age_at_encounter,
  CASE WHEN o_totalprice >= 300000 THEN 1 ELSE 0 END AS dx_qual_ind,
  CASE WHEN o_orderstatus = 'P' AND o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END AS lab_qual_ind
FROM orders JOIN customer ON o_custkey = c_custkey""",
    "condition": f"""SELECT o_custkey AS personid, l_orderkey AS encounterid,
  {concept(_code, "'Condition ' || " + _code, _icd_sys)} AS conditioncode,
  {concept('l_linestatus', "CASE WHEN l_linestatus = 'F' THEN 'Problem list' ELSE 'Diagnosis' END")} AS classification
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "lab": f"""SELECT user_id AS personid, {event_encounter()} AS encounterid,
  strftime(ts, '%Y-%m-%d') AS servicedate, strftime(ts, {FMT}) AS issueddate,
  {concept(_lab_code(1), _lab_code(2), lit(L.LAB_SYSTEM))} AS labcode,
  {concept(_interp, _interp)} AS interpretation,
  {{'numericValue': {{'value': {_numeric}}}, 'textValue': {{'value': {_text}}}}} AS typedvalue,
  {{'typedreferencehighvalue': {{'numericvalue': {{'value': CAST(CAST(40 + 10 * floor(value / 100.0) AS BIGINT) AS VARCHAR)}}}}}} AS referencerange
FROM events""",
    "medication": f"""SELECT l_orderkey AS encounterid, {_drug()} AS drugcode,
  {concept(pick(L.ROUTES, 'l_linenumber - 1'), pick(L.ROUTES, 'l_linenumber - 1'))} AS route,
  {fmt_shift('l_shipdate', str(L.ENCOUNTER_SHIFT_DAYS))} AS startdate,
  {fmt_shift('l_shipdate', f'{L.ENCOUNTER_SHIFT_DAYS} + CAST(l_quantity AS INTEGER)')} AS stopdate,
  {case('l_linestatus', L.MED_STATUS)} AS status
FROM lineitem""",
    "medication_administration": f"""SELECT l_orderkey AS encounterid,
  {{'drugCode': {_drug()}}} AS drugreference,
  [{{'drugCode': {_drug()}}}] AS medications,
  {{'administeredperiod': {{'startdate': {fmt_shift('l_shipdate', str(L.ENCOUNTER_SHIFT_DAYS))},
                           'endDate': {fmt_shift('l_shipdate', str(L.ENCOUNTER_SHIFT_DAYS + 1))}}}}} AS effectivetime
FROM lineitem""",
    "procedure": f"""SELECT o_orderkey AS encounterid,
  {concept(pick([p[0] for p in L.PROCEDURES], _proc_idx), pick([p[1] for p in L.PROCEDURES], _proc_idx),
           pick([p[2] for p in L.PROCEDURES], _proc_idx))} AS procedurecode,
  CASE WHEN o_orderstatus = 'O' THEN NULL WHEN o_orderstatus = 'P' THEN ''
       ELSE {fmt_shift('o_orderdate', str(L.ENCOUNTER_SHIFT_DAYS + L.DISCHARGE_DAYS))} END AS serviceenddate
FROM orders""",
    "locations": f"""SELECT {EVENT_PERSON} AS personid, {event_encounter(EVENT_PERSON)} AS encounterid,
  CASE WHEN {goes_to_icu()} THEN 'PICU' ELSE {case('event_type', L.EVENT_LOCATION, L.EVENT_LOCATION_OTHER)} END AS name,
  strftime(CASE WHEN {goes_to_icu()} THEN date_trunc('hour', ts) + INTERVAL 30 MINUTE ELSE ts END, {FMT}) AS beginDate,
  strftime(ts + to_minutes(CAST(floor(value) AS INTEGER) + CASE WHEN {goes_to_icu()} THEN 60 ELSE 0 END), {FMT}) AS endDate
FROM events""",
    "vitals_long": f"""SELECT personid, encounterid, hour_mark, vital, CAST(max({_vital_long_value}) AS VARCHAR) AS value
FROM (SELECT {EVENT_PERSON} AS personid, {event_encounter(EVENT_PERSON)} AS encounterid, date_trunc('hour', ts) AS hour_mark,
             value, unnest({_vital_kinds}) AS vital FROM events WHERE event_type <> 'error')
GROUP BY personid, encounterid, hour_mark, vital""",
    "scored_documents": """SELECT doc_id, source, quality AS y, CAST(n_chars AS DOUBLE) AS score
FROM labels JOIN documents USING (doc_id)""",
}
for _n in L.VITALS:
    _col = "value" if _n == "temperature" else _n
    CTES[f"vital_{_n}"] = (f"SELECT {EVENT_PERSON} AS personid, {event_encounter(EVENT_PERSON)} AS encounterid, "
                           f"date_trunc('hour', ts) AS hour_mark, CAST(max({vital_value(_n)}) AS VARCHAR) AS {_col} "
                           f"FROM events WHERE {measured(_n)} GROUP BY ALL")

DEPENDS = {"encounter_full": ("encounter", "encounter_locations")}


def with_lens(sql: str, *names: str) -> str:
    """Prefix ``sql`` with the CTEs it reads (dependencies first)."""
    order: list[str] = []

    def add(n: str) -> None:
        for d in DEPENDS.get(n, ()):
            add(d)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    if not order:
        return sql
    ctes = ",\n".join(f"{n} AS (\n{CTES[n]}\n)" for n in order)
    body = sql.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
