"""Code normalisation, ordered rule classification and fixed value sets.

The rule table and value sets below are fixed values that must equal the
clinical definitions used by the original analysis; they are data, kept in
their natural order.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Chronic-condition body-system rules, evaluated in this order,
# first match wins, applied to the code after removing [^a-zA-Z0-9]+.
# ---------------------------------------------------------------------------
CCC_RULES: tuple[tuple[str, str], ...] = (
    ("^A", "CCC_INFECTION"),
    ("^C", "CCC_NEOPLASM"),
    ("^D", "CCC_BLOOD"),
    ("^E", "CCC_ENDOCRINE"),
    ("^F", "CCC_MENTAL"),
    ("^G", "CCC_NERVOUS"),
    ("^H[0-5][0-9]", "CCC_EYE"),
    ("^H[6-9][0-9]", "CCC_EAR"),
    ("^I", "CCC_CIRCULATORY"),
    ("^J", "CCC_RESPIRATORY"),
    ("^K", "CCC_DIGESTIVE"),
    ("^L", "CCC_SKIN"),
    ("^M", "CCC_MUSCULOSKELETAL"),
    ("^N", "CCC_GENITOURINARY"),
    ("^P", "CCC_PERINATAL"),
    ("^Q", "CCC_CONGENITAL"),
    ("^R", "CCC_UNCLASSIFIED"),
    ("^S|^T", "CCC_INJURY"),
    ("^V|^W|^X|^Y", "CCC_EXTERNAL"),
)
CODE_STRIP_PATTERN = "[^a-zA-Z0-9]+"

# ---------------------------------------------------------------------------
# Coding systems (OIDs) and search patterns of the analysis.
# ---------------------------------------------------------------------------
ICD10CM = "2.16.840.1.113883.6.90"
ICD9CM = ("2.16.840.1.113883.6.2", "2.16.840.1.113883.6.103")
CPT4 = "2.16.840.1.113883.6.12"
HCPCS = "2.16.840.1.113883.6.14"

COVID_DX_PATTERN = "^U07.[1-2]|^U49|^U00"
SICKLE_CELL_PATTERN = "^D57"
STROKE_PATTERN = "^I63.6|^437.6"
KIDNEY_ICD10_PATTERN = "^N[0-9]"
KIDNEY_ICD9_PATTERN = "^5[8-9]|^6[0-2]"
COVID_LAB_NAME_PATTERN = "sars coronavirus 2|sars-cov-2|sars cov|covid"
POSITIVE_INTERPRETATION_PATTERN = "above|abnormal|pos"
POSITIVE_TEXT_PATTERN = "pos|^detected"
RESPIRATORY_VIRUS_PATTERN = "adenovirus|coronavirus|metapneumovirus|rhinovirus|enterovirus|influenza|syncytial"
MAGNESIUM_INCLUDE = "magnesium"
MAGNESIUM_EXCLUDE = ("oxide|alumin|acetaminophen|lidocaine|bisacodyl|salicylate|esomeprazole|"
                     "omeprazole|naproxen|arginine")
SEDATION_DRUG_PATTERN = "propofol|fentanyl|sevoflurane|rocoronium|morphine"
IV_ROUTE_PATTERN = "intravenous|iv|infusion"
ECMO_PROCEDURE_PATTERN = ("^5A05121|^5A0512C|^5A05221|^5A0522C|^5A15223|^5A1522F|^5A1522G|^5A1522H|"
                          "^5A15A2F|^5A15A2G|^5A15A2H|^33969|^33966|^33948|^33947|^33946|^33986|^33985|"
                          "^33984|^33965|^33964|^33963|^33962|^33959|^33958|^33954|^33953|^33952|^33951|"
                          "^33949")
CRANIOTOMY_CPT = "61510"
ENCOUNTER_TYPE_RULES: tuple[tuple[str, str], ...] = (
    ("^Outpatient|clinic", "Outpatient"),
    ("^Inpatient", "Inpatient"),
    ("^Emergency", "Emergency"),
)

# Lab value sets (LOINC), in the order the analysis lists them.
COVID_LAB_CODES_1 = (
    "94509-7", "96121-9", "94758-0", "95823-1", "94765-5", "94315-9", "96122-7", "94313-4", "94310-0",
    "94502-2", "94647-5", "94532-9", "95942-9", "97099-6", "95941-1", "95380-2", "95423-0", "95422-2",
)
COVID_LAB_CODES_2 = (
    "98733-9", "99771-8", "98846-9", "98847-7", "99774-2", "99773-4", "95209-3", "94763-0", "94661-6",
    "95825-6", "98069-8", "94762-2", "95542-7", "94769-7", "96118-5", "94504-8", "94503-0", "94558-4",
    "96119-3", "97097-0", "96094-8", "98080-5", "96896-6", "96764-6", "96763-8", "94562-6", "94768-9",
    "95427-1", "94720-0", "95125-1", "96742-2", "94761-4", "94563-4", "94507-1", "95429-7", "94505-5",
    "94547-7", "95416-4", "94564-2", "94508-9", "95428-9", "94506-3", "96895-8", "100157-7", "96957-6",
    "95521-1", "96898-2", "94510-5", "94311-8", "94312-6", "95522-9", "94760-6", "96986-5", "95409-9",
    "94533-7", "94756-4", "94757-2", "95425-5", "96448-6", "96958-4", "94766-3", "94316-7", "94307-6",
    "94308-4", "99596-9", "95411-5", "95410-7", "97098-8", "98132-4", "98494-8", "96899-0", "94644-2",
    "94511-3", "94559-2", "95824-9", "94639-2", "97104-4", "98131-6", "98493-0", "94646-7", "94645-9",
    "96120-1", "94534-5", "96091-4", "94314-2", "96123-5", "99314-7", "94745-7", "94746-5", "94819-0",
    "94565-9", "94759-8", "95406-5", "96797-6", "95608-6", "94500-6", "95424-8", "94845-5", "94822-4",
    "94660-8", "94309-2", "96829-7", "96897-4", "94531-1", "95826-4", "94306-8", "96900-6", "94642-6",
    "94643-4", "94640-0", "95609-4", "96765-3", "94767-1", "94641-8", "96752-1", "96751-3", "99597-7",
    "96603-6", "98732-1", "98734-7", "96894-1", "95970-0", "100156-9", "96741-4", "96755-4", "94764-8",
    "99772-6", "95971-8", "95974-2", "95972-6", "95973-4",
)
KIDNEY_LAB_CODES = (
    "33914-3", "444336003", "48642-3", "48643-1", "50044-7", "50210-4", "50384-7", "62238-1",
    "69405-9", "70969-1", "76633-7", "77147-7", "88293-6", "88294-4",
)
WEIGHT_MEASUREMENT_CODES = ("29463-7", "3141-9", "3142-7", "75292-3", "8335-2")
UREA_NITROGEN_CODE = "3094-0"


def normalize_code(code: Column | str) -> Column:
    """[§2.9 code_normalize] Remove every run of non-alphanumerics."""
    c = F.col(code) if isinstance(code, str) else code
    return F.regexp_replace(c, CODE_STRIP_PATTERN, "")


def classify(value: Column | str, rules: Sequence[tuple[str, str]] = CCC_RULES) -> Column:
    """[J1] Ordered regex rules -> label; first match wins, no match -> NULL.

    One ``CASE WHEN .. RLIKE ..`` chain, evaluated JVM-side per row.
    """
    v = F.col(value) if isinstance(value, str) else value
    out = None
    for pattern, label in rules:
        cond = v.rlike(pattern)
        out = F.when(cond, F.lit(label)) if out is None else out.when(cond, F.lit(label))
    return out


def code_prefix(codes: Iterable[str]) -> str:
    """Anchored alternation that matches codes literally (dots escaped)."""
    return "|".join("^" + re.escape(c) for c in codes)


def rule_labels(rules: Sequence[tuple[str, str]] = CCC_RULES) -> list[str]:
    """Distinct labels of a rule table in first-appearance order."""
    seen: list[str] = []
    for _, label in rules:
        if label not in seen:
            seen.append(label)
    return seen
