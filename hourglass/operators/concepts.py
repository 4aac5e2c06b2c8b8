"""Concept / value-set search and frequency tables over coded tables.

One generic operator replaces the many near-identical vocabulary queries of
the analysis.  [C1-C5 C7 C8 E2 E3 E7 E12 E17 G1 G3 J7 J8 J11 J12 J19]
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _path(concept: str, leaf: str) -> Column:
    return F.col(f"{concept}.standard.{leaf}")


def in_value_set(df: DataFrame, col: str | Column, codes: Sequence[str] | DataFrame,
                 code_col: str = "code") -> DataFrame:
    """[C2] Rows whose ``col`` is in a value set (literal list or a code table).

    A literal list becomes ``InSet``; a DataFrame is applied as a left semi
    join, which AQE broadcasts at run time when the measured set is small.
    """
    c = F.col(col) if isinstance(col, str) else col
    if isinstance(codes, DataFrame):
        vs = codes.select(F.col(code_col).alias("_vs_code")).distinct()
        return df.join(vs, c == vs["_vs_code"], "left_semi")
    return df.where(c.isin(list(codes)))


def concept_filter(df: DataFrame, concept: str, include: str | None = None, exclude: str | None = None,
                   ids: Sequence[str] | DataFrame | None = None, systems: Sequence[str] | None = None,
                   case_insensitive: bool = True, on: str = "primaryDisplay") -> DataFrame:
    """[C1-C4] Filter a coded table by display regex include / exclude, value set, coding system.

    ``include``/``exclude`` are unanchored ``RLIKE`` patterns applied to the
    lower-cased display (``case_insensitive``) or as given; ``on='id'``
    matches codes instead.
    """
    target = _path(concept, on)
    if case_insensitive:
        target = F.lower(target)
    out = df
    if systems is not None:
        out = out.where(_path(concept, "codingSystemId").isin(list(systems)))
    if include is not None:
        out = out.where(target.rlike(include))
    if exclude is not None:
        out = out.where(~target.rlike(exclude))
    if ids is not None:
        out = in_value_set(out, _path(concept, "id"), ids)
    return out


def concept_search(df: DataFrame, concept: str, include: str | None = None, exclude: str | None = None,
                   ids: Sequence[str] | DataFrame | None = None, systems: Sequence[str] | None = None,
                   case_insensitive: bool = True, on: str = "primaryDisplay",
                   count_distinct: str | None = None, display_as: str = "display",
                   id_as: str = "id", count_as: str = "n") -> DataFrame:
    """[J8 E12] Vocabulary of a coded table: distinct (display, id) matching the filters,
    optionally with ``count(DISTINCT count_distinct)`` per concept."""
    f = concept_filter(df, concept, include, exclude, ids, systems, case_insensitive, on)
    cols = [_path(concept, "primaryDisplay").alias(display_as), _path(concept, "id").alias(id_as)]
    if count_distinct is None:
        return f.select(*cols).distinct()
    return (f.groupBy(*cols)
            .agg(F.count_distinct(count_distinct).cast("bigint").alias(count_as)))


def frequency(df: DataFrame, by: str | Column, count_distinct: str | None = "encounterid",
              by_as: str = "value", count_as: str = "n", where: Column | None = None) -> DataFrame:
    """[E2 E3 G1 J19] Count (distinct) per value, most frequent first."""
    src = df if where is None else df.where(where)
    b = (F.col(by) if isinstance(by, str) else by).alias(by_as)
    agg = F.count_distinct(count_distinct) if count_distinct else F.count(F.lit(1))
    return src.groupBy(b).agg(agg.cast("bigint").alias(count_as)).orderBy(F.desc(count_as), F.asc(by_as))


def top_k(df: DataFrame, k: int, order: Sequence[Column]) -> DataFrame:
    """[G3] ``ORDER BY .. LIMIT k`` – planned as TakeOrderedAndProject (per-task top-k, no full sort)."""
    return df.orderBy(*order).limit(k)


def positive_flag(lab: DataFrame, keys: Sequence[str] = ("personid", "encounterid", "servicedate"),
                  ids: Sequence[str] | DataFrame | None = None,
                  interpretation_pattern: str = "above|abnormal|pos",
                  text_pattern: str = "pos|^detected", out: str = "COVID_Positive") -> DataFrame:
    """[J7 E7] Per (person, encounter, date): 1 when any result of the assays in ``ids`` is positive.

    ``max(CASE WHEN lower(interp) RLIKE .. OR lower(text) RLIKE .. THEN 1 ELSE 0 END)``.
    The analysis left its assay filter unfinished; the value set is an argument.
    """
    src = lab if ids is None else in_value_set(lab, "labcode.standard.id", ids)
    pos = (F.lower(F.col("interpretation.standard.primaryDisplay")).rlike(interpretation_pattern) |
           F.lower(F.col("typedvalue.textValue.value")).rlike(text_pattern))
    return src.groupBy(*keys).agg(F.max(F.when(pos, 1).otherwise(0)).alias(out))


def positive_assays(lab: DataFrame, name_pattern: str, interpretation_pattern: str = "above|abnormal|pos",
                    text_pattern: str = "pos|^detected", out: str = "COVIDLABS") -> DataFrame:
    """[J7] Distinct assay names matching ``name_pattern`` with at least one positive result."""
    pos = (F.lower(F.col("interpretation.standard.primaryDisplay")).rlike(interpretation_pattern) |
           F.lower(F.col("typedvalue.textValue.value")).rlike(text_pattern))
    return (lab.where(F.lower(F.col("labcode.standard.primaryDisplay")).rlike(name_pattern) & pos)
            .select(F.col("labcode.standard.primaryDisplay").alias(out)).distinct().orderBy(out))


def count_by_code_rules(df: DataFrame, concept: str, rules: Sequence[tuple[Sequence[str], str]],
                        count_distinct: Sequence[str] = ("personid",),
                        names: Sequence[str] | None = None) -> DataFrame:
    """[C7] Distinct counts over rows matching any (coding systems, code regex) rule."""
    cond = None
    for systems, pattern in rules:
        c = _path(concept, "codingSystemId").isin(list(systems)) & _path(concept, "id").rlike(pattern)
        cond = c if cond is None else (cond | c)
    names = names or [f"n_{c}" for c in count_distinct]
    return df.where(cond).agg(*[F.count_distinct(c).cast("bigint").alias(n) for c, n in zip(count_distinct, names)])


def count_by_code_pattern(df: DataFrame, concept: str, pattern: str,
                          count_distinct: Sequence[str] = ("personid",),
                          names: Sequence[str] | None = None) -> DataFrame:
    """[E3 E4] Distinct counts over rows whose code matches ``pattern``."""
    names = names or [f"n_{c}" for c in count_distinct]
    return (df.where(_path(concept, "id").rlike(pattern))
            .agg(*[F.count_distinct(c).cast("bigint").alias(n) for c, n in zip(count_distinct, names)]))


def open_interval_share(df: DataFrame, end: str = "serviceenddate", count_distinct: str = "encounterid",
                        flag: str = "hasEndDate") -> DataFrame:
    """[J12 C8 E17] Distinct encounters by whether the end date is missing ('' or NULL), with shares.

    The flag keeps the analysis' name ``hasEndDate`` although it is 1 when the
    end date is *missing*.  ``share = n / sum(n)`` over the two groups.
    """
    missing = (F.col(end) == "") | F.col(end).isNull()
    g = (df.groupBy(F.when(missing, 1).otherwise(0).alias(flag))
         .agg(F.count_distinct(count_distinct).cast("bigint").alias("nEncounters")))
    # the window runs over the aggregated rows only (at most two)
    total = F.sum("nEncounters").over(Window.partitionBy())
    return g.withColumn("share", F.round(F.col("nEncounters") / total, 6))


def drugs_during_procedure(med_admin: DataFrame, procedure: DataFrame, system: str, code: str,
                           drug_path: str = "medications.drugCode.standard.primaryDisplay",
                           drug_pattern: str | None = None, drug_as: str = "drugcode",
                           keep_encounter: bool = False) -> DataFrame:
    """[J11] Drugs administered in encounters that have a given procedure code.

    The procedure side is filtered to the one code before the join (pushed
    below it), so the join's build side is the small qualifying set.
    """
    proc = (procedure.where((F.col("procedurecode.standard.codingSystemId") == system) &
                            (F.col("procedurecode.standard.id") == code))
            .select(F.col("encounterid").alias("_penc")))
    adm = med_admin
    if drug_pattern is not None:
        adm = adm.where(F.lower(F.col(drug_path)).rlike(drug_pattern))
    j = adm.join(proc, adm["encounterid"] == proc["_penc"], "inner")
    cols = ([F.col("encounterid")] if keep_encounter else []) + [
        F.col(drug_path).alias(drug_as),
        F.col("effectivetime.administeredperiod.startdate").alias("startdate"),
        F.col("effectivetime.administeredperiod.endDate").alias("endDate")]
    return j.select(*cols)


def drug_route_search(medication: DataFrame, drug_pattern: str, route_pattern: str) -> DataFrame:
    """[J11] Medication orders by drug and route regex (both case-folded)."""
    return (medication
            .where(F.lower(F.col("drugcode.standard.primaryDisplay")).rlike(drug_pattern) &
                   F.lower(F.col("route.standard.primaryDisplay")).rlike(route_pattern))
            .select("encounterid", F.col("drugcode.standard.primarydisplay").alias("drug"), "stopdate", "startdate"))
