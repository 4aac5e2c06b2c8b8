"""[J1/J2] Chronic-condition indicator matrix and prevalence by body system."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.codes import CCC_RULES, classify, normalize_code, rule_labels
from .pivot import pivot_column_name, pivot_indicator


def classify_codes(df: DataFrame, person: str = "personid", code: str = "conditioncode.standard.id",
                   rules: Sequence[tuple[str, str]] = CCC_RULES, out: str = "ccode") -> DataFrame:
    """person, class label per condition row (NULL when no rule matches).

    The code is normalised once in its own projection (Catalyst keeps it
    separate because the expression is not cheap and is referenced by every
    rule), so the rules test a plain string column.
    """
    norm = df.select(F.col(person).alias(person), normalize_code(F.col(code)).alias("_norm"))
    return norm.select(person, classify(F.col("_norm"), rules).alias(out))


def matrix_columns(rules: Sequence[tuple[str, str]] = CCC_RULES, include_unmatched: bool = True) -> list[str]:
    """Class columns in the order ``pivot`` would produce them (NULL first, then sorted)."""
    labels = sorted(rule_labels(rules))
    return ([pivot_column_name(None)] if include_unmatched else []) + labels


def condition_matrix(df: DataFrame, person: str = "personid", code: str = "conditioncode.standard.id",
                     rules: Sequence[tuple[str, str]] = CCC_RULES, include_unmatched: bool = True) -> DataFrame:
    """[J1 E8 B9] person x class 0/1 matrix.

    Code -> strip non-alphanumerics -> ordered rules (first match wins) ->
    indicator per class.  Codes matching no rule land in a column named
    ``null`` (as ``pivot`` names it) unless ``include_unmatched=False``.  One
    aggregation keyed by person with map-side combine, so a person holding a
    large share of all rows is pre-reduced in every task before the shuffle.
    """
    labels = sorted(rule_labels(rules))
    values = ([None] if include_unmatched else []) + labels
    long = classify_codes(df, person, code, rules)
    return pivot_indicator(long, [person], "ccode", values)


def condition_prevalence(matrix: DataFrame, person: str = "personid", scale: float = 1_000_000.0) -> DataFrame:
    """[J2 E10 B12 B4] Persons per body system: (body_system, count, count_red).

    Column sums of the matrix (the key column excluded up front), turned into
    rows; ``CCC_`` is stripped from names and ``count_red = count / scale``.
    """
    cols = [c for c in matrix.columns if c.lower() != person.lower()]
    sums = matrix.agg(*[F.sum(F.col(f"`{c}`")).cast("bigint").alias(c) for c in cols])
    long = sums.unpivot([], cols, "name", "count")
    return long.select(
        F.regexp_replace("name", "^CCC_", "").alias("body_system"),
        F.col("count").cast("bigint").alias("count"),
        (F.col("count") / F.lit(float(scale))).alias("count_red"))
