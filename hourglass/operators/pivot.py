"""[E8] Long -> wide, with a value list that is given or read off the data (indicator / sum / max)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pivot_column_name(value) -> str:
    """Column name Spark's ``pivot`` gives a value (``None`` -> ``'null'``)."""
    return "null" if value is None else str(value)


def pivot_values(df: DataFrame, pivot_col: str, most: int = 50_000) -> list:
    """The distinct values of a column, sorted, nulls left out; an error beyond ``most`` (the analysis' own pivot limit).

    They become columns, so they must fit a schema: a table of more types is better kept long.
    """
    got = df.select(pivot_col).where(F.col(pivot_col).isNotNull()).distinct().limit(most + 1).collect()
    if len(got) > most:
        raise ValueError(f"{pivot_col} has more than {most} distinct values; aggregate by key and value instead")
    return sorted(r[0] for r in got)


def pivot_fixed(df: DataFrame, keys: Sequence[str], pivot_col: str | Column, values: Sequence,
                agg: str = "max", value_col: str | Column | None = None,
                fill: int | float | None = None, unlisted: str = "ignore") -> DataFrame:
    """Pivot ``pivot_col`` into one column per entry of ``values``.

    Same result as ``groupBy(keys).pivot(pivot_col, values).<agg>(value_col)``
    (plus ``fillna(fill)`` when given), written as one conditional
    aggregation: a single hash aggregate with map-side partial aggregation and
    one shuffle on ``keys`` (``pivot`` plans two aggregates, one per shuffle).
    Passing the value list also avoids the distinct pre-query and the
    ``spark.sql.pivotMaxValues`` cap, and fixes the output schema even when a
    value does not occur in the data.  ``value_col=None`` means the constant 1
    (indicator matrix).  Rows whose value is not listed are ignored, as
    ``pivot`` does; ``unlisted="other"`` aggregates them into a column
    ``other`` and ``"error"`` fails the query when there is one (``pivot_values``
    lists the values of the data).
    """
    if unlisted not in ("ignore", "other", "error"):
        raise ValueError(f"unlisted is 'ignore', 'other' or 'error', not {unlisted!r}")
    p = F.col(pivot_col) if isinstance(pivot_col, str) else pivot_col
    v = F.lit(1) if value_col is None else (F.col(value_col) if isinstance(value_col, str) else value_col)
    fn = {"max": F.max, "sum": F.sum, "min": F.min, "count": F.count, "avg": F.avg}[agg]
    outs = []
    for val in values:
        hit = p.isNull() if val is None else (p == F.lit(val))
        col = fn(F.when(hit, v))
        if fill is not None:
            col = F.coalesce(col, F.lit(fill))
        outs.append(col.alias(pivot_column_name(val)))
    known = [v for v in values if v is not None]
    rest = ~p.isin(known) if None in values else (p.isNull() | ~p.isin(known))
    if unlisted == "other":
        col = fn(F.when(rest, v))
        outs.append((F.coalesce(col, F.lit(fill)) if fill is not None else col).alias("other"))
    if unlisted == "error":
        stop = F.raise_error(F.concat(F.lit("value outside the pivot list: "), F.coalesce(p.cast("string"), F.lit("null"))))
        df = df.where(F.when(rest, stop.cast("boolean")).otherwise(F.lit(True)))
    return df.groupBy(*keys).agg(*outs)


def pivot_indicator(df: DataFrame, keys: Sequence[str], pivot_col: str | Column, values: Sequence) -> DataFrame:
    """[E8 B9] 0/1 matrix: ``pivot(...).max(lit(1)).fillna(0)``."""
    return pivot_fixed(df, keys, pivot_col, values, agg="max", value_col=None, fill=0)


def pivot_sum(df: DataFrame, keys: Sequence[str], pivot_col: str | Column, values: Sequence,
              value_col: str | Column) -> DataFrame:
    """[E8 J6] ``pivot(...).sum(value)`` – NULL where a key has no (non-null) value of that type."""
    return pivot_fixed(df, keys, pivot_col, values, agg="sum", value_col=value_col)
