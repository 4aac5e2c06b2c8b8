"""Nested-record helpers: struct paths, arrays of structs, lenient casts.

Everything here returns a ``Column`` built from JVM-side expressions, so
nested-schema pruning and whole-stage codegen stay intact.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ColumnOrName = Column | str


def _col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def concept(code: ColumnOrName, display: ColumnOrName,
            system: ColumnOrName | None = None) -> Column:
    """Build a coded concept ``struct<standard: struct<id, primaryDisplay, codingSystemId>>``."""
    sys_col = F.lit(None).cast("string") if system is None else _col(system)
    return F.struct(F.struct(_col(code).cast("string").alias("id"),
                             _col(display).cast("string").alias("primaryDisplay"),
                             sys_col.cast("string").alias("codingSystemId")).alias("standard"))


def pick(df: DataFrame, paths: Mapping[str, str], keep: list[str] | tuple = ()) -> DataFrame:
    """[B1/B2] Project nested paths to flat columns: ``{'out': 'a.standard.id'}``.

    Paths are passed straight to ``col``; Catalyst prunes the nested schema
    down to the touched leaves, so wide clinical structs are never read whole.
    A path through an array of structs yields an array of the leaf field.
    """
    cols = [F.col(k) for k in keep] + [F.col(p).alias(o) for o, p in paths.items()]
    return df.select(*cols)


def array_concat(arr: ColumnOrName, sep: str = ";") -> Column:
    """[§2.9 array_distinct_concat] ``aggregate(array_distinct(arr), '', concat_ws)``.

    Semantics of the fold as written: a leading separator (``';a;b'``), NULL
    elements skipped, empty array -> ``''``, NULL array -> NULL.  Expressed
    with ``array_distinct`` and ``concat_ws``; a filter tells an array of nulls
    (empty text) from one with elements.
    """
    a = F.array_distinct(_col(arr))
    non_null = F.filter(a, lambda x: x.isNotNull())
    return (F.when(a.isNull(), F.lit(None).cast("string"))
            .when(F.size(non_null) == 0, F.lit(""))
            .otherwise(F.concat(F.lit(sep), F.concat_ws(sep, non_null))))


def to_int_lenient(c: ColumnOrName) -> Column:
    """[B8] String -> int that never fails: ``'12'``->12, ``'12.7'``->12, ``'x'``->NULL.

    Spark 4 runs with ANSI casts, where ``cast('12.7' as int)`` throws; the
    reference relied on the non-ANSI behaviour (truncate toward zero / NULL).
    """
    d = _col(c).cast("string").try_cast("double")
    return F.when((d >= -2147483648.0) & (d <= 2147483647.0), d.cast("int"))


def to_ts_lenient(c: ColumnOrName, fmt: str | None = None) -> Column:
    """[B8] String -> TIMESTAMP_NTZ, NULL when unparsable.

    NTZ keeps wall-clock values independent of the session time zone.
    """
    col = _col(c).cast("string")
    if fmt is None:
        return col.try_cast("timestamp_ntz")
    return F.try_to_timestamp(col, F.lit(fmt)).cast("timestamp_ntz")
