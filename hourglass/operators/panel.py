"""Regular hourly panel of measurements: key spine, join policies, long form.

[H1 D4 D5 D6 B4 B8 J13]
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.nested import to_int_lenient

KEYS = ("personid", "encounterid", "hour_mark")


def key_spine(frames: Sequence[DataFrame], keys: Sequence[str] = KEYS, distinct: bool = True) -> DataFrame:
    """[H1] Union of the key columns of every frame; ``distinct=False`` is UNION ALL as written."""
    out = None
    for f in frames:
        k = f.select(*keys)
        out = k if out is None else out.unionByName(k)
    return out.distinct() if distinct else out


def panel_join(frames: Mapping[str, DataFrame] | Sequence[DataFrame], keys: Sequence[str] = KEYS,
               policy: str = "inner", spine_distinct: bool = True) -> DataFrame:
    """[D4 D5 D6 D2 J13] Chain-join per-measurement tables on the panel key.

    ``inner`` – hours with every measurement; ``outer`` – full outer USING
    (keys coalesced); ``spine`` – left joins from the union of all keys
    (``spine_distinct=False`` reproduces the UNION ALL fan-out).  Inputs are
    expected unique per key, so every join is 1:1.  Inner and left joins keep the
    hash partitioning on the key; full outer joins shuffle the coalesced key
    again (``panel_from_long`` needs one shuffle for either policy).
    """
    fs = list(frames.values()) if isinstance(frames, Mapping) else list(frames)
    keys = list(keys)
    if policy == "spine":
        out = key_spine(fs, keys, spine_distinct)
        for f in fs:
            out = out.join(f, on=keys, how="left")
        return out
    how = {"inner": "inner", "outer": "full_outer"}[policy]
    out = fs[0]
    for f in fs[1:]:
        out = out.join(f, on=keys, how=how)
    return out


def panel_from_long(long: DataFrame, kinds: Sequence[str], keys: Sequence[str] = KEYS,
                    kind_col: str = "vital", value_col: str = "value", policy: str = "outer") -> DataFrame:
    """[E8 rewrite of D4/D5] One aggregation instead of a chain of joins.

    ``groupBy(keys).agg(max(when(kind = k, value)) ...)``: a single shuffle
    with map-side combine.  Equal to ``panel_join`` with policy ``outer``
    (== distinct ``spine``) when (key, kind) is unique; ``inner`` keeps rows
    with every kind present.
    """
    aggs = [F.max(F.when(F.col(kind_col) == F.lit(k), F.col(value_col))).alias(k) for k in kinds]
    wide = long.groupBy(*keys).agg(*aggs)
    if policy == "inner":
        cond = None
        for k in kinds:
            c = F.col(k).isNotNull()
            cond = c if cond is None else cond & c
        wide = wide.where(cond)
    return wide


def cast_measurements(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """[B8] Lenient string -> int casts of measurement columns (never throws under ANSI)."""
    return df.withColumns({c: to_int_lenient(c) for c in cols})
