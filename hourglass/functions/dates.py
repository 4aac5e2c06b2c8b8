"""Date and time helpers (ages, hour differences, hour buckets)."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F

# The clinical extract the analysis ran on was cut in December 2021; ages are
# computed against an explicit date instead of current_date() so results do
# not drift from day to day.
DEFAULT_AS_OF = "2021-12-01"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def as_date(value: Column | str | _dt.date) -> Column:
    """Literal date / date string / Column -> DATE column."""
    if isinstance(value, (_dt.date, _dt.datetime)):
        return F.lit(value.strftime("%Y-%m-%d")).cast("date")
    if isinstance(value, str) and len(value) == 10 and value[4] == "-":
        return F.lit(value).cast("date")
    return F.to_date(_c(value))


def age_years(birth: Column | str, as_of: Column | str | _dt.date = DEFAULT_AS_OF,
              divisor: float = 365.25) -> Column:
    """[§2.9 age_years] ``floor(datediff(as_of, birth) / divisor)`` as INT.

    Negative for births after ``as_of`` (floor goes down: -0.4 -> -1).
    """
    b = F.to_date(_c(birth).cast("string").try_cast("timestamp_ntz"))
    return F.floor(F.datediff(as_date(as_of), b) / F.lit(float(divisor))).cast("int")


def seconds_between(start: Column | str, end: Column | str) -> Column:
    """Whole seconds from ``start`` to ``end``; works on NTZ without a time zone."""
    return F.timestamp_diff("SECOND", _c(start), _c(end))


def hours_between(start: Column | str, end: Column | str) -> Column:
    """[§2.9 hours_between] ``(unix_timestamp(end) - unix_timestamp(start)) / 3600`` as DOUBLE."""
    return seconds_between(start, end) / F.lit(3600.0)


def hour_mark(ts: Column | str) -> Column:
    """Truncate to the hour, keeping TIMESTAMP_NTZ."""
    return F.date_trunc("hour", _c(ts)).cast("timestamp_ntz")
