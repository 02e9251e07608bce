"""Time expressions: hour buckets, period parsing, calendar and Fourier terms.

All of them are Catalyst expressions (whole-stage codegen, no Python at run
time). Hour and day buckets are built from the wall-clock fields, so a
``TIMESTAMP_NTZ`` input gives the same answer under any session time zone.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import SEASONALITIES


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def hour_floor(col) -> Column:
    """Start of the hour as ``TIMESTAMP_NTZ`` (wall clock, zone independent)."""
    c = _c(col)
    return F.make_timestamp_ntz(F.year(c), F.month(c), F.dayofmonth(c), F.hour(c), F.lit(0), F.lit(0))


def day_of(col) -> Column:
    """Start of the calendar day as ``TIMESTAMP_NTZ`` (midnight, wall clock)."""
    c = _c(col)
    return F.make_timestamp_ntz(F.year(c), F.month(c), F.dayofmonth(c), F.lit(0), F.lit(0), F.lit(0))


def parse_period(col) -> Column:
    """Demand-API period text ``YYYY-MM-DDTHH`` to ``TIMESTAMP_NTZ``; bad text gives null."""
    return F.try_to_timestamp(_c(col), F.lit("yyyy-MM-dd'T'HH")).cast("timestamp_ntz")


def format_period(col) -> Column:
    """Inverse of :func:`parse_period`."""
    return F.date_format(_c(col), "yyyy-MM-dd'T'HH")


def weekday0(col) -> Column:
    """Day of week, Monday = 0 ... Sunday = 6."""
    return F.weekday(_c(col))


def utc_now() -> Column:
    """The current time as a UTC wall clock (``TIMESTAMP_NTZ``), whatever the session's time zone."""
    return F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()).cast("timestamp_ntz")


def epoch_days(col) -> Column:
    """Days since 1970-01-01 as DOUBLE, from wall-clock fields (the Fourier time axis)."""
    c = _c(col)
    secs = F.hour(c) * 3600 + F.minute(c) * 60 + F.second(c)
    return F.datediff(F.to_date(c), F.lit("1970-01-01").cast("date")) + secs / F.lit(86400.0)


def epoch_hours(col) -> Column:
    """Whole hours since 1970-01-01 as BIGINT (for hour arithmetic and lags)."""
    c = _c(col)
    return (F.datediff(F.to_date(c), F.lit("1970-01-01").cast("date")).cast("bigint") * 24 + F.hour(c)).cast("bigint")


def add_hours(col, n) -> Column:
    """``col`` plus ``n`` hours (``n`` a column or int), wall-clock arithmetic."""
    n_col = n if isinstance(n, Column) else F.lit(int(n))
    return _c(col) + F.make_dt_interval(F.lit(0), n_col.cast("int"), F.lit(0), F.lit(0.0))


def add_minutes(col, n) -> Column:
    n_col = n if isinstance(n, Column) else F.lit(int(n))
    return _c(col) + F.make_dt_interval(F.lit(0), F.lit(0), n_col.cast("int"), F.lit(0.0))


def calendar_columns(ds="ds") -> dict[str, Column]:
    """Cyclical hour and normalised weekday (the sequence model's time features)."""
    c = _c(ds)
    angle = F.lit(2 * math.pi) * F.hour(c) / F.lit(24.0)
    return {
        "hour_sin": F.sin(angle),
        "hour_cos": F.cos(angle),
        "weekday": weekday0(c) / F.lit(6.0),
    }


def fourier_columns(ds="ds", seasonalities=SEASONALITIES) -> dict[str, Column]:
    """``sin`` and ``cos`` terms ``2 pi k t / period`` for k = 1..order of each seasonality.

    With the default (daily 12, weekly 5, yearly 8) this gives 50 columns named
    ``<name>_sin_<k>`` / ``<name>_cos_<k>``.
    """
    t = epoch_days(ds)
    cols: dict[str, Column] = {}
    for name, period, order in seasonalities:
        for k in range(1, order + 1):
            arg = F.lit(2 * math.pi * k / period) * t
            cols[f"{name}_sin_{k}"] = F.sin(arg)
            cols[f"{name}_cos_{k}"] = F.cos(arg)
    return cols


def fourier_names(seasonalities=SEASONALITIES) -> list[str]:
    return list(fourier_columns("ds", seasonalities).keys())
