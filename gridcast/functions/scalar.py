"""Scalar expressions of the pipeline (profile, temperature, clip, band, tiers)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config as C
from .temporal import weekday0


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def rnd(col, digits: int) -> Column:
    """Round to ``digits`` decimals as ``round(x * 10^d) / 10^d`` (half away from zero).

    Operates on the binary value scaled by 10^d, like numpy's ``round``;
    Spark's ``round(x, d)`` would round the shortest decimal text instead.
    """
    f = float(10 ** digits)
    return F.round(_c(col) * F.lit(f), 0) / F.lit(f) + F.lit(0.0)  # + 0.0 turns -0.0 into 0.0


def fixed_text(col, digits: int) -> Column:
    """Number as text with exactly ``digits`` decimals (after :func:`rnd`)."""
    return F.format_string(f"%.{digits}f", rnd(col, digits))


SUM_SCALE = 9   # decimals kept when values are added as DECIMAL


def exact_sum(col, scale: int = SUM_SCALE) -> Column:
    """Sum as DECIMAL with ``scale`` decimals, cast to DOUBLE: the same in whatever order rows are added."""
    return F.sum(_c(col).cast(f"decimal(38,{scale})")).cast("double")


def exact_mean(col, scale: int = SUM_SCALE) -> Column:
    """:func:`exact_sum` over the count, so rounding it later gives the same digits on every engine."""
    return exact_sum(col, scale) / F.count(_c(col))


def coerce_numeric(col) -> Column:
    """Text to DOUBLE, bad text to null (never throws under ANSI mode); NaN becomes null."""
    v = _c(col).cast("string").try_cast("double")
    return F.when(F.isnan(v), F.lit(None).cast("double")).otherwise(v)


def not_missing(col) -> Column:
    """True when a DOUBLE value is neither null nor NaN."""
    c = _c(col)
    return c.isNotNull() & ~F.isnan(c)


def clip(col, lo: float, hi: float) -> Column:
    """Clip to ``[lo, hi]``; null and NaN stay missing (``greatest(null, 0)`` would be 0)."""
    c = _c(col)
    return F.when(not_missing(c), F.least(F.greatest(c, F.lit(lo)), F.lit(hi)))


def clip_forecast(col) -> Column:
    lo, hi = C.FORECAST_CLIP
    return clip(col, lo, hi)


def season_factor(ds="ds") -> Column:
    return F.when(F.month(_c(ds)).isin(*C.SEASON_MONTHS), F.lit(C.SEASON_FACTOR)).otherwise(F.lit(1.0))


def weekend_factor(ds="ds") -> Column:
    return F.when(weekday0(_c(ds)) >= 5, F.lit(C.WEEKEND_FACTOR)).otherwise(F.lit(1.0))


def hourly_shape(ds="ds") -> Column:
    shape = F.array(*[F.lit(float(v)) for v in C.HOURLY_SHAPE])
    return F.element_at(shape, F.hour(_c(ds)) + 1)


def expected_load(ds="ds", base: float = C.BASE_MW, peak: float = C.PEAK_MW) -> Column:
    """Noise-free load profile: base + (peak - base) x shape x season x weekend, floored at half base."""
    raw = F.lit(base) + F.lit(peak - base) * hourly_shape(ds) * season_factor(ds) * weekend_factor(ds)
    return F.greatest(F.lit(base * 0.5), raw)


def temperature_proxy(ds="ds", cool_base: float = C.TEMP_BASE_COOL) -> Column:
    """Synthetic temperature without noise: seasonal base plus a diurnal sine, 2 decimals."""
    c = _c(ds)
    base = F.when(F.month(c).isin(*C.SEASON_MONTHS), F.lit(C.TEMP_BASE_WARM)).otherwise(F.lit(cool_base))
    swing = F.lit(C.TEMP_SWING) * F.sin((F.hour(c) - 6) * F.lit(math.pi / 12))
    return rnd(base + swing, 2)


def proportional_band(col, pct: float = C.BAND_PCT) -> tuple[Column, Column]:
    """(lower, upper) = (max(0, (1 - pct) p), (1 + pct) p); not capped."""
    p = _c(col)
    return F.greatest(F.lit(0.0), p * F.lit(1 - pct)), p * F.lit(1 + pct)


def alert_flag(col, threshold: float) -> Column:
    """Unrounded prediction at or above the threshold; a missing prediction is not an alert."""
    return F.coalesce(_c(col) >= F.lit(float(threshold)), F.lit(False))


def _tiers(col, tiers, otherwise) -> Column:
    c = _c(col)
    expr = None
    for bound, label in tiers:
        expr = F.when(c < F.lit(bound), F.lit(label)) if expr is None else expr.when(c < F.lit(bound), F.lit(label))
    return expr.otherwise(F.lit(otherwise))


def quality_tier(mape) -> Column:
    """Leaderboard scale: <5 excellent, <10 very good, <20 acceptable, else needs improvement."""
    return _tiers(mape, C.LEADERBOARD_TIERS, C.LEADERBOARD_TIER_ELSE)


def report_tier(mape) -> Column:
    """Report scale: <5 excellent, <10 acceptable, else needs improvement."""
    return _tiers(mape, C.REPORT_TIERS, C.REPORT_TIER_ELSE)


def display_time(ds="ds") -> Column:
    """Dashboard label ``dd Mon HH:mm``."""
    return F.date_format(_c(ds), "dd MMM HH:mm")


def hhmm(ts) -> Column:
    return F.date_format(_c(ts), "HH:mm")
