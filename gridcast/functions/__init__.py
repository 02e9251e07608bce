"""Column expressions (all Catalyst, no Python UDFs)."""

from .scalar import (  # noqa: F401
    alert_flag,
    clip,
    clip_forecast,
    coerce_numeric,
    display_time,
    SUM_SCALE,
    exact_mean,
    exact_sum,
    expected_load,
    fixed_text,
    hhmm,
    hourly_shape,
    not_missing,
    proportional_band,
    quality_tier,
    report_tier,
    rnd,
    season_factor,
    temperature_proxy,
    weekend_factor,
)
from .temporal import (  # noqa: F401
    add_hours,
    add_minutes,
    calendar_columns,
    day_of,
    epoch_days,
    epoch_hours,
    format_period,
    fourier_columns,
    fourier_names,
    hour_floor,
    parse_period,
    weekday0,
    utc_now,
)
