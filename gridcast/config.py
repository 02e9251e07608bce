"""Parameters of the load pipeline, kept in one dataclass.

Values marked FIXED are the reference behaviour and must stay as written for
results to agree with it.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# ---------------------------------------------------------------------------
# FIXED values (taken as-is from the reference behaviour)
# ---------------------------------------------------------------------------
DISTRICT = "Texas ERCOT, United States"   # district named in alert events
BASE_MW = 12.0                      # district base load
PEAK_MW = 22.0                      # district peak load
THRESHOLD_MW = 20.0                 # alert threshold
FORECAST_CLIP = (0.0, 50.0)         # forecasts are clipped to this range
RESCALE_QUANTILES = (0.01, 0.99)    # outlier clip for the min-max rescale
RESCALE_FLOOR_FACTOR = 0.5          # rescaled load floor = 0.5 x base
RESCALE_CAP_FACTOR = 1.1            # rescaled load cap = 1.1 x peak
BAND_PCT = 0.08                     # proportional band of the sequence model
FALLBACK_TEMP_C = 21.5              # temperature used when weather is missing
SEQUENCE_LEN = 24                   # lags used by the autoregressive model
TEST_RATIO = 0.20                   # hold-out share (last 20% of rows)
VALIDATION_RATIO = 0.10             # validation share of the training windows
MAX_HORIZON_H = 168                 # longest forecast horizon
MAX_ALERT_LIMIT = 100               # largest alert page
ALERT_COOLDOWN_S = 300              # a repeat inside 300 s is not a new alert
MODEL_NAMES = ("prophet", "lstm")   # the two model names of the API
CHANGEPOINT_PRIOR_SCALE = 0.15      # trend flexibility of the additive model
N_CHANGEPOINTS = 25                 # trend changepoints of the additive model
CHANGEPOINT_RANGE = 0.8             # changepoints lie in the first 80% of history

# Seasonalities of the additive model: (name, period in days, Fourier order).
SEASONALITIES = (("daily", 1.0, 12), ("weekly", 7.0, 5), ("yearly", 365.25, 8))

# Coefficients of the fixed model that checks the additive design (intercept, slope, 25 changepoints, 50 seasonal terms).
CHECK_COEFFICIENTS = (9.0, 1.5) + tuple(round(0.2 * (j % 5 - 2), 1) for j in range(25)) + tuple(round(0.05 * (k % 7 - 3), 2) for k in range(50))

# Hourly load shape, hour 0..23, as fractions of (peak - base).
HOURLY_SHAPE = (
    0.40, 0.35, 0.32, 0.30, 0.32, 0.45,
    0.70, 0.90, 0.95, 0.85, 0.75, 0.70,
    0.65, 0.62, 0.60, 0.63, 0.68, 0.78,
    0.95, 1.00, 0.98, 0.90, 0.78, 0.60,
)
SEASON_MONTHS = (6, 7, 8, 9, 12, 1)   # months with the 1.08 seasonal factor
SEASON_FACTOR = 1.08
WEEKEND_FACTOR = 0.90                 # Saturday and Sunday
TEMP_BASE_WARM = 22.0                 # temperature base in SEASON_MONTHS
TEMP_BASE_COOL = 19.5                 # temperature base otherwise
TEMP_SWING = 5.0                      # diurnal swing amplitude

# The five load-shedding zones in priority order.
ZONES = (
    ("Houston Zone (ERCOT-H)", 1),
    ("North Zone (ERCOT-N)", 2),
    ("West Zone (ERCOT-W)", 3),
    ("South Zone (ERCOT-S)", 4),
    ("Far West Zone (ERCOT-FW)", 5),
)

# Message texts of alerts, statuses and recommendations (results must carry them as they are).
SMS_TEXT = ("[TEXAS ERCOT ENERGY ALERT]\nPredicted peak: ", " MW at ", "\nLoad shedding: ", "\nReduce usage where possible.")
SUBJECT_TEXT = ("[ALERT] Texas ERCOT grid peak ", " MW forecast — ")
MORE_ZONES_TEXT = " +%d more"
STATUS_OK = "All forecast values within safe threshold"
RECOMMENDATION_TEXT = ("%s is recommended because it has the lowest combined error score. Its MAPE is %s%%, which is %s for this "
                       "use case. Lower MAE/RMSE means the model stays closer to real demand in MW, while lower MAPE "
                       "means better percentage accuracy.")

# Model quality tiers by MAPE (%). Two scales exist: the leaderboard and the report.
LEADERBOARD_TIERS = ((5.0, "excellent"), (10.0, "very good"), (20.0, "acceptable"))
LEADERBOARD_TIER_ELSE = "needs improvement"
REPORT_TIERS = ((5.0, "excellent"), (10.0, "acceptable"))
REPORT_TIER_ELSE = "needs improvement"
# ---------------------------------------------------------------------------

@dataclass(frozen=True)
class GridConfig:
    """Run parameters; one instance is passed through a job."""

    threshold_mw: float = THRESHOLD_MW
    base_mw: float = BASE_MW
    peak_mw: float = PEAK_MW
    zones: tuple = field(default=ZONES)
    test_ratio: float = TEST_RATIO
    validation_ratio: float = VALIDATION_RATIO
    sequence_len: int = SEQUENCE_LEN
    fallback_temp_c: float = FALLBACK_TEMP_C
    temp_base_cool: float = TEMP_BASE_COOL

    @property
    def rescale_floor(self) -> float:
        return self.base_mw * RESCALE_FLOOR_FACTOR

    @property
    def rescale_cap(self) -> float:
        return self.peak_mw * RESCALE_CAP_FACTOR
