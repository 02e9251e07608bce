"""Additive trend + Fourier seasonality model (M1 fit, M2 forecast).

``y(t) = a + k t + sum_j d_j (t - s_j)+ + sum seasonal Fourier terms``, with
``t`` the series' time scaled to [0, 1] over its history, 25 changepoints
``s_j`` evenly spread over the first 80% of it, and daily (order 12), weekly
(5) and yearly (8) seasonalities. The fit works on each series' normal
equations (:mod:`gridcast.models.ridge`), in one of two forms:

* ``prior="laplace"`` (default): the trend changes have a Laplace prior of
  scale 0.15 relative to the district peak. With residual variance s^2 (that
  of the fit without it) this is an absolute penalty of weight ``s^2 / scale``
  on each ``d_j``, solved by coordinate descent on the sums; most changes are 0.
* ``prior="gaussian"``: a squared penalty of the same scale, one linear solve.

The seasonal penalty plays the role of the seasonality prior. The band (80%)
is either Gaussian from the residual standard deviation (+/- 1.2816 sigma) or
sampled: future trend changes are drawn as often and as large as the fitted
ones, and the band is their quantiles with the residual noise added.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import config as C
from ..functions import alert_flag, clip, epoch_days, fourier_columns, not_missing, rnd, utc_now
from .ridge import Sums, built_sums, dot, ridge_solver, solve_sums

DRAWS = 1000               # sampled futures of a band
Z80 = 1.2815515655446004   # standard normal 90% quantile: an 80% two-sided band


def _penalties(n_cp: int, n_season: int) -> list[float]:
    cp = (1.0 / (C.CHANGEPOINT_PRIOR_SCALE * C.PEAK_MW)) ** 2
    season = (1.0 / (10.0 * C.PEAK_MW)) ** 2
    return [1e-6, 1e-6] + [cp] * n_cp + [max(season, 1e-6)] * n_season


def _design(ts_col, t0, t1, n_cp: int, cp_range: float, seasonalities) -> F.Column:
    span = F.nullif(t1 - t0, F.lit(0.0))
    t = F.coalesce(F.try_divide(epoch_days(ts_col) - t0, span), F.lit(0.0))
    cps = [F.greatest(t - F.lit(cp_range * j / n_cp), F.lit(0.0)) for j in range(1, n_cp + 1)]
    seas = list(fourier_columns(ts_col, seasonalities).values())
    return F.array(F.lit(1.0), t, *cps, *seas)


GROUP = ("t0", "t1", "last_ds", "y_scale")   # what the design rows of a series carry


def design_matrix(days: np.ndarray, t0: float, t1: float, n_cp: int = C.N_CHANGEPOINTS, cp_range: float = C.CHANGEPOINT_RANGE,
                  seasonalities=C.SEASONALITIES) -> np.ndarray:
    """The same design as :func:`_design`, for one series' times in epoch days."""
    t = (days - t0) / (t1 - t0) if t1 > t0 else np.zeros(len(days))
    columns = [np.ones(len(days)), t] + [np.maximum(t - cp_range * j / n_cp, 0.0) for j in range(1, n_cp + 1)]
    for _, period, order in seasonalities:
        for k in range(1, order + 1):
            columns += [np.sin(2 * np.pi * k / period * days), np.cos(2 * np.pi * k / period * days)]
    return np.column_stack(columns)


def matrix_builder(n_cp: int = C.N_CHANGEPOINTS, cp_range: float = C.CHANGEPOINT_RANGE, seasonalities=C.SEASONALITIES):
    """Design and target of one series' rows ``(t0, t1, day, y)``."""
    def build(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        days = pdf["day"].to_numpy(np.float64)
        return design_matrix(days, pdf["t0"].iloc[0], pdf["t1"].iloc[0], n_cp, cp_range, seasonalities), pdf["y"].to_numpy(np.float64)

    return build


def _bounded(df: DataFrame, value: str, key: str, ts: str, rescale: bool) -> DataFrame:
    """The rows with a value, with their series' bounds.

    The bounds are a grouped aggregate joined by key, so the rows of one
    large series stay spread over tasks for the partial normal equations.
    """
    rows = df.where(not_missing(value)).select(key, ts, value)
    size = F.max(F.abs(F.col(value)))
    scale = F.when(size > 0, size / F.lit(C.PEAK_MW)).otherwise(F.lit(1.0)) if rescale else F.lit(1.0)
    bounds = rows.groupBy(key).agg(F.min(epoch_days(ts)).alias("t0"), F.max(epoch_days(ts)).alias("t1"), F.max(ts).alias("last_ds"),
                                   scale.alias("y_scale"))
    return rows.join(bounds, key)


def design_rows(df: DataFrame, value: str = "load_mw", key: str = "series_id", ts: str = "ds",
                n_changepoints: int = C.N_CHANGEPOINTS, seasonalities=C.SEASONALITIES, rescale: bool = False) -> DataFrame:
    """``(key, t0, t1, last_ds, y_scale, x, y)``, one row per observation."""
    return _bounded(df, value, key, ts, rescale).select(
        key, *GROUP,
        _design(F.col(ts), F.col("t0"), F.col("t1"), n_changepoints, C.CHANGEPOINT_RANGE, seasonalities).alias("x"),
        (F.col(value) / F.col("y_scale")).alias("y"),
    )


def penalties(n_changepoints: int = C.N_CHANGEPOINTS, seasonalities=C.SEASONALITIES) -> list[float]:
    return _penalties(n_changepoints, sum(2 * o for _, _, o in seasonalities))


def changepoint_columns(n_changepoints: int = C.N_CHANGEPOINTS) -> range:
    """Places of the trend changes in the design."""
    return range(2, 2 + n_changepoints)


def additive_solver(prior: str = "laplace", n_changepoints: int = C.N_CHANGEPOINTS, seasonalities=C.SEASONALITIES):
    """How a series' sums are solved under the given changepoint prior."""
    pen = np.asarray(penalties(n_changepoints, seasonalities))
    if prior == "gaussian":
        return ridge_solver(pen)
    if prior != "laplace":
        raise ValueError("prior must be laplace or gaussian")
    at = changepoint_columns(n_changepoints)
    smooth = pen.copy()
    smooth[at.start:at.stop] = 0.0

    def solve(sums: Sums, row) -> tuple[np.ndarray, float, float]:
        noise = sums.sigma(sums.ridge(pen))
        weight = noise * noise / (C.CHANGEPOINT_PRIOR_SCALE * C.PEAK_MW)
        b = sums.ridge_and_laplace(smooth, slice(at.start, at.stop), weight)
        return b, sums.sigma(b), weight

    return solve


def model_table(fit: DataFrame, key: str = "series_id", n_changepoints: int = C.N_CHANGEPOINTS, fitted_at=None) -> DataFrame:
    """The model's columns from a fit that carries the series' bounds."""
    stamp = F.lit(fitted_at).cast("timestamp_ntz") if fitted_at is not None else utc_now()
    return fit.select(
        key, F.lit("additive").alias("model"), stamp.alias("fitted_at"), "t0", "t1", "last_ds", "y_scale",
        F.lit(n_changepoints).alias("n_changepoints"), "coef", "sigma", "n", "penalty_weight",
    )


def fit_additive(df: DataFrame, value: str = "load_mw", key: str = "series_id", ts: str = "ds",
                 n_changepoints: int = C.N_CHANGEPOINTS, seasonalities=C.SEASONALITIES,
                 rescale: bool = False, fitted_at=None, prior: str = "laplace") -> DataFrame:
    """Fit per series; returns the model as a table (one row per series).

    The penalties suit values of the district's size. With ``rescale`` the
    target is first scaled so that its largest size is the district peak
    (column ``y_scale`` of the model undoes it); use it for values in other
    units.
    """
    rows = _bounded(df, value, key, ts, rescale).select(key, *GROUP, epoch_days(ts).alias("day"), (F.col(value) / F.col("y_scale")).alias("y"))
    keys, p = [key, *GROUP], len(penalties(n_changepoints, seasonalities))
    sums = built_sums(rows, keys, p, matrix_builder(n_changepoints, C.CHANGEPOINT_RANGE, seasonalities))
    fit = solve_sums(sums, keys, p, additive_solver(prior, n_changepoints, seasonalities))
    return model_table(fit, key, n_changepoints, fitted_at)


def additive_value(ts: str = "ds", seasonalities=C.SEASONALITIES, n_changepoints: int = C.N_CHANGEPOINTS) -> F.Column:
    """The model's value at ``ts`` for a row that carries the model's columns."""
    design = _design(F.col(ts), F.col("t0"), F.col("t1"), int(n_changepoints), C.CHANGEPOINT_RANGE, seasonalities)
    return dot(design, F.col("coef")) * F.col("y_scale")


def trend_quantiles(coef, t0: float, t1: float, sigma: float, last: float, days: np.ndarray, seed: int,
                    n_changepoints: int = C.N_CHANGEPOINTS, cp_range: float = C.CHANGEPOINT_RANGE, draws: int = DRAWS,
                    share: float = 0.8) -> np.ndarray:
    """(2, steps): lower and upper quantile of what future trend changes and noise add to the forecast.

    Changes come as often as in the fitted range (``n_changepoints`` over
    ``cp_range`` of the history), each with a Laplace size whose mean is that
    of the fitted changes; the seed fixes all draws.
    """
    rng = np.random.default_rng(seed & 0xFFFFFFFFFFFFFFFF)
    span = t1 - t0
    t = (days - t0) / span if span else np.zeros(len(days))
    begin = (last - t0) / span if span else 0.0
    size = float(np.abs(np.asarray(coef)[2:2 + n_changepoints]).mean()) if n_changepoints else 0.0
    ahead = max(0.0, float(t[-1]) - begin)
    many = rng.poisson(n_changepoints / cp_range * ahead, draws)
    added = np.zeros((draws, len(t)))
    width = int(many.max(initial=0))
    if size and width:
        at = begin + ahead * rng.random((draws, width))
        change = np.where(np.arange(width) < many[:, None], rng.laplace(0.0, size, (draws, width)), 0.0)
        for j in range(width):
            added += change[:, j:j + 1] * np.maximum(t[None, :] - at[:, j:j + 1], 0.0)
    added += rng.normal(0.0, sigma, added.shape)
    return np.quantile(added, [(1 - share) / 2, (1 + share) / 2], axis=0)


def _sampled(hours: int, step_days: float, n_changepoints: int, draws: int):
    """Adds ``low`` and ``high``, one entry a step, to each model row of (..., coef, t0, t1, sigma, last_day, seed)."""
    days = step_days * np.arange(1, hours + 1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            bands = [trend_quantiles(r.coef, r.t0, r.t1, r.sigma, r.last_day, r.last_day + days, int(r.seed), n_changepoints, draws=draws)
                     for r in pdf.itertuples()]
            yield pdf.assign(low=[b[0] for b in bands], high=[b[1] for b in bands])

    return run


def forecast_additive(model: DataFrame, hours: int, threshold: float | None = C.THRESHOLD_MW, key: str = "series_id",
                      seasonalities=C.SEASONALITIES, n_changepoints: int = C.N_CHANGEPOINTS,
                      generated_at=None, step: str = "1 HOUR", bounds: tuple | None = C.FORECAST_CLIP,
                      band: str = "gaussian", draws: int = DRAWS) -> DataFrame:
    """Forecast ``hours`` steps after each series' last observed one (D7 rows).

    ``step`` is the series' own interval, ``bounds`` what predictions and band
    are clipped to (None: nothing), ``threshold`` None raises no alerts.
    ``band`` is ``gaussian`` or ``sampled``; a sampled one comes from ``draws``
    futures, seeded by the series and its last time, so reruns agree.
    """
    if not 1 <= int(hours) <= C.MAX_HORIZON_H:
        raise ValueError("hours must be in 1..168")
    if band not in ("gaussian", "sampled"):
        raise ValueError("band must be gaussian or sampled")
    each = F.expr(f"INTERVAL {step}")
    rows = model.select(key, "t0", "t1", "coef", "sigma", "y_scale", "last_ds")
    spread = F.lit(Z80) * F.col("sigma") * F.col("y_scale")
    low, high = -spread, spread
    if band == "sampled":
        rows = rows.withColumns({"last_day": epoch_days("last_ds"), "seed": F.xxhash64(key, F.col("last_ds").cast("string"))})
        extra = [T.StructField(c, T.ArrayType(T.DoubleType())) for c in ("low", "high")]
        begin = F.lit("1970-01-01").cast("timestamp_ntz")
        step_days = rows.sparkSession.range(1).select(epoch_days(begin + each).alias("d")).first()["d"]
        rows = rows.mapInPandas(_sampled(int(hours), float(step_days), int(n_changepoints), int(draws)), T.StructType(rows.schema.fields + extra))
        low, high = (F.get(c, F.col("_k")) * F.col("y_scale") for c in ("low", "high"))
    carried = [c for c in ("low", "high") if c in rows.columns]
    grid = rows.select(
        key, "t0", "t1", "coef", "sigma", "y_scale", *carried,
        F.posexplode(F.transform(F.sequence(F.lit(1), F.lit(int(hours))), lambda k: F.col("last_ds") + each * k)).alias("_k", "ds"),
    )
    yhat = additive_value("ds", seasonalities, n_changepoints)
    stamp = F.lit(generated_at).cast("timestamp_ntz") if generated_at is not None else utc_now()
    out = grid.select(key, (F.col("_k") + 1).cast("int").alias("step"), "ds", low.alias("_low"), high.alias("_high"), yhat.alias("_y"))

    def clipped(c):
        return c if bounds is None else clip(c, *bounds)

    p = clipped(F.col("_y"))
    return out.select(
        key, F.lit("additive").alias("model"), stamp.alias("generated_at"), "step", "ds",
        rnd(p, 3).alias("predicted_mw"),
        rnd(clipped(F.col("_y") + F.col("_low")), 3).alias("lower_mw"),
        rnd(clipped(F.col("_y") + F.col("_high")), 3).alias("upper_mw"),
        (F.lit(False) if threshold is None else alert_flag(p, threshold)).alias("alert"),
    )
