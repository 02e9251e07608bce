"""Autoregressive model (M3 fit) and recursive multi-step forecast (M4).

Features of hour ``t`` (all min-max scaled per series with bounds fitted on
the training rows only): the previous 24 hourly loads (by time, on the
complete grid; windows touching a gap are dropped), and the temperature,
``hour_sin``, ``hour_cos`` and weekday of hour ``t``. Target: the scaled
load of hour ``t``. The normal equations are summed over unscaled features, block
of hours by block, and mapped to the scaled ones in the ridge solve.

The forecast is one Catalyst ``aggregate`` fold per series over the
horizon's covariates: each step's prediction (clipped to 0..50 MW) is fed
back into the 24-hour window of the next step. Nothing leaves the JVM, and
the per-series state (24 lags, <= 168 covariate rows) is bounded.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import config as C
from ..functions import add_hours, alert_flag, calendar_columns, clip_forecast, epoch_days, epoch_hours, not_missing, proportional_band, rnd, utc_now
from ..operators.align import attach_weather, score_with_model
from ..operators.grid import BLOCK_H, hourly_spine, overlapping_blocks
from .ridge import Sums, dot, solve_sums

FEATURES = ("load_mw", "temp_c", "hour_sin", "hour_cos", "weekday")
COVARIATES = FEATURES[1:]
LAG_BLOCK_H = 720   # hours of a series whose lags one task takes


def with_temperature(rows: DataFrame, weather: DataFrame | None) -> DataFrame:
    """``rows`` with ``temp_c``, the fallback temperature where there is no weather."""
    return attach_weather(rows, weather) if weather is not None else rows.withColumn("temp_c", F.lit(C.FALLBACK_TEMP_C))


def _features(grid: DataFrame, weather: DataFrame | None, ts: str = "ds") -> DataFrame:
    return with_temperature(grid, weather).withColumns(calendar_columns(ts))


def _scaled(col: str) -> Column:
    lo, hi = F.col(f"{col}_min"), F.col(f"{col}_max")
    return F.coalesce(F.try_divide(F.col(col) - lo, F.nullif(hi - lo, F.lit(0.0))), F.lit(0.0))


def training_rows(history: DataFrame, weather: DataFrame | None = None, value: str = "load_mw",
                  key: str = "series_id", ts: str = "ds", n_lags: int = C.SEQUENCE_LEN, train_until=None) -> DataFrame:
    """Design rows ``(key, bounds..., last_ds, x, y)``; bounds are one aggregated row per series, joined by key.

    Lags are taken within blocks of ``LAG_BLOCK_H`` hours; the last
    ``n_lags`` hours of a block are also given to the next one, so a long
    series is spread over many tasks and no lag is lost at a border.
    ``train_until``: only rows before it are used (for the bounds too).
    """
    hist = history.select(key, ts, F.col(value).alias("load_mw"))
    if train_until is not None:
        hist = hist.where(F.col(ts) < F.lit(train_until).cast("timestamp_ntz"))
    present = F.col("load_mw").isNotNull()
    ends = [f(c).alias(f"{c}_{name}") for c in FEATURES for f, name in ((F.min, "min"), (F.max, "max"))]
    bounds = _features(hist.where(present), weather, ts).groupBy(key).agg(*ends, F.max(ts).alias("last_ds"))
    names = [c for c in bounds.columns if c != key]
    feats = _features(hourly_spine(hist, key, ts, ["load_mw"]), weather, ts)
    scaled = feats.join(bounds, key).select(key, ts, *names, *[_scaled(c).alias(c) for c in FEATURES], present.alias("_present"))
    blocks = overlapping_blocks(scaled, n_lags, LAG_BLOCK_H, ts)
    w = Window.partitionBy(key, "_block").orderBy(ts)
    lags = [F.when(F.lag("_present", k).over(w), F.lag("load_mw", k).over(w)) for k in range(n_lags, 0, -1)]
    rows = blocks.select(
        key, *names, (F.col("_present") & F.col("_mine")).alias("_present"),
        F.array(F.lit(1.0), *lags, *[F.col(c) for c in COVARIATES]).alias("x"),
        F.col("load_mw").alias("y"),
    )
    ok = F.forall("x", lambda v: v.isNotNull()) & F.col("_present")
    return rows.where(ok).drop("_present")


def penalties(n_lags: int = C.SEQUENCE_LEN, penalty: float = 1e-4) -> list[float]:
    return [1e-8] + [penalty] * (n_lags + len(COVARIATES))


def _lagged(n_lags: int):
    """Design (1, lags from the oldest to the newest, temperature, calendar) and target of one block of a series, unscaled."""
    def build(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        hour = pdf["hour"].to_numpy(np.int64)
        first = int(hour.min())
        load, temp = np.full((2, int(hour.max()) - first + 1), np.nan)
        mine = np.zeros(len(load), bool)
        load[hour - first], temp[hour - first], mine[hour - first] = pdf["y"], pdf["temp"], pdf["mine"]
        if len(load) <= n_lags:
            return np.zeros((0, n_lags + 5)), np.zeros(0)
        windows = np.lib.stride_tricks.sliding_window_view(load, n_lags + 1)
        at = np.flatnonzero(np.isfinite(windows).all(axis=1) & np.isfinite(temp[n_lags:]) & mine[n_lags:])
        h = first + n_lags + at
        angle = 2 * np.pi * (h % 24) / 24
        day = (h // 24 + 3) % 7                                          # the epoch began on a Thursday
        x = np.column_stack([np.ones(len(at)), windows[at, :n_lags], temp[n_lags + at], np.sin(angle), np.cos(angle), day / 6.0])
        return x, windows[at, n_lags].astype(np.float64)

    return build


def lagged_sums(hours: DataFrame, border: DataFrame | None = None, n_lags: int = C.SEQUENCE_LEN, part: str | None = None) -> DataFrame:
    """``(series_id, part, i, v)``: the unscaled normal equations over the hours whose ``n_lags`` hours before are there.

    ``hours`` and ``border`` are (series_id, ds, load_mw, temp_c), the border
    only serves as earlier hours. A series is cut into blocks of ``BLOCK_H``
    hours that share their last hours with the next one; each block is one
    small group, so a series of any length is dealt over many tasks. With
    ``part``, a column of ``hours``, the sums are kept apart by its value.
    """
    rows = hours.select("series_id", "ds", "load_mw", "temp_c", *([part] if part else []), F.lit(True).alias("_new"))
    if border is not None:
        rows = rows.unionByName(border.withColumn("_new", F.lit(False)), allowMissingColumns=True)
    blocks = overlapping_blocks(rows.where(not_missing("load_mw")), n_lags, BLOCK_H, "ds")
    cut = blocks.select("series_id", "_block", epoch_hours("ds").alias("hour"), F.col("load_mw").alias("y"), F.col("temp_c").alias("temp"),
                        (F.col("_new") & F.col("_mine")).alias("mine"), *([part] if part else []))
    p = n_lags + 1 + len(COVARIATES)
    build, upper = _lagged(n_lags), np.triu_indices(p)

    def sums(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        values = [v for v in pdf[part].unique() if isinstance(v, str)] if part else [None]
        for value in values:
            x, y = build(pdf if value is None else pdf.assign(mine=pdf["mine"] & (pdf[part] == value)))
            if len(x):
                entries = np.r_[(x.T @ x)[upper], x.T @ y, y @ y, len(y)]
                out.append({"series_id": pdf["series_id"].iloc[0], "part": value, "entries": entries.tolist()})
        return pd.DataFrame(out, columns=["series_id", "part", "entries"])

    schema = T.StructType([rows.schema["series_id"], T.StructField("part", T.StringType()), T.StructField("entries", T.ArrayType(T.DoubleType()))])
    found = cut.groupBy("series_id", "_block").applyInPandas(sums, schema)
    return found.select("series_id", "part", F.posexplode("entries").alias("i", "v"))


def feature_bounds(hours: DataFrame) -> DataFrame:
    """``(series_id, low, high, last_ds, t0, t1)``: ends of the features and of time over hours (series_id, ds, load_mw, temp_c)."""
    values = {"load_mw": F.col("load_mw"), "temp_c": F.col("temp_c"), **calendar_columns("ds")}
    return hours.groupBy("series_id").agg(
        F.array(*[F.min(c) for c in values.values()]).alias("low"), F.array(*[F.max(c) for c in values.values()]).alias("high"),
        F.max("ds").alias("last_ds"), F.min(epoch_days("ds")).alias("t0"), F.max(epoch_days("ds")).alias("t1"))


def _scaled_solver(penalty):
    """Ridge on features scaled to [0, 1], from the sums of the unscaled ones and the features' ends."""
    pen = np.asarray(penalty)
    n_lags = len(pen) - len(FEATURES)

    def solve(sums: Sums, row) -> tuple[np.ndarray, float, float]:
        low = np.array([row[f"{c}_min"] for c in FEATURES])
        span = np.array([row[f"{c}_max"] for c in FEATURES]) - low
        which = np.r_[np.zeros(n_lags, int), np.arange(1, len(FEATURES))]        # the feature of each column after the first
        factor = np.where(span[which] > 0, 1 / np.where(span[which] > 0, span[which], 1.0), 0.0)
        a = np.diag(np.r_[1.0, factor])
        a[1:, 0] = -low[which] * factor
        scale = 1 / span[0] if span[0] > 0 else 0.0                              # a constant load is 0 throughout
        sums = sums.scaled(a, scale, -low[0] * scale)
        b = sums.ridge(pen)
        return b, sums.sigma(b), 0.0

    return solve


def solve_autoregressive(entries: DataFrame, bounds: DataFrame, n_lags: int = C.SEQUENCE_LEN, penalty: float = 1e-4, fitted_at=None) -> DataFrame:
    """The model table from unscaled ``(series_id, i, v)`` and ``(series_id, last_ds, low, high)`` of the features."""
    pen = penalties(n_lags, penalty)
    ends = [(f"{name}_{end}", F.get(c, F.lit(k))) for c, end in (("low", "min"), ("high", "max")) for k, name in enumerate(FEATURES)]
    scalers = bounds.select("series_id", "last_ds", *[c.alias(n) for n, c in ends])
    known = entries.select("series_id", "i", "v").join(scalers, "series_id")
    fit = solve_sums(known, ["series_id", "last_ds", *[n for n, _ in ends]], len(pen), _scaled_solver(pen))
    stamp = F.lit(fitted_at).cast("timestamp_ntz") if fitted_at is not None else utc_now()
    return model_table(fit.where(F.col("n") > 0), "series_id", n_lags, stamp)    # a series needs one hour with lags at least


def fit_autoregressive(history: DataFrame, weather: DataFrame | None = None, value: str = "load_mw",
                       key: str = "series_id", ts: str = "ds", n_lags: int = C.SEQUENCE_LEN, train_until=None,
                       penalty: float = 1e-4, fitted_at=None) -> DataFrame:
    """Fit per series; the model table carries coefficients, sigma and the scaler bounds.

    ``train_until``: only rows before it are used (for the bounds too).
    """
    hist = history.select(F.col(key).alias("series_id"), F.col(ts).alias("ds"), F.col(value).alias("load_mw")).where(not_missing("load_mw"))
    if train_until is not None:
        hist = hist.where(F.col("ds") < F.lit(train_until).cast("timestamp_ntz"))
    named = weather.withColumnsRenamed({key: "series_id", ts: "ds"}) if weather is not None else None
    hours = with_temperature(hist, named)
    model = solve_autoregressive(lagged_sums(hours, None, n_lags), feature_bounds(hours), n_lags, penalty, fitted_at)
    return model.withColumnRenamed("series_id", key)


def model_table(fit: DataFrame, key: str, n_lags: int, stamp: Column) -> DataFrame:
    """The model's columns from a fit that carries the features' bounds."""
    return fit.select(
        key, F.lit("autoregressive").alias("model"), stamp.alias("fitted_at"), "last_ds",
        F.lit(n_lags).alias("n_lags"), "coef", "sigma", "n",
        F.array(*[F.col(f"{c}_min") for c in FEATURES]).alias("feature_min"),
        F.array(*[F.col(f"{c}_max") for c in FEATURES]).alias("feature_max"),
    )


FOLD_BLOCK = 168   # steps folded at once; only the lag window passes from block to block


def recursive_fold(seed: Column, coef: Column, steps: Column, cov_fields=(), intercept: bool = True,
                   to_output=None, to_window=None) -> Column:
    """Fold a linear autoregression over ``steps`` (an array of covariate structs of any length).

    Long horizons are folded block by block, so that the outputs gathered so
    far are copied once a block and not once a step.

    The state is the lag window (oldest first) and the outputs. Each step:
    ``y = coef . ([1] ++ window ++ covariates)``; ``to_output(y)`` is emitted
    and ``to_window(output)`` is pushed into the window. ``y`` is bound once
    (``transform(array(y), ...)[0]``) so the dot product is evaluated once.
    """
    to_output = to_output or (lambda y: y)
    to_window = to_window or (lambda o: o)

    def step(acc, c):
        parts = ([F.array(F.lit(1.0))] if intercept else []) + [acc["w"]]
        if cov_fields:
            parts.append(F.array(*[c[f] for f in cov_fields]))
        y = dot(F.concat(*parts), coef)

        def advance(yv):
            o = to_output(yv)
            return F.struct(
                F.concat(F.slice(acc["w"], 2, F.size(acc["w"]) - 1), F.array(to_window(o))).alias("w"),
                F.concat(acc["out"], F.array(o)).alias("out"),
            )
        return F.transform(F.array(y), advance)[0]

    def block(acc, part):
        start = F.struct(acc["w"].alias("w"), F.array().cast("array<double>").alias("out"))
        folded = F.aggregate(part, start, step)
        return F.transform(F.array(folded), lambda r: F.struct(r["w"].alias("w"), F.concat(acc["out"], F.array(r["out"])).alias("out")))[0]

    blocks = F.transform(F.filter(F.sequence(F.lit(0), F.size(steps)), lambda i: (i % FOLD_BLOCK == 0) & (i < F.size(steps))),
                         lambda i: F.slice(steps, i + 1, FOLD_BLOCK))
    init = F.struct(seed.alias("w"), F.array().cast("array<array<double>>").alias("out"))
    return F.aggregate(blocks, init, block, lambda acc: F.flatten(acc["out"]))


def fold_forecast(mo: DataFrame, seed_rows: DataFrame, hours, weather: DataFrame | None, keys: list[str],
                   ts: str) -> DataFrame:
    """Recursive forecasts for each origin row of ``mo``.

    ``mo``: ``keys..., _origin, n_lags, coef, feature_min, feature_max`` (one row per forecast origin);
    ``hours`` is a number, or the name of a column of ``mo`` with each origin's own horizon.
    ``seed_rows``: ``keys..., ds, _v`` - history hours inside each origin's seed window (``n_lags``
    hours up to the origin). A missing seed hour takes the previous hour's value (leading gaps the
    first value present); an origin with no value in its window is skipped.
    Returns ``keys..., step, ds, _p`` (unrounded MW).
    """
    lo0, hi0 = F.col("feature_min")[0], F.col("feature_max")[0]
    span0 = F.nullif(hi0 - lo0, F.lit(0.0))
    seed = seed_rows.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(ts, "_v"))).alias("_sm"))
    last = F.col(hours) if isinstance(hours, str) else F.lit(int(hours))
    grid = mo.where(last >= 1).select(*keys, F.posexplode(F.sequence(add_hours("_origin", 1), add_hours("_origin", last),
                                                                     F.expr("INTERVAL 1 HOUR"))).alias("_i", ts))
    cov = _features(grid, weather, ts).join(mo.select(*keys, "feature_min", "feature_max"), keys, "inner")
    scaled_cov = cov.select(*keys, "_i", ts, F.struct(*[
        F.coalesce(F.try_divide(F.col(c) - F.col("feature_min")[i + 1],
                                F.nullif(F.col("feature_max")[i + 1] - F.col("feature_min")[i + 1], F.lit(0.0))),
                   F.lit(0.0)).alias(c)
        for i, c in enumerate(COVARIATES)]).alias("_c"))
    steps = scaled_cov.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_i", ts, "_c"))).alias("_steps"))
    j = mo.join(seed, keys, "inner").join(steps, keys, "inner")
    slots = F.transform(F.sequence(F.col("n_lags") - 1, F.lit(0), F.lit(-1)),
                        lambda k: F.element_at(F.col("_sm"), add_hours("_origin", -k)))
    first = F.filter(slots, lambda v: v.isNotNull())[0]
    filled = F.aggregate(
        slots, F.struct(first.alias("last"), F.array().cast("array<double>").alias("out")),
        lambda acc, v: F.struct(F.coalesce(v, acc["last"]).alias("last"),
                                F.concat(acc["out"], F.array(F.coalesce(v, acc["last"]))).alias("out")),
        lambda acc: acc["out"],
    )
    seed_scaled = F.transform(filled, lambda v: F.coalesce(F.try_divide(v - lo0, span0), F.lit(0.0)))

    def to_mw(y):
        return clip_forecast(y * (hi0 - lo0) + lo0)

    def to_scaled(o):
        return F.coalesce(F.try_divide(o - lo0, span0), F.lit(0.0))

    outs = recursive_fold(seed_scaled, F.col("coef"), F.transform("_steps", lambda s: s["_c"]), COVARIATES,
                          True, to_mw, to_scaled)
    res = j.select(*keys, F.arrays_zip(F.transform("_steps", lambda s: s[ts]).alias("ds"), outs.alias("p")).alias("_z"))
    return res.select(*keys, F.posexplode("_z").alias("_k", "_r")).select(
        *keys, (F.col("_k") + 1).cast("int").alias("step"), F.col("_r.ds").alias(ts), F.col("_r.p").alias("_p"))


def _d7(res: DataFrame, keys: list[str], ts: str, threshold: float, generated_at) -> DataFrame:
    stamp = F.lit(generated_at).cast("timestamp_ntz") if generated_at is not None else utc_now()
    lower, upper = proportional_band(F.col("_p"))
    return res.select(
        *keys, F.lit("autoregressive").alias("model"), stamp.alias("generated_at"), "step", ts,
        rnd("_p", 3).alias("predicted_mw"), rnd(lower, 3).alias("lower_mw"), rnd(upper, 3).alias("upper_mw"),
        alert_flag("_p", threshold).alias("alert"),
    )


def forecast_autoregressive(model: DataFrame, history: DataFrame, hours: int, weather: DataFrame | None = None,
                            threshold: float = C.THRESHOLD_MW, value: str = "load_mw", key: str = "series_id",
                            ts: str = "ds", generated_at=None) -> DataFrame:
    """Forecast ``hours`` steps after the model's last hour, feeding each prediction back."""
    if not 1 <= int(hours) <= C.MAX_HORIZON_H:
        raise ValueError("hours must be in 1..168")
    mo = model.withColumn("_hours", F.lit(int(hours)))
    return forecast_to_horizon(mo, history, "_hours", weather, threshold, value, key, ts, generated_at)


def forecast_to_horizon(model: DataFrame, history: DataFrame, hours: str, weather: DataFrame | None = None,
                        threshold: float = C.THRESHOLD_MW, value: str = "load_mw", key: str = "series_id",
                        ts: str = "ds", generated_at=None) -> DataFrame:
    """The same recursion over each series' own horizon: the column ``hours`` of the model table, of any size."""
    mo = model.select(key, F.col("last_ds").alias("_origin"), "n_lags", "coef", "feature_min", "feature_max", F.col(hours).cast("int").alias("_hours"))
    hist = score_with_model(history.select(key, ts, F.col(value).alias("_v")), mo.select(key, "_origin", "n_lags"), key)
    seed_rows = hist.where((F.col(ts) <= F.col("_origin")) & (F.col(ts) > add_hours("_origin", -F.col("n_lags")))
                           & F.col("_v").isNotNull()).select(key, ts, "_v")
    return _d7(fold_forecast(mo, seed_rows, "_hours", weather, [key], ts), [key], ts, threshold, generated_at)


def rolling_forecast_autoregressive(model: DataFrame, history: DataFrame, anchors: DataFrame, hours: int = 24,
                                    cadence_h: int = 24, weather: DataFrame | None = None,
                                    threshold: float = C.THRESHOLD_MW, value: str = "load_mw",
                                    key: str = "series_id", ts: str = "ds", generated_at=None) -> DataFrame:
    """Rolling-origin forecasts: a fresh recursion every ``cadence_h`` hours from actual history.

    ``anchors``: ``(key, anchor)`` - the first origin of each series; origins
    are ``anchor + k * cadence`` up to the series' last history hour. Each
    origin is seeded with the actual ``n_lags`` hours up to it. A history
    hour belongs to the seeds of at most ``ceil(n_lags / cadence) + 1``
    origins, found by arithmetic and matched by an equi-join on
    (series, origin index): no pairing of hours with origins.
    Output adds ``origin`` to the D7 columns.
    """
    if not 1 <= int(hours) <= C.MAX_HORIZON_H:
        raise ValueError("hours must be in 1..168")
    c = int(cadence_h)
    m = model.select(key, "n_lags", "coef", "feature_min", "feature_max")
    last = history.where(F.col(value).isNotNull()).groupBy(key).agg(F.max(ts).alias("_last"))
    anc = anchors.select(key, F.col("anchor").alias("_anchor")).join(last, key, "inner").join(m, key, "inner")
    n_orig = F.floor((epoch_hours("_last") - epoch_hours("_anchor")) / F.lit(float(c))).cast("int")
    mo = anc.select(key, "_anchor", "n_lags", "coef", "feature_min", "feature_max",
                    F.explode(F.sequence(F.lit(0), n_orig)).alias("_oi")) \
        .where(F.col("_oi") >= 0) \
        .withColumn("_origin", add_hours("_anchor", F.col("_oi") * c))
    hh = epoch_hours(ts) - epoch_hours("_anchor")
    k_lo = F.greatest(F.lit(0), F.floor((hh + F.lit(c - 1)) / F.lit(float(c))).cast("int"))
    k_hi = (F.floor((hh + F.col("n_lags") + F.lit(c - 1)) / F.lit(float(c))) - 1).cast("int")
    hist = history.where(F.col(value).isNotNull()).select(key, ts, F.col(value).alias("_v")).join(
        anc.select(key, "_anchor", "n_lags"), key, "inner")
    seed_rows = hist.where(k_hi >= k_lo).select(key, ts, "_v", F.explode(F.sequence(k_lo, k_hi)).alias("_oi"))
    res = fold_forecast(mo, seed_rows, hours, weather, [key, "_oi"], ts)
    res = res.join(mo.select(key, "_oi", F.col("_origin").alias("origin")), [key, "_oi"], "inner").drop("_oi")
    return _d7(res, [key, "origin"], ts, threshold, generated_at)


def forecast_fixed_ar(history: DataFrame, weights, hours: int, value: str = "load_mw", key: str = "series_id",
                      ts: str = "ds") -> DataFrame:
    """Recursive forecast with fixed lag weights (``weights[0]`` on lag 1), seeded by the last rows.

    The same fold as :func:`forecast_autoregressive` without intercept,
    covariates or scaling; a check of the recursion itself.
    """
    n = len(weights)
    coef = F.array(*[F.lit(float(w)) for w in reversed(weights)])   # window is oldest first
    w = Window.partitionBy(key).orderBy(F.col(ts).desc())
    last = history.select(key, ts, value).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n)
    seed = last.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(ts, value))).alias("_s"), F.max(ts).alias("_last"))
    steps = F.sequence(F.lit(1), F.lit(int(hours)))
    outs = recursive_fold(F.transform("_s", lambda r: r[value]), coef,
                          F.transform(steps, lambda i: F.struct(i.alias("i"))), (), False)
    return seed.where(F.size("_s") == n).select(key, "_last", F.posexplode(outs).alias("_k", "predicted")).select(
        key, (F.col("_k") + 1).cast("int").alias("step"), add_hours("_last", F.col("_k") + 1).alias(ts), "predicted")
