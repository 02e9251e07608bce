"""Registered queries: each takes ``(spark, sf_dir)`` and returns a DataFrame.

Every query reads the driver tables (through :mod:`gridcast.plans.views`)
and runs over whole tables. Float outputs that are compared with the SQL
oracle are rounded once, at the end, with :func:`gridcast.functions.rnd`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as C
from ..functions import (
    alert_flag,
    calendar_columns,
    clip_forecast,
    exact_mean,
    format_period,
    hour_floor,
    proportional_band,
    day_of,
    expected_load,
    fourier_columns,
    rnd,
    season_factor,
    temperature_proxy,
    weekday0,
    weekend_factor,
)
from ..operators import alerts as AL
from ..operators import aggregates as AG
from ..operators import align as J
from ..operators import grid as G
from ..operators import metrics as ME
from ..operators import prep as PR
from ..operators import windows as WI
from ..models import additive as ADD
from ..models import autoregressive as AR
from ..models import store as ST
from ..models.ridge import normal_residual
from ..sources import readers as RD
from ..session import materialize, shared_path
from ..streaming import jobs as STR
from . import evaluation as EV
from . import views as V

Query = Callable[[SparkSession, str], DataFrame]
AS_OF = "2024-01-15 12:30:00"      # reference time for "latest" and "fresh" queries
SEARCH_TEXT = "jan 1"              # dashboard search text used by forecast_table


# ----------------------------------------------------------------------------- ingest and grid
def q_hourly_load(spark, sf):
    return V.hourly_load(spark, sf)


def q_hourly_spine(spark, sf):
    return V.hourly_grid(spark, sf)


def q_missing_hours(spark, sf):
    return G.missing_hours(V.hourly_load(spark, sf))


def q_load_mw(spark, sf):
    return V.load_mw(spark, sf).select("series_id", "ds", "load", "load_mw")


# ----------------------------------------------------------------------------- alerts and schedule
def _daily_peaks(spark, sf, threshold):
    lm = V.load_mw(spark, sf)
    hot = AL.breaches(lm, threshold, value="load_mw").withColumn("day", day_of("ds"))
    return AL.forecast_peak(hot, ["series_id", "day"], value="load_mw")


def q_daily_peaks(spark, sf):
    return _daily_peaks(spark, sf, C.THRESHOLD_MW)


def _schedule(spark, sf, threshold, zones_from_table=True):
    zones = V.zones_from_region(spark, sf) if zones_from_table else None
    return AL.shed_schedule(_daily_peaks(spark, sf, threshold), threshold, zones, keys=["series_id", "day"])


def q_shed_schedule_t20(spark, sf):
    return _schedule(spark, sf, 20.0)


def q_shed_schedule_t13(spark, sf):
    return _schedule(spark, sf, 13.0)


def q_alert_status_daily(spark, sf):
    lm = V.load_mw(spark, sf).withColumn("day", day_of("ds"))
    counts = AL.alert_hours(lm, C.THRESHOLD_MW, ["series_id", "day"], value="load_mw")
    return AL.status_line(counts, C.THRESHOLD_MW)


def q_alert_messages_t13(spark, sf):
    return AL.alert_messages(_schedule(spark, sf, 13.0), ["series_id", "day"])


def q_schedule_lines_t13(spark, sf):
    return AL.schedule_lines(_schedule(spark, sf, 13.0), ["series_id", "day"])


# ----------------------------------------------------------------------------- summaries
def _lm(spark, sf):
    return V.load_mw(spark, sf)


def q_load_summary(spark, sf):
    return AG.load_summary(_lm(spark, sf))


def q_describe_load(spark, sf):
    d = AG.describe_load(_lm(spark, sf))
    return d.select("series_id", "count", *[rnd(c, 6).alias(c) for c in ("mean", "std", "min", "p25", "p50", "p75", "max")])


def q_load_quantiles(spark, sf):
    q = AG.quantiles(_lm(spark, sf), (0.01, 0.05, 0.5, 0.95, 0.99))
    return q.select("series_id", "p", rnd("value", 6).alias("value"))


def q_peak_history(spark, sf):
    return AG.peak_row_history(_lm(spark, sf))


# ----------------------------------------------------------------------------- features
def q_calendar_features(spark, sf):
    lm = _lm(spark, sf)
    cols = calendar_columns("ds")
    return lm.select("series_id", "ds", "load_mw", *[rnd(c, 6).alias(n) for n, c in cols.items()])


def q_fourier_features(spark, sf):
    lm = _lm(spark, sf)
    return lm.select("series_id", "ds", *[rnd(c, 6).alias(n) for n, c in fourier_columns("ds").items()])


def q_expected_profile(spark, sf):
    grid = G.hourly_spine(V.hourly_load(spark, sf)).select("series_id", "ds")
    return grid.select(
        "series_id", "ds",
        season_factor("ds").alias("season_factor"),
        weekend_factor("ds").alias("weekend_factor"),
        rnd(expected_load("ds"), 6).alias("expected_mw"),
        temperature_proxy("ds").alias("temp_proxy"),
    )


# ----------------------------------------------------------------------------- windows
def q_lag_features(spark, sf):
    return WI.lag_features(V.hourly_grid(spark, sf), "load", range(1, 25))


def q_sequence_windows(spark, sf):
    seq = WI.make_sequences(V.hourly_grid(spark, sf), ["load"], 24, target="load")
    return seq.select(
        "series_id", "ds", "y", F.size("x").alias("n"),
        F.col("x")[0]["load"].alias("x_first"), F.col("x")[23]["load"].alias("x_last"),
        rnd(F.aggregate("x", F.lit(0.0), lambda a, r: a + r["load"]), 6).alias("x_sum"),
    )


def q_last_window(spark, sf):
    return G.last_window(_lm(spark, sf).select("series_id", "ds", "load_mw"), 24)


def q_holdout_split(spark, sf):
    return WI.holdout_split(_lm(spark, sf).select("series_id", "ds", "load_mw"))


def q_evaluation_parts(spark, sf):
    return EV.split_parts(_lm(spark, sf).select("series_id", "ds", "load_mw"))


def q_latest_reading(spark, sf):
    return G.latest_reading(_lm(spark, sf).select("series_id", "ds", "load", "load_mw"), AS_OF)


def q_future_grid(spark, sf):
    return G.future_grid(_lm(spark, sf), 24)


def q_seasonal_profile(spark, sf):
    p = AG.seasonal_profile(_lm(spark, sf))
    return p.select("series_id", "hour", "weekday", rnd("mean_mw", 6).alias("mean_mw"), "n")


def q_fourier_coefficients(spark, sf):
    c = AG.fourier_coefficients(_lm(spark, sf), 3, 1.0)
    return c.select("series_id", "k", rnd("a_cos", 6).alias("a_cos"), rnd("b_sin", 6).alias("b_sin"))


def q_linear_trend(spark, sf):
    t = AG.linear_trend(_lm(spark, sf))
    return t.select("series_id", rnd("slope_per_day", 6).alias("slope_per_day"), rnd("intercept", 6).alias("intercept"), "n")


# ----------------------------------------------------------------------------- joins
def q_attach_weather(spark, sf):
    j = J.attach_weather(_lm(spark, sf).select("series_id", "ds", "load_mw"), V.covariate(spark, sf))
    return j.select("series_id", "ds", "load_mw", rnd("temp_c", 6).alias("temp_c"))


def q_attach_weather_asof(spark, sf):
    grid = V.hourly_grid(spark, sf).select("series_id", "ds")
    j = J.attach_weather_asof(grid, V.covariate(spark, sf), tolerance_h=3)
    return j.select("series_id", "ds", rnd("temp_c", 6).alias("temp_c"), "temp_c_at")


# ----------------------------------------------------------------------------- evaluation
def _preds(spark, sf):
    return EV.model_predictions(_lm(spark, sf).select("series_id", "ds", "load_mw"))


def q_model_predictions(spark, sf):
    return _preds(spark, sf).select("series_id", "ds", "part", rnd("actual", 6).alias("actual"), "model",
                                    rnd("predicted", 6).alias("predicted"))


def q_ensemble_weights(spark, sf):
    w = EV.ensemble_weights(_lm(spark, sf))
    return w.select("series_id", "model", rnd("weight", 6).alias("weight"))


def _metrics(spark, sf):
    return EV.evaluate(_lm(spark, sf))


def q_evaluation_metrics(spark, sf):
    m = _metrics(spark, sf)
    return m.select("series_id", "model", *[rnd(c, 6).alias(c) for c in ("mae", "rmse", "mape")], "n")


def q_best_per_metric(spark, sf):
    b = ME.best_per_metric(_metrics(spark, sf))
    return b.select("series_id", "model", "best_mae", "best_rmse", "best_mape")


def q_leaderboard(spark, sf):
    return ME.leaderboard(_metrics(spark, sf))


def q_recommendation(spark, sf):
    return ME.recommendation_text(ME.leaderboard(_metrics(spark, sf)))


def q_report_winner(spark, sf):
    m = _metrics(spark, sf)
    order = F.when(F.col("model") == "seasonal_naive", 1).when(F.col("model") == "profile", 2).otherwise(3)
    return ME.report_winner(m.withColumn("ordinal", order))


# ----------------------------------------------------------------------------- forecasts and models
def _profile_forecast(spark, sf, hours=24, threshold=C.THRESHOLD_MW):
    """Mean-by-(hour, weekday) forecaster over the whole history, on the future grid."""
    lm = _lm(spark, sf)
    prof = lm.groupBy("series_id", F.hour("ds").alias("hour"), weekday0("ds").alias("weekday")).agg(
        exact_mean("load_mw").alias("yhat"))
    grid = G.future_grid(lm, hours).withColumns({"hour": F.hour("ds"), "weekday": weekday0("ds")})
    fc = grid.join(prof, ["series_id", "hour", "weekday"], "left")
    p = clip_forecast(F.col("yhat"))
    lower, upper = proportional_band(p)
    return fc.select("series_id", "step", "ds", rnd(p, 3).alias("predicted_mw"), rnd(lower, 3).alias("lower_mw"),
                     rnd(upper, 3).alias("upper_mw"), alert_flag(p, threshold).alias("alert"))


def q_forecast_band(spark, sf):
    return _profile_forecast(spark, sf)


def q_forecast_table(spark, sf):
    t = AL.forecast_table(_profile_forecast(spark, sf), C.THRESHOLD_MW, only_alerts=False, sort_key="predicted_mw",
                          ascending=False, search=SEARCH_TEXT)
    return t.select("series_id", "ds", "time_label", "predicted_mw", "status")


def q_forecast_alert_rows(spark, sf):
    t = AL.forecast_table(_profile_forecast(spark, sf, threshold=15.0), 15.0, only_alerts=True)
    return t.select("series_id", "ds", "time_label", "predicted_mw", "status")


def q_recursive_ar3(spark, sf):
    fc = AR.forecast_fixed_ar(_lm(spark, sf), (0.5, 0.3, 0.2), 24)
    return fc.select("series_id", "step", "ds", rnd("predicted", 6).alias("predicted"))


def q_additive_fit(spark, sf):
    m = ADD.fit_additive(_lm(spark, sf))
    return m.select("series_id", "model", "n", F.size("coef").alias("n_coef"), rnd("sigma", 6).alias("sigma"))


def q_additive_residual(spark, sf):
    """M1 by its definition: the fit solves the normal equations of every load series (residual 0, over all its rows)."""
    lm = _lm(spark, sf)
    r = normal_residual(ADD.design_rows(lm), materialize(ADD.fit_additive(lm, prior="gaussian")), ADD.penalties())
    return r.select("series_id", rnd("residual", 6).alias("residual"), "n")


def q_ar_residual(spark, sf):
    """M3 by its definition: the same for the autoregression, over all hours with 24 hours before them."""
    lm, cov = _lm(spark, sf), V.covariate(spark, sf)
    r = normal_residual(AR.training_rows(lm, cov), materialize(AR.fit_autoregressive(lm, cov)), AR.penalties())
    return r.select("series_id", rnd("residual", 6).alias("residual"), "n")


def q_additive_forecast(spark, sf):
    fc = ADD.forecast_additive(ADD.fit_additive(_lm(spark, sf)), 24)
    return fc.drop("generated_at")


def q_additive_daily_forecast(spark, sf):
    """The daily order history in its own units: scaled for the fit, stepped by the day, not clipped, no alerts."""
    model = ADD.fit_additive(V.daily_load(spark, sf), value="load", rescale=True)
    return ADD.forecast_additive(model, 24, threshold=None, step="1 DAY", bounds=None).drop("generated_at")


def q_additive_fixed_daily(spark, sf):
    """M2 with fixed coefficients: 30 days after each daily order history, value and alert flag at twice its mean."""
    daily = V.daily_load(spark, sf)
    day = F.datediff(F.col("ds"), F.lit("1970-01-01")).cast("double")
    model = daily.groupBy("series_id").agg(
        F.min(day).alias("t0"), F.max(day).alias("t1"), F.max("ds").alias("last_ds"), (exact_mean("load") / F.lit(10.0)).alias("y_scale"),
        F.lit(0.5).alias("sigma"), F.array(*[F.lit(c) for c in C.CHECK_COEFFICIENTS]).alias("coef"))
    fc = ADD.forecast_additive(model, 30, threshold=None, step="1 DAY", bounds=None)
    return fc.select("series_id", "step", "ds", rnd("predicted_mw", 1).alias("predicted"),
                     rnd(F.col("upper_mw") - F.col("lower_mw"), 1).alias("width"), "alert")


def q_ar_fit(spark, sf):
    m = AR.fit_autoregressive(_lm(spark, sf), V.covariate(spark, sf))
    return m.select("series_id", "model", "n", F.size("coef").alias("n_coef"), rnd("sigma", 6).alias("sigma"))


def q_ar_forecast(spark, sf):
    lm = _lm(spark, sf)
    cov = V.covariate(spark, sf)
    model = materialize(AR.fit_autoregressive(lm, cov))   # the model table, computed once
    return AR.forecast_autoregressive(model, lm, 24, cov).drop("generated_at")


def q_model_fallback(spark, sf):
    lm = _lm(spark, sf)
    cov = V.covariate(spark, sf)
    pref = AR.forecast_autoregressive(materialize(AR.fit_autoregressive(lm, cov)), lm, 24, cov)
    fb = ADD.forecast_additive(ADD.fit_additive(lm), 24)
    return ST.fallback_model(pref, fb).select("series_id", "model", "step", "ds")


# ----------------------------------------------------------------------------- scaling, parsing, paging
def q_minmax_scaled(spark, sf):
    j = J.attach_weather(_lm(spark, sf).select("series_id", "ds", "load_mw"), V.covariate(spark, sf))
    bounds = PR.minmax_bounds(j, ["load_mw", "temp_c"])
    sc = PR.minmax_scale(j, ["load_mw", "temp_c"], bounds)
    back = PR.minmax_inverse(sc, "load_mw_scaled", bounds, "load_mw", out="load_mw_back")
    return back.select("series_id", "ds", rnd("load_mw_scaled", 6).alias("load_mw_scaled"),
                       rnd("temp_c_scaled", 6).alias("temp_c_scaled"), rnd("load_mw_back", 6).alias("load_mw_back"))


def q_demand_from_text(spark, sf):
    """Readings as landed text rows (respondent, type, period, value) through the parse path, then hourly sums."""
    ev = V.events(spark, sf)
    raw = ev.select(F.col("event_type").alias("respondent"), F.lit("D").alias("type"),
                    format_period(hour_floor("ts")).alias("period"), F.col("value").cast("string").alias("value"))
    clean = RD.clean_demand(raw, kind="D")
    return clean.groupBy("series_id", F.col("period").alias("ds")).agg(
        F.sum(F.col("value_mw").cast("decimal(18,2)")).cast("double").alias("load"))


def q_combine_pages(spark, sf):
    """Two overlapping pages of hourly demand (time ranges pushed to the scan), appended; newest page wins."""
    a = V.hourly_load(spark, sf, end="2024-01-20").withColumnRenamed("ds", "period").withColumn("page", F.lit(1))
    b = V.hourly_load(spark, sf, start="2024-01-15").withColumnRenamed("ds", "period").withColumn("page", F.lit(2))
    return G.combine_pages(a, b, key=("series_id", "period"), order="page")


def _alert_log(spark, sf):
    pk = _daily_peaks(spark, sf, C.THRESHOLD_MW)
    return pk.select("series_id", F.col("peak_ds").alias("timestamp"), "peak_mw", F.lit("history").alias("model"))


def q_recent_alerts(spark, sf):
    return AL.recent_alerts(_alert_log(spark, sf), 20, order=("timestamp", "series_id"))


def q_head_sample(spark, sf):
    return G.head(_lm(spark, sf).select("series_id", "ds", "load_mw"), 5, order=("ds", "series_id"))


def q_page_rows(spark, sf):
    return G.page(_lm(spark, sf).select("series_id", "ds", "load_mw"), 100, 50, order=("series_id", "ds"))


def q_alert_dedupe(spark, sf):
    ev = V.events(spark, sf).select(F.col("event_type").alias("series_id"), F.col("ts").alias("timestamp"))
    return AL.dedupe_alerts(ev, C.ALERT_COOLDOWN_S, ("series_id",), "timestamp")


def q_freshness(spark, sf):
    return AL.freshness(V.hourly_load(spark, sf), "2024-01-31 00:02:00", 300)


def q_fresh_forecast(spark, sf):
    fc = _profile_forecast(spark, sf)
    run1 = fc.withColumn("generated_at", F.lit("2024-01-31 00:00:00").cast("timestamp_ntz"))
    run2 = fc.withColumn("generated_at", F.lit("2024-01-31 00:02:00").cast("timestamp_ntz"))
    runs = G.combine_models(run1, run2).withColumn("model", F.lit("profile")).withColumn("hours", F.lit(24))
    return ST.fresh_forecast(runs, "2024-01-31 00:04:00", 300).select("series_id", "model", "hours", "generated_at",
                                                                      "step", "ds", "predicted_mw")


# ----------------------------------------------------------------------------- payload, alignment, streams
def q_alert_payload(spark, sf):
    """Alert event per series from the 24 h forecast at threshold 13 (peak, window, schedule), its nested parts as columns."""
    fc = _profile_forecast(spark, sf, threshold=13.0).withColumn("model", F.lit("profile"))
    peaks = AL.forecast_peak(AL.breaches(fc, 13.0), ["series_id"], carry=("model",))
    sched = AL.shed_schedule(peaks, 13.0, keys=["series_id"])
    event = AL.alert_payload(fc, sched, 13.0, triggered_at="2024-01-31 00:00:00")
    window, shed = F.col("forecast_window"), F.col("shed_schedule")
    return event.select(
        "series_id", "event", "district", "triggered_at", "threshold_mw", F.col("peak.timestamp").alias("peak_ds"),
        F.col("peak.predicted_mw").alias("peak_mw"), F.col("peak.model").alias("peak_model"), F.size(window).cast("bigint").alias("hours"),
        window[0]["ds"].alias("first_ds"), F.element_at(window, -1)["ds"].alias("last_ds"),
        F.size(F.filter(window, lambda r: r["alert"])).cast("bigint").alias("alert_hours"),
        F.array_join(F.transform(shed, lambda z: F.concat_ws("|", z["priority"].cast("string"), z["zone"], z["start"], z["end"])), ";").alias("zones"),
        rnd(F.aggregate(shed, F.lit(0.0), lambda a, z: a + z["load_mw"]), 2).alias("shed_mw"))


def q_align_models(spark, sf):
    band = _profile_forecast(spark, sf).select("series_id", "ds", F.col("predicted_mw").alias("predicted"))
    ar3 = AR.forecast_fixed_ar(_lm(spark, sf), (0.5, 0.3, 0.2), 24)
    j = J.align_models(band, ar3, names=("profile", "ar3"))
    return j.select("series_id", "ds", "profile_predicted", rnd("ar3_predicted", 6).alias("ar3_predicted"))


def _events_stream(spark, sf):
    schema = "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"
    src = STR.read_table_stream(spark, sf.rstrip("/") + "/events.parquet", schema)
    return src.select(F.col("event_type").alias("series_id"), F.col("ts").cast("timestamp").alias("ts"), "value")


def _run_stream(df, name):
    """Run a streaming plan to completion (availableNow) into a Parquet sink in the shared folder."""
    import uuid

    base = shared_path(df.sparkSession, f"streams/{name}-{uuid.uuid4().hex}")
    q = (df.writeStream.format("parquet").option("path", base + "/out")
         .option("checkpointLocation", base + "/checkpoint").outputMode("append")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return df.sparkSession.read.parquet(base + "/out")


def q_stream_hourly_load(spark, sf):
    """R1 over the events table as a stream: closed hours only (the watermark keeps the newest hour open)."""
    out = _run_stream(STR.stream_hourly_load(_events_stream(spark, sf), "1 hour"), "hourly")
    return out.select("series_id", F.col("ds").cast("timestamp_ntz").alias("ds"), "load")


def q_stream_alert_cooldown(spark, sf):
    """R3 stateful cooldown over the events table as a stream of alert requests."""
    alerts = _events_stream(spark, sf).select("series_id", F.col("ts").alias("ds"), F.col("value").alias("load_mw"))
    out = _run_stream(STR.stream_dedupe_alerts(alerts, C.ALERT_COOLDOWN_S, "1 hour"), "cooldown")
    return out.select("series_id", F.col("ds").cast("timestamp_ntz").alias("ds"), "load_mw")


def q_model_evaluation(spark, sf):
    m = EV.evaluate_models(_lm(spark, sf).select("series_id", "ds", "load_mw"), V.covariate(spark, sf))
    return m.select("series_id", "model", *[rnd(c, 6).alias(c) for c in ("mae", "rmse", "mape")], "n")


def q_model_leaderboard(spark, sf):
    return ME.leaderboard(EV.evaluate_models(_lm(spark, sf).select("series_id", "ds", "load_mw"), V.covariate(spark, sf)))


def q_stream_threshold_alerts(spark, sf):
    """R2: stream hours rescaled with per-series bounds of the batch history; breaches at 20 MW."""
    bounds = materialize(STR.rescale_bounds(V.hourly_load(spark, sf)))     # not computed again by each micro-batch
    hourly = STR.stream_hourly_load(_events_stream(spark, sf), "1 hour")
    out = _run_stream(STR.stream_threshold_alerts(hourly, bounds, C.THRESHOLD_MW), "alerts")
    return out.select("series_id", F.col("ds").cast("timestamp_ntz").alias("ds"), "load", "load_mw")


def q_stream_forecast_job(spark, sf):
    """The hourly job on the events stream: additive model table -> foreachBatch forecast, peak,
    schedule -> alert log (threshold 13 MW so that alerts occur)."""
    import uuid

    base = shared_path(spark, f"jobs/forecast-{uuid.uuid4().hex}")
    ST.write_model(ADD.fit_additive(_lm(spark, sf)), base + "/models")
    readings = _events_stream(spark, sf).select("series_id", "ts", "value")
    q = STR.run_forecast_job(readings, base + "/checkpoint", base + "/load", base + "/models", base + "/alerts",
                             hours=24, threshold=13.0, delay="1 hour")
    q.awaitTermination()
    log = spark.read.parquet(base + "/alerts")
    return log.select("series_id", "peak_mw", "model", F.size("schedule").alias("zones"), "batch_id")


def q_forecast_status(spark, sf):
    """Dashboard summary of the 24 h forecast per series: alert hours, peak and status line (threshold 17)."""
    counts = AL.alert_hours(_profile_forecast(spark, sf, threshold=17.0), 17.0, ["series_id"])
    return AL.status_line(counts, 17.0)


QUERIES: dict[str, Query] = {
    "hourly_load": q_hourly_load,
    "hourly_spine": q_hourly_spine,
    "missing_hours": q_missing_hours,
    "load_mw": q_load_mw,
    "daily_peaks": q_daily_peaks,
    "shed_schedule_t20": q_shed_schedule_t20,
    "shed_schedule_t13": q_shed_schedule_t13,
    "alert_status_daily": q_alert_status_daily,
    "alert_messages_t13": q_alert_messages_t13,
    "schedule_lines_t13": q_schedule_lines_t13,
    "load_summary": q_load_summary,
    "describe_load": q_describe_load,
    "load_quantiles": q_load_quantiles,
    "peak_history": q_peak_history,
    "calendar_features": q_calendar_features,
    "fourier_features": q_fourier_features,
    "expected_profile": q_expected_profile,
    "lag_features": q_lag_features,
    "sequence_windows": q_sequence_windows,
    "last_window": q_last_window,
    "holdout_split": q_holdout_split,
    "evaluation_parts": q_evaluation_parts,
    "latest_reading": q_latest_reading,
    "future_grid": q_future_grid,
    "seasonal_profile": q_seasonal_profile,
    "fourier_coefficients": q_fourier_coefficients,
    "linear_trend": q_linear_trend,
    "attach_weather": q_attach_weather,
    "attach_weather_asof": q_attach_weather_asof,
    "model_predictions": q_model_predictions,
    "ensemble_weights": q_ensemble_weights,
    "evaluation_metrics": q_evaluation_metrics,
    "best_per_metric": q_best_per_metric,
    "leaderboard": q_leaderboard,
    "recommendation": q_recommendation,
    "report_winner": q_report_winner,
    "forecast_band": q_forecast_band,
    "forecast_table": q_forecast_table,
    "forecast_alert_rows": q_forecast_alert_rows,
    "recursive_ar3": q_recursive_ar3,
    "additive_fit": q_additive_fit,
    "additive_residual": q_additive_residual,
    "ar_residual": q_ar_residual,
    "additive_forecast": q_additive_forecast,
    "additive_daily_forecast": q_additive_daily_forecast,
    "additive_fixed_daily": q_additive_fixed_daily,
    "ar_fit": q_ar_fit,
    "ar_forecast": q_ar_forecast,
    "model_fallback": q_model_fallback,
    "minmax_scaled": q_minmax_scaled,
    "demand_from_text": q_demand_from_text,
    "combine_pages": q_combine_pages,
    "recent_alerts": q_recent_alerts,
    "head_sample": q_head_sample,
    "page_rows": q_page_rows,
    "alert_dedupe": q_alert_dedupe,
    "freshness": q_freshness,
    "fresh_forecast": q_fresh_forecast,
    "alert_payload": q_alert_payload,
    "align_models": q_align_models,
    "stream_hourly_load": q_stream_hourly_load,
    "stream_alert_cooldown": q_stream_alert_cooldown,
    "model_evaluation": q_model_evaluation,
    "model_leaderboard": q_model_leaderboard,
    "stream_threshold_alerts": q_stream_threshold_alerts,
    "stream_forecast_job": q_stream_forecast_job,
    "forecast_status": q_forecast_status,
}
