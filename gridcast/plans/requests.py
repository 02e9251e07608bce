"""The reference's request flows as Spark jobs.

* E1 :func:`forecast_request` - newest fitted model per series -> ``hours``
  forecast rows (D7), with the other model as fallback for series the
  requested one has no fit for.
* :func:`alert_events` - breaches -> peak per series -> shedding schedule ->
  payload and alert-log rows (D10-D12).
* E2 :func:`ingest_and_train` - readings -> hourly demand -> rescale -> load
  table (by month) -> both models -> model table.
* E3 :func:`run_evaluation` - hold-out evaluation of both models,
  leaderboard, results CSV (metrics only).

Every step is a DataFrame job; tables live under paths the caller gives
(a shared file system on a cluster).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as C
from ..models import additive as ADD
from ..models import autoregressive as AR
from ..models import store as ST
from ..operators import alerts as AL
from ..operators import metrics as ME
from ..functions import temperature_proxy, utc_now
from ..operators.align import attach_weather
from ..operators.prep import rescale_minmax
from ..sources import readers as RD
from . import evaluation as EV

MODEL_ALIASES = {"prophet": "additive", "lstm": "autoregressive"}


def forecast_request(spark: SparkSession, model_path: str, history: DataFrame, model: str = "additive",
                     hours: int = 24, threshold: float = C.THRESHOLD_MW, weather: DataFrame | None = None,
                     value: str = "load_mw") -> DataFrame:
    """D7 forecast rows for every series with a fitted model.

    ``model`` takes the internal names or the two API names (``prophet`` ->
    additive, ``lstm`` -> autoregressive). Series without a fit of the
    requested model get the other model's forecast (M6).
    """
    ST.valid_request(hours, model)
    name = MODEL_ALIASES.get(model, model)
    add = ADD.forecast_additive(ST.read_model(spark, model_path, "additive"), hours, threshold)
    if name == "additive":
        return add
    ar = AR.forecast_autoregressive(ST.read_model(spark, model_path, "autoregressive"), history, hours, weather,
                                    threshold, value=value)
    return ST.fallback_model(ar, add)


def forecast_envelope(forecast: DataFrame, hours: int, threshold: float = C.THRESHOLD_MW, district: str = C.DISTRICT) -> DataFrame:
    """One answer per series (D8): district, model, horizon, threshold, time and the forecast rows (168 at most) in order."""
    row = F.struct(F.col("ds").alias("timestamp"), "predicted_mw", "lower_mw", "upper_mw", "alert")
    return forecast.groupBy("series_id", "model").agg(
        F.max("generated_at").alias("generated_at"), F.array_sort(F.collect_list(row)).alias("forecast")
    ).select("series_id", F.lit(district).alias("district"), "model", F.lit(int(hours)).alias("hours"),
             F.lit(float(threshold)).alias("threshold_mw"), "generated_at", "forecast")


def alert_events(forecast: DataFrame, threshold: float = C.THRESHOLD_MW, zones: DataFrame | None = None,
                 triggered_at=None) -> dict[str, DataFrame]:
    """Peaks, schedules, payloads and alert-log rows for the series whose forecast breaches."""
    peaks = AL.forecast_peak(AL.breaches(forecast, threshold), ["series_id"], carry=("model",))
    schedule = AL.shed_schedule(peaks, threshold, zones, keys=["series_id"])
    payload = AL.alert_payload(forecast, schedule, threshold, triggered_at=triggered_at)
    stamp = F.lit(triggered_at).cast("timestamp_ntz") if triggered_at is not None else utc_now()
    log = peaks.join(AL.shed_array(schedule, ["series_id"]), "series_id", "left").select(
        "series_id", stamp.alias("timestamp"), "peak_mw", "model", F.col("shed_schedule").alias("schedule"))
    return {"peaks": peaks, "schedule": schedule, "payload": payload, "log": log}


def ingest_and_train(readings: DataFrame, load_path: str, model_path: str, weather: DataFrame | None = None,
                     key: str = "series_id", ts: str = "ts", value: str = "value", fitted_at=None) -> DataFrame:
    """Hourly demand, rescale, temperature, write the load table, fit and append both models.

    Without weather the load table's temperature is the seasonal proxy.

    Returns the load table as read back (so later steps read the written
    table, not the lineage).
    """
    hourly = RD.demand_from_events(readings, key, ts, value)
    load = rescale_minmax(hourly, "load", "load_mw")
    if weather is not None:
        load = attach_weather(load, weather)
    else:
        load = load.withColumn("temp_c", temperature_proxy("ds"))
    RD.write_load(load.select("series_id", "ds", "load", "load_mw", "temp_c"), load_path)
    history = RD.read_load(readings.sparkSession, load_path)
    ST.write_model(ADD.fit_additive(history, fitted_at=fitted_at), model_path)
    ST.write_model(AR.fit_autoregressive(history, weather, fitted_at=fitted_at), model_path)
    return history


def run_evaluation(history: DataFrame, results_path: str, weather: DataFrame | None = None) -> DataFrame:
    """Evaluate both fitted models on the hold-out, write the metrics, return the leaderboard."""
    metrics = EV.evaluate_models(history.select("series_id", "ds", "load_mw"), weather)
    RD.write_eval_results(metrics, results_path)
    back = history.sparkSession.read.option("header", True).csv(results_path)
    typed = back.select("series_id", "model", *[F.col(c).cast("double").alias(c) for c in ("mae", "rmse", "mape")])
    return ME.leaderboard(typed)
