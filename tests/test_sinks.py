"""Sinks and argument checks: evaluation results, alert log, payload, request checks."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from gridcast.models.store import valid_request
from gridcast.operators import alerts as AL
from gridcast.operators import prep as PR
from gridcast.sources import readers as RD

T0 = dt.datetime(2024, 1, 5, 0, 0)


def test_valid_request():
    valid_request(24, "prophet", 20)
    valid_request(168, "lstm", 100)
    for bad in ((0, "prophet", 20), (169, "prophet", 20), (24, "arima", 20), (24, "lstm", 101)):
        with pytest.raises(ValueError):
            valid_request(*bad)


def test_eval_results_roundtrip(spark, tmp):
    df = spark.createDataFrame([("s", "a", 1.0, 2.0, 3.0, [1.0, 2.0])],
                               "series_id string, model string, mae double, rmse double, mape double, preds array<double>")
    RD.write_eval_results(df, f"{tmp}/eval")
    back = RD.read_eval_results(spark, f"{tmp}/eval")
    assert back.columns == ["model", "mae", "rmse", "mape"] and back.count() == 1


def test_alert_log_and_recent(spark, tmp):
    fc = spark.createDataFrame(
        [("a", T0 + dt.timedelta(hours=h), float(v), "profile") for h, v in enumerate([10, 25, 25, 12])],
        "series_id string, ds timestamp_ntz, predicted_mw double, model string")
    fc = fc.withColumns({"lower_mw": F.col("predicted_mw") * 0.92, "upper_mw": F.col("predicted_mw") * 1.08,
                         "alert": F.col("predicted_mw") >= 20.0})
    peaks = AL.forecast_peak(AL.breaches(fc, 20.0), ["series_id"], carry=("model",))
    assert peaks.collect()[0].peak_ds.hour == 1   # tie at the peak: earliest hour
    sched = AL.shed_schedule(peaks, 20.0, keys=["series_id"])
    payload = AL.alert_payload(fc, sched, 20.0, triggered_at="2024-01-05 00:00:00").collect()[0]
    assert payload.peak.predicted_mw == 25.0 and len(payload.forecast_window) == 4
    assert [z.priority for z in payload.shed_schedule] == [1]
    path = f"{tmp}/alerts"
    rows = [("a", T0 + dt.timedelta(minutes=i), 20.0 + i, "profile") for i in range(25)]
    events = spark.createDataFrame(rows, "series_id string, timestamp timestamp_ntz, peak_mw double, model string")
    events = events.withColumn("schedule", F.array().cast(
        "array<struct<zone:string,priority:int,start:string,`end`:string,duration_hrs:double,load_mw:double>>"))
    RD.write_alert_log(events.limit(10), path)
    RD.write_alert_log(events, path)
    back = RD.read_alert_log(spark, path)
    recent = AL.recent_alerts(back, 20).collect()
    assert len(recent) == 20 and recent[0].total == 35 and recent[0].peak_mw == 44.0


def test_select_and_drop(spark):
    df = spark.createDataFrame([("x", "2024-01-01T05", "7.5", 1), ("x", "bad", "1", 2), ("x", "2024-01-01T06", "nan", 3)],
                               "respondent string, period string, value string, extra int")
    sel = PR.select_model_columns(df, {"respondent": "series_id", "value": "raw"}, keep=["period"])
    assert sel.columns == ["period", "series_id", "raw"]
    clean = RD.clean_demand(df.withColumn("type", F.lit("D")))
    assert [(r.period.hour, r.value_mw) for r in clean.collect()] == [(5, 7.5)]
