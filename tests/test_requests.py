"""Request flows: ingest and train (E2), forecast request (E1) with fallback, alert events, evaluation."""

import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from gridcast.plans import requests as RQ

T0 = dt.datetime(2024, 1, 1)


def _readings(spark):
    rng = np.random.default_rng(11)
    rows = []
    for sid, hours in (("north", 24 * 21), ("south", 24 * 21), ("tiny", 12)):
        for h in range(hours):
            base = 100 + 60 * np.sin(2 * np.pi * (h % 24) / 24)
            for m in (5, 35):
                rows.append((sid, T0 + dt.timedelta(hours=h, minutes=m), float(round(base + rng.normal(0, 5), 2))))
    return spark.createDataFrame(rows, "series_id string, ts timestamp_ntz, value double")


def test_request_flows(spark, tmp):
    load_path, model_path = f"{tmp}/load", f"{tmp}/models"
    history = RQ.ingest_and_train(_readings(spark), load_path, model_path, fitted_at="2024-02-01 00:00:00")
    assert history.select("series_id").distinct().count() == 3
    assert spark.read.parquet(load_path).where(F.col("series_id") == "tiny").count() == 12   # partition pruning path

    fc = RQ.forecast_request(spark, model_path, history, "lstm", 24, threshold=20.0)
    by_model = {(r.series_id, r.model) for r in fc.select("series_id", "model").distinct().collect()}
    assert by_model == {("north", "autoregressive"), ("south", "autoregressive"), ("tiny", "additive")}
    assert fc.count() == 72

    ev = RQ.alert_events(fc, 20.0, triggered_at="2024-02-01 00:00:00")
    peaks = {r.series_id: r.peak_mw for r in ev["peaks"].collect()}
    assert set(peaks) <= {"north", "south", "tiny"} and all(v >= 20.0 for v in peaks.values())
    log = ev["log"].collect()
    assert len(log) == len(peaks) and all(len(r.schedule) >= 1 for r in log)

    board = RQ.run_evaluation(history.where(F.col("series_id") != "tiny"), f"{tmp}/eval").collect()
    models = {r.model for r in board}
    assert {"additive", "autoregressive", "ensemble", "autoregressive_rolling"} == models
    assert all(r.rank >= 1 for r in board) and sum(r.recommended for r in board) == 2
