"""Two-phase ridge fit and the recursive forecast fold against plain numpy / Python."""

import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from gridcast.models import additive as ADD
from gridcast.models import autoregressive as AR
from gridcast.models import store as ST
from gridcast.models.ridge import fit_ridge


def test_ridge_matches_numpy(spark):
    rng = np.random.default_rng(3)
    rows, truth = [], {}
    for key, n in (("hot", 3000), ("a", 40), ("b", 7)):
        X = np.c_[np.ones(n), rng.normal(size=(n, 3))]
        beta = rng.normal(size=4)
        y = X @ beta + rng.normal(scale=0.1, size=n)
        truth[key] = (X, y)
        rows += [(key, X[i].tolist(), float(y[i])) for i in range(n)]
    df = spark.createDataFrame(rows, "series_id string, x array<double>, y double").repartition(8)
    pen = [1e-9] * 4
    got = {r.series_id: r for r in fit_ridge(df, ["series_id"], pen).collect()}
    flushed = {r.series_id: r for r in fit_ridge(df, ["series_id"], pen, flush_doubles=1).collect()}
    for key in truth:
        assert np.allclose(flushed[key].coef, got[key].coef, atol=1e-10) and flushed[key].n == got[key].n
    for key, (X, y) in truth.items():
        want = np.linalg.solve(X.T @ X + np.diag(pen), X.T @ y)
        assert np.allclose(got[key].coef, want, atol=1e-8), key
        resid = y - X @ want
        assert abs(got[key].sigma - np.sqrt(resid @ resid / max(len(y) - 4, 1))) < 1e-8
        assert got[key].n == len(y)


def test_fixed_ar_fold_matches_loop(spark):
    start = dt.datetime(2024, 1, 1)
    vals = {"a": [10.0, 12.0, 11.0, 13.0, 14.0], "b": [20.0, 19.0, 18.0]}
    rows = [(k, start + dt.timedelta(hours=i), v) for k, vs in vals.items() for i, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "series_id string, ds timestamp_ntz, load_mw double")
    w = (0.5, 0.3, 0.2)
    got = {(r.series_id, r.step): r.predicted for r in AR.forecast_fixed_ar(df, w, 6).collect()}
    for k, vs in vals.items():
        hist = list(vs)
        for step in range(1, 7):
            y = w[0] * hist[-1] + w[1] * hist[-2] + w[2] * hist[-3]
            assert abs(got[(k, step)] - y) < 1e-12
            hist.append(y)


def _hourly(spark, n_hours=24 * 21, series=("x", "y")):
    start = dt.datetime(2024, 1, 1)
    rows = []
    for j, s in enumerate(series):
        for i in range(n_hours):
            h = i % 24
            rows.append((s, start + dt.timedelta(hours=i), float(15.0 + 3 * np.sin(2 * np.pi * h / 24) + j)))
    return spark.createDataFrame(rows, "series_id string, ds timestamp_ntz, load_mw double")


def test_additive_recovers_daily_shape(spark):
    df = _hourly(spark)
    model = ADD.fit_additive(df)
    fc = ADD.forecast_additive(model, 24).collect()
    assert len(fc) == 48
    for r in fc:
        h = r.ds.hour
        want = 15.0 + 3 * np.sin(2 * np.pi * h / 24) + (0 if r.series_id == "x" else 1)
        assert abs(r.predicted_mw - want) < 0.05, (r.series_id, h, r.predicted_mw, want)
        assert r.lower_mw <= r.predicted_mw <= r.upper_mw
        assert r.alert == (r.predicted_mw >= 20.0)


def test_autoregressive_forecast_and_store(spark, tmp):
    df = _hourly(spark)
    model = AR.fit_autoregressive(df, None, fitted_at="2024-02-01 00:00:00")
    fc = AR.forecast_autoregressive(model, df, 48).collect()
    assert len(fc) == 96
    for r in fc:
        want = 15.0 + 3 * np.sin(2 * np.pi * r.ds.hour / 24) + (0 if r.series_id == "x" else 1)
        assert abs(r.predicted_mw - want) < 0.1
        assert abs(r.upper_mw - round(r.predicted_mw * 1.08, 3)) < 2e-3
    path = f"{tmp}/models"
    ST.write_model(model, path)
    newer = AR.fit_autoregressive(df.where(F.col("ds") < "2024-01-15"), None, fitted_at="2024-03-01 00:00:00")
    ST.write_model(newer, path)
    back = ST.read_model(spark, path, "autoregressive").collect()
    assert len(back) == 2 and all(str(r.fitted_at).startswith("2024-03-01") for r in back)


def test_fallback_and_fresh(spark):
    a = spark.createDataFrame([("x", "ar", 1)], "series_id string, model string, step int")
    b = spark.createDataFrame([("x", "add", 1), ("y", "add", 1)], "series_id string, model string, step int")
    got = sorted((r.series_id, r.model) for r in ST.fallback_model(a, b).collect())
    assert got == [("x", "ar"), ("y", "add")]
    runs = spark.createDataFrame(
        [("x", "m", 24, dt.datetime(2024, 1, 1, 0, 0), 1), ("x", "m", 24, dt.datetime(2024, 1, 1, 0, 3), 1),
         ("y", "m", 24, dt.datetime(2023, 12, 31, 23, 0), 1)],
        "series_id string, model string, hours int, generated_at timestamp_ntz, step int")
    fresh = ST.fresh_forecast(runs, "2024-01-01 00:04:00", 300).collect()
    assert [(r.series_id, r.generated_at.minute) for r in fresh] == [("x", 3)]


def test_rolling_origins_match_single_forecasts(spark):
    df = _hourly(spark, n_hours=24 * 10, series=("x",))
    model = AR.fit_autoregressive(df.where(F.col("ds") < "2024-01-08"), None, fitted_at="2024-02-01 00:00:00")
    anchors = spark.createDataFrame([("x", dt.datetime(2024, 1, 7, 23))], "series_id string, anchor timestamp_ntz")
    roll = AR.rolling_forecast_autoregressive(model, df, anchors, 24, 24).collect()
    origins = sorted({r.origin for r in roll})
    # origins every 24 h from the anchor up to the last history hour (Jan 10 23:00)
    assert origins == [dt.datetime(2024, 1, d, 23) for d in (7, 8, 9, 10)]
    for origin in origins[:2]:
        single = AR.forecast_autoregressive(
            model.withColumn("last_ds", F.lit(origin).cast("timestamp_ntz")), df.where(F.col("ds") <= origin), 24)
        want = {r.ds: r.predicted_mw for r in single.collect()}
        got = {r.ds: r.predicted_mw for r in roll if r.origin == origin}
        assert got == want
