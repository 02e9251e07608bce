"""Landed files: demand pages (F1), weather (F4), load CSV (F3); cleaning and rescale (F2)."""

import datetime as dt
import json
import math

import pytest
from pyspark.sql import functions as F

from gridcast.operators import grid as G
from gridcast.operators import prep as PR
from gridcast.sources import readers as RD


def _pages(tmp):
    p1 = {"response": {"total": "5", "data": [
        {"period": "2024-01-01T00", "respondent": "ERCO", "type": "D", "value": "41000"},
        {"period": "2024-01-01T01", "respondent": "ERCO", "type": "D", "value": "bad"},
        {"period": "2024-01-01T02", "respondent": "ERCO", "type": "NG", "value": "1"}]}}
    p2 = {"response": {"total": 5, "data": [
        {"period": "2024-01-01T02", "respondent": "ERCO", "type": "D", "value": "43000"},
        {"period": "2024-01-01T00", "respondent": "ERCO", "type": "D", "value": "41500"}]}}
    p3 = {"response": {"total": "n/a", "data": []}}
    for i, p in enumerate((p1, p2, p3), 1):
        with open(f"{tmp}/page{i}.json", "w") as f:
            f.write(json.dumps(p) + "\n")
    return tmp


def test_demand_pages(spark, tmp):
    path = _pages(tmp)
    raw = RD.read_demand_pages(spark, path)
    assert raw.count() == 5
    clean = RD.clean_demand(raw, respondent="ERCO", kind="D")
    rows = sorted((r.period.hour, r.value_mw) for r in clean.collect())
    assert rows == [(0, 41000.0), (0, 41500.0), (2, 43000.0)]          # bad value dropped, NG filtered
    comp = RD.page_completeness(spark, path).collect()[0]
    assert comp.collected == 5 and comp.declared == 5 and comp.complete


def test_combine_pages_newest_wins(spark):
    t = dt.datetime(2024, 1, 1)
    a = spark.createDataFrame([("s", t, 1.0, 1), ("s", t + dt.timedelta(hours=1), 2.0, 1)],
                              "series_id string, period timestamp_ntz, value_mw double, page int")
    b = spark.createDataFrame([("s", t, 9.0, 2)], "series_id string, period timestamp_ntz, value_mw double, page int")
    got = sorted((r.period.hour, r.value_mw) for r in G.combine_pages(a, b).collect())
    assert got == [(0, 9.0), (1, 2.0)]


def test_weather(spark, tmp):
    doc = {"hourly": {"time": ["2024-01-01T00:00", "2024-01-01T01:00"], "temperature_2m": [10.5, None],
                      "relative_humidity_2m": [50, 51], "precipitation": [0, 0], "shortwave_radiation": [0, 0],
                      "wind_speed_10m": [3, 4]}}
    with open(f"{tmp}/w.json", "w") as f:
        f.write(json.dumps(doc) + "\n")
    rows = RD.read_weather(spark, f"{tmp}/w.json").orderBy("ds").collect()
    assert [r.temperature_2m for r in rows] == [10.5, None]
    utc = RD.read_weather(spark, f"{tmp}/w.json", "America/Chicago").orderBy("ds").collect()
    assert utc[0].ds == dt.datetime(2024, 1, 1, 6, 0)
    with open(f"{tmp}/bad.json", "w") as f:
        f.write(json.dumps({"other": 1}) + "\n")
    with pytest.raises(Exception):
        RD.read_weather(spark, f"{tmp}/bad.json").collect()


def test_load_csv_roundtrip(spark, tmp):
    with open(f"{tmp}/load.csv", "w") as f:
        f.write("ds,load_mw,temp_c\n2024-01-01 00:00:00,12.5,20.1\n2024-01-01 01:00:00,13.0,\n")
    df = RD.read_load_csv(spark, f"{tmp}/load.csv", series_id="ERCO")
    assert df.count() == 2
    assert PR.drop_null(df, ["load_mw", "temp_c"]).count() == 1
    RD.write_load(df, f"{tmp}/out")
    back = spark.read.parquet(f"{tmp}/out").where(F.col("series_id") == "ERCO")
    assert back.count() == 2


def test_rescale_adverse(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [("v", t + dt.timedelta(hours=i), float(v)) for i, v in enumerate(range(100))]
    rows += [("const", t + dt.timedelta(hours=i), 7.0) for i in range(10)]
    rows += [("v", t + dt.timedelta(hours=200), None), ("v", t + dt.timedelta(hours=201), float("nan"))]
    df = spark.createDataFrame(rows, "series_id string, ds timestamp_ntz, load double")
    out = PR.rescale_minmax(df).collect()
    vals = [r.load_mw for r in out if r.series_id == "v" and r.load_mw is not None]
    assert min(vals) == 12.0 and max(vals) == 22.0 and all(12.0 <= v <= 22.0 for v in vals)
    assert {r.load_mw for r in out if r.series_id == "const"} == {12.0}
    missing = [r for r in out if r.series_id == "v" and (r.load is None or math.isnan(r.load))]
    assert len(missing) == 2 and all(r.load_mw is None for r in missing)


def test_minmax_roundtrip(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("a", 2.0), ("b", 5.0)], "series_id string, x double")
    b = PR.minmax_bounds(df, ["x"])
    back = PR.minmax_inverse(PR.minmax_scale(df, ["x"], b), "x_scaled", b, "x", out="x_back").collect()
    for r in back:
        if r.series_id == "a":
            assert abs(r.x_back - r.x) < 1e-12
        else:
            assert r.x_scaled == 0.0


def test_approx_quantiles_close_to_exact(spark):
    from gridcast.operators import aggregates as AG

    df = spark.createDataFrame([("s", float(v)) for v in range(1001)], "series_id string, load_mw double")
    exact = {r.p: r.value for r in AG.quantiles(df, (0.1, 0.5, 0.9)).collect()}
    approx = {r.p: r.value for r in AG.approx_quantiles(df, (0.1, 0.5, 0.9)).collect()}
    assert exact == {0.1: 100.0, 0.5: 500.0, 0.9: 900.0}
    assert all(abs(approx[p] - exact[p]) <= 1.0 for p in exact)
