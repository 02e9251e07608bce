"""Results cover all the data: every test hour, series, decimal and column order."""

import datetime as dt

from pyspark.sql import functions as F

from gridcast import config as C
from gridcast.functions import exact_mean
from gridcast.models import additive as ADD
from gridcast.models import autoregressive as AR
from gridcast.operators import aggregates as AG
from gridcast.operators import alerts as AL
from gridcast.operators import align as J
from gridcast.operators import grid as G
from gridcast.operators.metrics import error_weights
from gridcast.plans import evaluation as EV
from gridcast.plans import requests as RQ
from gridcast.plans import views as V
from gridcast.sources import readers as RD
from gridcast.streaming import jobs as STR

START = dt.datetime(2023, 1, 1)
SMALL = "/root/testdata/sf0.001"


def _series(spark, name, n, value):
    hours = spark.range(n).select(F.lit(name).alias("series_id"), (F.lit(START).cast("timestamp_ntz") + F.expr("make_dt_interval(0, int(id))")).alias("ds"), "id")
    return hours.select("series_id", "ds", value(F.col("id")).cast("double").alias("load_mw"))


def test_every_test_hour_is_scored(spark):
    long = _series(spark, "long", 2000, lambda i: 15 + 4 * F.sin(i * 0.2618) + F.xxhash64(i) % 100 / 100.0)
    short = _series(spark, "short", 40, lambda i: 14 + i % 5).where("hour(ds) % 7 > 0")          # no 24 hours in a row
    got = {(r["series_id"], r["model"]): r for r in EV.evaluate_models(long.unionByName(short)).collect()}
    assert {got["long", m]["n"] for m in ("additive", "autoregressive", "ensemble", "autoregressive_rolling")} == {400}
    assert got["short", "additive"]["n"] == got["short", "ensemble"]["n"] > 0
    assert ("short", "autoregressive") not in got
    assert got["long", "ensemble"]["mae"] <= max(got["long", m]["mae"] for m in ("additive", "autoregressive"))


def test_models_are_scored_at_the_smallest_scale(spark):
    lm = V.load_mw(spark, SMALL).select("series_id", "ds", "load_mw")
    assert EV.evaluate_models(lm, rolling=False).where("model = 'additive'").count() == lm.select("series_id").distinct().count()


def test_long_recursion_equals_blocks(spark):
    """Folding in blocks gives the same values as one step at a time in Python."""
    df = spark.createDataFrame([([1.0, 2.0, 4.0],)], "seed array<double>")
    steps = F.transform(F.sequence(F.lit(1), F.lit(400)), lambda i: F.struct(i.alias("i")))
    out = df.select(AR.recursive_fold(F.col("seed"), F.array(F.lit(0.2), F.lit(0.3), F.lit(0.49)), steps, (), False).alias("o")).first()["o"]
    w, want = [1.0, 2.0, 4.0], []
    for _ in range(400):
        want.append(0.0 + w[0] * 0.2 + w[1] * 0.3 + w[2] * 0.49)
        w = w[1:] + [want[-1]]
    assert len(out) == 400 and max(abs(a - b) for a, b in zip(out, want)) < 1e-12


def test_perfect_model_takes_all_weight(spark):
    df = spark.createDataFrame([(0.0, 2.0), (1.0, 3.0), (None, 2.0), (None, None), (0.0, 0.0)], "a double, b double")
    a, b = error_weights(F.col("a"), F.col("b"))
    got = [(round(r["x"], 6), round(r["y"], 6)) for r in df.select(a.alias("x"), b.alias("y")).collect()]
    assert got == [(1.0, 0.0), (0.75, 0.25), (0.0, 1.0), (0.5, 0.5), (0.5, 0.5)]


def test_daily_series_scores_with_an_ensemble(spark):
    daily = _series(spark, "d", 600, lambda i: 10 + i % 24)
    assert {r["model"] for r in EV.evaluate(daily).collect()} == {"seasonal_naive", "profile", "ensemble"}


def test_daily_order_forecast_is_not_constant(spark):
    fc = ADD.forecast_additive(ADD.fit_additive(V.daily_load(spark, SMALL), value="load", rescale=True), 24, threshold=None, step="1 DAY", bounds=None)
    rows = fc.where("series_id = '1-URGENT'").orderBy("step").collect()
    mean = V.daily_load(spark, SMALL).where("series_id = '1-URGENT'").agg(F.avg("load")).first()[0]
    assert len({r["predicted_mw"] for r in rows}) > 10 and not any(r["alert"] for r in rows)
    assert rows[1]["ds"] - rows[0]["ds"] == dt.timedelta(days=1)
    assert 0.05 * mean < sum(r["predicted_mw"] for r in rows) / len(rows) < 20 * mean


def test_small_readings_add_up(spark):
    df = spark.range(50).select(F.lit("m").alias("event_type"), F.lit(START).cast("timestamp_ntz").alias("ts"), F.lit(0.004).alias("value"))
    assert RD.demand_from_events(df).first()["load"] == 0.2
    assert df.agg(exact_mean("value")).first()[0] == 0.004


def test_load_csv_by_header_name(spark, tmp):
    with open(tmp + "/a.csv", "w") as f:
        f.write("ds,temp_c,note,load_mw\n2024-01-01 00:00:00,21.5,x,15.0\n2024-01-01 01:00:00,bad,y,16.25\n")
    got = [(r["load_mw"], r["temp_c"]) for r in RD.read_load_csv(spark, tmp + "/a.csv").orderBy("ds").collect()]
    assert got == [(15.0, 21.5), (16.25, None)]


def test_missing_prediction_is_no_alert(spark):
    model = spark.createDataFrame([("s", 0.0, 1.0, START, [None] * 77, 1.0, 1.0)],
                                  "series_id string, t0 double, t1 double, last_ds timestamp_ntz, coef array<double>, sigma double, y_scale double")
    assert [r["alert"] for r in ADD.forecast_additive(model, 2).collect()] == [False, False]


def test_new_series_still_alerts(spark):
    hours = spark.createDataFrame([("known", 5.0), ("new", 25.0), ("new", 1.0)], "series_id string, load double")
    bounds = spark.createDataFrame([("known", 0.0, 5.0)], "series_id string, _lo double, _hi double")
    got = STR.stream_threshold_alerts(hours, bounds, 20.0).collect()
    assert sorted((r["series_id"], r["load_mw"]) for r in got) == [("known", 22.0), ("new", 25.0)]


def test_weather_of_each_series(spark):
    load = spark.createDataFrame([("a", START, 1.0), ("b", START, 2.0)], "series_id string, ds timestamp_ntz, load_mw double")
    own = spark.createDataFrame([("a", START, 5.0)], "series_id string, ds timestamp_ntz, temp_c double")
    got = {r["series_id"]: r["temp_c"] for r in J.attach_weather(load, own).collect()}
    assert got == {"a": 5.0, "b": C.FALLBACK_TEMP_C}
    assert {r["temp_c"] for r in J.attach_weather(load, own.drop("series_id")).collect()} == {5.0}


def test_summary_names_series_without_data(spark):
    df = spark.createDataFrame([("a", START, 1.0), ("b", START, None)], "series_id string, ds timestamp_ntz, load_mw double")
    assert {r["series_id"]: (r["status"], r["rows"]) for r in AG.load_summary(df).collect()} == {"a": ("ready", 1), "b": ("no_data", 0)}


def test_envelope(spark):
    model = spark.createDataFrame([("s", 0.0, 1.0, START, [10.0] + [0.0] * 76, 1.0, 1.0)],
                                  "series_id string, t0 double, t1 double, last_ds timestamp_ntz, coef array<double>, sigma double, y_scale double")
    got = RQ.forecast_envelope(ADD.forecast_additive(model, 5), 5).collect()
    assert len(got) == 1 and got[0]["district"] == C.DISTRICT and [r["predicted_mw"] for r in got[0]["forecast"]] == [10.0] * 5


def test_future_grid_has_no_limit(spark):
    assert G.future_grid(_series(spark, "s", 3, lambda i: i), 10_500).count() == 10_500


def test_zones_by_series_keep_every_alert(spark):
    peaks = spark.createDataFrame([("a", START, 24.0), ("b", START, 24.0)], "series_id string, peak_ds timestamp_ntz, peak_mw double")
    zones = spark.createDataFrame([("a", 1, "Z1"), ("a", 2, "Z2")], "series_id string, priority int, zone string")
    got = AL.shed_schedule(peaks, 20.0, zones, zones_by_key="series_id").collect()
    assert {r["series_id"] for r in got} == {"a", "b"} and {r["zone"] for r in got if r["series_id"] == "a"} == {"Z1"}
    one = AL.shed_schedule(peaks, 20.0, zones.drop("series_id"))
    assert {r["zone"] for r in one.collect()} == {"Z1"}


def test_stream_reads_a_folder_of_part_files(spark, tmp):
    spark.read.parquet(SMALL + "/events.parquet").repartition(3).write.parquet(tmp + "/events.parquet")
    schema = spark.read.parquet(SMALL + "/events.parquet").schema
    counts = []
    for path in (SMALL + "/events.parquet", tmp + "/events.parquet"):
        at = f"{tmp}/run{len(counts)}"
        q = (STR.read_table_stream(spark, path, schema).writeStream.format("parquet").option("path", at + "/out")
             .option("checkpointLocation", at + "/cp").trigger(availableNow=True).start())
        q.awaitTermination()
        counts.append(spark.read.parquet(at + "/out").count())
    assert counts[0] == counts[1] > 0
