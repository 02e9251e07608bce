"""Structured Streaming: hourly windows with late data, exact cooldown, the hourly job."""

import datetime as dt
import os

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from gridcast.models.additive import fit_additive
from gridcast.models.store import write_model
from gridcast.streaming import jobs as S

T0 = dt.datetime(2024, 1, 1)


def _land(path, batches, columns):
    """One Parquet file per batch; times as UTC microsecond timestamps (Spark TIMESTAMP)."""
    os.makedirs(path, exist_ok=True)
    for i, rows in enumerate(batches):
        f = f"{path}/part-{i:04d}.parquet"
        table = pa.Table.from_pandas(pd.DataFrame(rows, columns=columns), preserve_index=False)
        fields = [pa.field(n, pa.timestamp("us", tz="UTC")) if pa.types.is_timestamp(t) else pa.field(n, t)
                  for n, t in zip(table.schema.names, table.schema.types)]
        pq.write_table(table.cast(pa.schema(fields)), f)
        os.utime(f, (1_700_000_000 + i * 10, 1_700_000_000 + i * 10))


def _hm(h, m=0):
    return T0 + dt.timedelta(hours=h, minutes=m)


def test_hourly_window_drops_late_rows(spark, tmp):
    src = f"{tmp}/readings"
    _land(src, [
        [("a", _hm(0, 10), 1.0), ("a", _hm(0, 20), 2.0)],
        [("a", _hm(2, 10), 5.0)],
        [("a", _hm(3, 30), 7.0)],
        [("a", _hm(0, 40), 100.0)],   # two batches after the watermark passed hour 0: dropped
    ], ["series_id", "ts", "value"])
    hourly = S.stream_hourly_load(S.read_readings(spark, src, 1), "1 hour")
    q = hourly.writeStream.format("memory").queryName("hourly_t1").outputMode("append") \
        .option("checkpointLocation", f"{tmp}/ck").trigger(availableNow=True).start()
    q.awaitTermination()
    out = {r.ds.replace(tzinfo=None): r.load for r in spark.sql("select * from hourly_t1").collect()}
    assert out == {_hm(0): 3.0}


def test_stateful_cooldown(spark, tmp):
    src = f"{tmp}/alerts"
    _land(src, [
        [("a", _hm(0, 0), 21.0), ("a", _hm(0, 2), 21.5), ("b", _hm(0, 1), 30.0)],
        [("a", _hm(0, 5), 22.0), ("a", _hm(0, 6), 22.5)],
        [("a", _hm(0, 11), 23.0)],
    ], ["series_id", "ds", "load_mw"])
    stream = spark.readStream.schema("series_id string, ds timestamp, load_mw double").option(
        "maxFilesPerTrigger", 1).parquet(src)
    q = S.stream_dedupe_alerts(stream, 300).writeStream.format("memory").queryName("cool_t1") \
        .outputMode("append").option("checkpointLocation", f"{tmp}/ck2").trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted((r.series_id, r.ds.replace(tzinfo=None)) for r in spark.sql("select * from cool_t1").collect())
    assert got == [("a", _hm(0, 0)), ("a", _hm(0, 5)), ("a", _hm(0, 11)), ("b", _hm(0, 1))]


def test_threshold_alert_stream(spark, tmp):
    hist = spark.createDataFrame([("a", _hm(i), float(i % 24)) for i in range(240)], "series_id string, ds timestamp_ntz, load double")
    bounds = S.rescale_bounds(hist)
    src = f"{tmp}/r2"
    _land(src, [[("a", _hm(300, 5), 23.0)], [("a", _hm(301, 5), 1.0)], [("a", _hm(303, 5), 1.0)]],
          ["series_id", "ts", "value"])
    hourly = S.stream_hourly_load(S.read_readings(spark, src, 1), "30 minutes")
    q = S.stream_threshold_alerts(hourly, bounds, 20.0).writeStream.format("memory").queryName("r2_t1") \
        .outputMode("append").option("checkpointLocation", f"{tmp}/ck3").trigger(availableNow=True).start()
    q.awaitTermination()
    rows = spark.sql("select * from r2_t1").collect()
    assert len(rows) == 1 and rows[0].load_mw == 22.0


def test_forecast_job_replay_is_idempotent(spark, tmp):
    hist = spark.createDataFrame(
        [("a", _hm(i), 15.0 + 6 * ((i % 24) / 23.0)) for i in range(24 * 14)],
        "series_id string, ds timestamp_ntz, load_mw double")
    models = f"{tmp}/models"
    write_model(fit_additive(hist), models)
    src = f"{tmp}/job_in"
    _land(src, [[("a", _hm(24 * 14 + h, 10), 18.0)] for h in range(3)], ["series_id", "ts", "value"])
    load_out, alert_out = f"{tmp}/load", f"{tmp}/alerts_log"
    for run in range(2):   # the second run replays the same input with a new checkpoint
        q = S.run_forecast_job(S.read_readings(spark, src, 1), f"{tmp}/jobck{run}", load_out, models, alert_out,
                               hours=24, threshold=16.0, delay="30 minutes")
        q.awaitTermination()
    loads = spark.read.parquet(load_out)
    assert loads.count() == loads.select("series_id", "ds").distinct().count() > 0
    alerts = spark.read.parquet(alert_out)
    assert alerts.count() >= 1
    assert alerts.groupBy("batch_id").count().where(F.col("count") > 1).count() == 0
    first = alerts.orderBy("batch_id").first()
    assert first.peak_mw >= 16.0 and len(first.schedule) >= 1


def test_replayed_file_kept_once(spark, tmp):
    src = f"{tmp}/replay"
    rows = [("a", _hm(0, m), float(m)) for m in range(0, 60, 7)] + [("b", _hm(0, 3), 9.0)]
    _land(src, [rows, rows], ["series_id", "ds", "load_mw"])   # the same file landed twice
    stream = spark.readStream.schema("series_id string, ds timestamp, load_mw double").option(
        "maxFilesPerTrigger", 1).parquet(src)
    q = S.stream_dedupe_within_watermark(stream, "1 hour", ("series_id", "ds")).writeStream.format("memory") \
        .queryName("replay_t1").outputMode("append").option("checkpointLocation", f"{tmp}/ck5") \
        .trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("select * from replay_t1").count() == len(rows)


def test_stateful_cooldown_non_utc_session(spark, tmp):
    """Same multi-batch cooldown with the session in America/Chicago: state timeouts use true epoch time."""
    src = f"{tmp}/alerts_tz"
    _land(src, [
        [("a", _hm(0, 0), 21.0), ("a", _hm(0, 2), 21.5)],
        [("a", _hm(0, 5), 22.0), ("a", _hm(0, 6), 22.5)],
        [("a", _hm(0, 11), 23.0)],
    ], ["series_id", "ds", "load_mw"])
    spark.conf.set("spark.sql.session.timeZone", "America/Chicago")
    try:
        stream = spark.readStream.schema("series_id string, ds timestamp, load_mw double").option(
            "maxFilesPerTrigger", 1).parquet(src)
        q = S.stream_dedupe_alerts(stream, 300).writeStream.format("memory").queryName("cool_tz") \
            .outputMode("append").option("checkpointLocation", f"{tmp}/ck6").trigger(availableNow=True).start()
        q.awaitTermination()
        got = sorted(r.ds.replace(tzinfo=None) for r in spark.sql("select * from cool_tz").collect())
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    # collect() renders instants in the Python process's zone (UTC here), not the session zone
    assert got == [_hm(0, 0), _hm(0, 5), _hm(0, 11)]
