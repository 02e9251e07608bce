"""Structured Streaming versions of the pipeline.

* R1 :func:`stream_hourly_load` - tumbling one-hour windows over readings,
  event-time watermark, append mode (an hour is emitted once the watermark
  passes its end; later rows for it are dropped).
* R2 :func:`stream_threshold_alerts` - rescale each hour with the series'
  p1/p99 bounds (a stream-static join against a per-series table) and keep
  breaches. :func:`run_threshold_job` moves the bounds with the stream: every
  batch merges its hours into a KLL quantile sketch per series.
* R3 :func:`stream_admit_alerts` - cooldown per series, exact: an alert
  waits in the state until the watermark has passed it, so that none before
  it can come any more, and is then admitted in time order. Its rows are
  those of :func:`gridcast.operators.alerts.dedupe_alerts` (``transformWithState``,
  one event-time timer per series; the state holds the alerts of the
  watermark's delay). :func:`stream_dedupe_alerts` decides at once instead
  (``applyInPandasWithState``): rows are ordered within a micro-batch, and a
  row that arrives in a later batch than a newer admitted one is refused.
  :func:`stream_dedupe_within_watermark` is the built-in approximation.
* R4 :func:`forecast_alert_batch` / :func:`run_forecast_job` -
  ``foreachBatch``: append the batch's hours to the load table, rescaled and
  with their temperature, add them to the sums that the models are fitted
  from (:mod:`gridcast.models.sums`), forecast from the fitted model, find the
  peak, build the schedule and append alert events. Writes go to ``batch_id=<id>``
  partitions with dynamic partition overwrite, so a replayed batch replaces itself.
* R5 freshness is :func:`gridcast.operators.alerts.freshness` on the output.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from .. import config as C
from ..functions import exact_sum, not_missing, rnd, temperature_proxy
from ..models.sums import read_table, write_batch
from ..operators.align import attach_weather
from ..operators.prep import series_quantiles

READING_SCHEMA = T.StructType([
    T.StructField("series_id", T.StringType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("value", T.DoubleType()),
])


def read_readings(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Readings landed as Parquet files in ``path`` (one or more per hour)."""
    r = spark.readStream.schema(READING_SCHEMA).format("parquet")
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", int(max_files_per_trigger))
    return r.load(path)


def read_table_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """A Parquet table as a stream of its files, whether ``path`` is one file or a folder of part files."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    reader = spark.readStream.schema(schema)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory():
        return reader.parquet(path)
    folder, _, name = path.rpartition("/")
    return reader.option("pathGlobFilter", name).parquet(folder)


def stream_hourly_load(readings: DataFrame, delay: str = "1 hour", key: str = "series_id", ts: str = "ts",
                       value: str = "value") -> DataFrame:
    """``(series_id, ds, load)`` per closed hour (append mode)."""
    return (
        readings.withWatermark(ts, delay)
        .groupBy(F.col(key).alias("series_id"), F.window(ts, "1 hour").alias("w"))
        .agg(exact_sum(value).alias("load"))
        .select("series_id", F.col("w.start").alias("ds"), "load")
    )


def rescale_bounds(history: DataFrame, value: str = "load", key: str = "series_id") -> DataFrame:
    """Per-series p1/p99 of the hourly history (one row per series; the static side of R2)."""
    lo_p, hi_p = C.RESCALE_QUANTILES
    q = series_quantiles(history, value, (lo_p, hi_p), key)
    return q.toDF(key, "_lo", "_hi")


def rescaled(load, low, high, cfg: C.GridConfig = C.GridConfig()):
    """Load on the district's scale, given the series' bounds; without bounds it is taken as MW as it stands."""
    clipped = F.least(F.greatest(load, low), high)
    norm = F.coalesce(F.try_divide(clipped - low, F.nullif(high - low, F.lit(0.0))), F.lit(0.0))
    scaled = F.least(F.greatest(F.lit(cfg.base_mw) + norm * F.lit(cfg.peak_mw - cfg.base_mw), F.lit(cfg.rescale_floor)),
                     F.lit(cfg.rescale_cap))
    return rnd(F.when(low.isNull(), load).otherwise(scaled), 3)


def stream_threshold_alerts(hourly: DataFrame, bounds: DataFrame, threshold: float = C.THRESHOLD_MW,
                            cfg: C.GridConfig = C.GridConfig(), key: str = "series_id") -> DataFrame:
    """Hours whose rescaled load is at or above ``threshold`` (stream-static left join on the series).

    A series without bounds yet has no scale; its load is taken as MW as it stands.
    """
    return (
        hourly.join(bounds, key, "left")
        .withColumn("load_mw", rescaled(F.col("load"), F.col("_lo"), F.col("_hi"), cfg))
        .drop("_lo", "_hi")
        .where(F.col("load_mw") >= F.lit(float(threshold)))
    )


SKETCH_K = 2000                 # items a KLL sketch level keeps
RANK_ERROR = 0.005              # bound on the rank error of its quantiles at this size (about 0.0025 is expected)
SKETCHES = "series_id STRING, sketch BINARY, batch_id BIGINT"


def update_sketches(hours: DataFrame, batch_id: int, path: str, value: str = "load") -> None:
    """Merges a batch's hours into the series' quantile sketches; the partition of the batch holds the state after it.

    The state before it is that of the newest earlier batch, so a replayed
    batch gives its own state again. It has one sketch a series, whose size
    does not grow with the hours (beyond ``SKETCH_K`` only with their logarithm).
    """
    spark = hours.sparkSession
    old = read_table(spark, path, SKETCHES).where(F.col("batch_id") < int(batch_id))
    newest = old.agg(F.max("batch_id").alias("b")).first()["b"]
    new = hours.where(not_missing(value)).groupBy("series_id").agg(F.kll_sketch_agg_double(value, F.lit(SKETCH_K)).alias("sketch"))
    both = old.where(F.col("batch_id") == F.lit(newest)).select("series_id", "sketch").unionByName(new)
    write_batch(both.groupBy("series_id").agg(F.kll_merge_agg_double("sketch").alias("sketch")), path, batch_id)


def sketch_bounds(spark: SparkSession, path: str, batch_id: int | None = None, quantiles=C.RESCALE_QUANTILES) -> DataFrame:
    """``(series_id, _lo, _hi, _n)`` from the sketches after ``batch_id`` (default: the newest)."""
    state = read_table(spark, path, SKETCHES)
    upto = state if batch_id is None else state.where(F.col("batch_id") <= int(batch_id))
    newest = upto.agg(F.max("batch_id").alias("b")).first()["b"]
    lo, hi = (F.kll_sketch_get_quantile_double("sketch", F.lit(float(q))) for q in quantiles)
    return state.where(F.col("batch_id") == F.lit(newest)).select(
        "series_id", lo.alias("_lo"), hi.alias("_hi"), F.kll_sketch_get_n_double("sketch").alias("_n"))


def threshold_batch(batch: DataFrame, batch_id: int, state_path: str, alert_path: str, threshold: float = C.THRESHOLD_MW,
                    cfg: C.GridConfig = C.GridConfig()) -> None:
    """One micro-batch of R2 with moving bounds: update the sketches, rescale the batch's hours, append its breaches."""
    hours = batch.select("series_id", F.col("ds").cast("timestamp_ntz").alias("ds"), "load").persist()
    if not hours.isEmpty():
        update_sketches(hours, batch_id, state_path)
        bounds = sketch_bounds(hours.sparkSession, state_path, batch_id).select("series_id", "_lo", "_hi")
        write_batch(stream_threshold_alerts(hours, bounds, threshold, cfg), alert_path, batch_id)
    hours.unpersist()


def run_threshold_job(readings: DataFrame, checkpoint: str, state_path: str, alert_path: str, threshold: float = C.THRESHOLD_MW,
                      delay: str = "1 hour", available_now: bool = True, interval: str = "1 hour"):
    """Start R2 with moving bounds: R1 feeding :func:`threshold_batch`."""
    writer = stream_hourly_load(readings, delay).writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(
        lambda df, bid: threshold_batch(df, bid, state_path, alert_path, threshold))
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)).start()


ALERT_OUT = T.StructType([
    T.StructField("series_id", T.StringType()),
    T.StructField("ds", T.TimestampType()),
    T.StructField("load_mw", T.DoubleType()),
])
ALERT_STATE = T.StructType([T.StructField("last_admitted_us", T.LongType())])


def _cooldown(cooldown_s: int):
    cool_us = int(cooldown_s) * 1_000_000

    def fn(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        frames = [p for p in pdfs if not p.empty]
        if not frames:
            return
        rows = pd.concat(frames).sort_values("_us", kind="stable")
        stamps = rows["_us"].to_numpy(dtype="int64")   # true epoch microseconds (session-zone free)
        keep = []
        for us in stamps:
            ok = last is None or us - last >= cool_us
            keep.append(ok)
            if ok:
                last = int(us)
        state.update((last,))
        state.setTimeoutTimestamp(int(last // 1000) + int(cooldown_s) * 1000)
        out = rows[keep]
        if not out.empty:
            yield out[["series_id", "ds", "load_mw"]]
    return fn


def stream_dedupe_alerts(alerts: DataFrame, cooldown_s: int = C.ALERT_COOLDOWN_S, delay: str = "1 hour") -> DataFrame:
    """Admit an alert when ``cooldown_s`` passed since the last admitted one of the series.

    Rows of one micro-batch are taken in event-time order; the state (last
    admitted time) is dropped once the watermark passes it by the cooldown.
    """
    return (
        alerts.withWatermark("ds", delay)
        .select("series_id", "ds", "load_mw", F.unix_micros("ds").alias("_us"))
        .groupBy("series_id")
        .applyInPandasWithState(_cooldown(cooldown_s), ALERT_OUT, ALERT_STATE, "append",
                                GroupStateTimeout.EventTimeTimeout)
    )


def admitted_times(stamps: np.ndarray, last: int | None, cooldown: int) -> np.ndarray:
    """Places of the admitted ones in sorted ``stamps``: one search for each admitted alert, none for the others."""
    out, at = [], 0 if last is None else int(np.searchsorted(stamps, last + cooldown))
    while at < len(stamps):
        out.append(at)
        at = int(np.searchsorted(stamps, stamps[at] + cooldown))
    return np.array(out, np.int64)


class CooldownProcessor(StatefulProcessor):
    """Holds a series' alerts until the watermark passes them, then admits them in time order.

    State: the waiting alerts, the last admitted time and the time of the one
    timer that is set. Once nothing waits, the timer is set to the end of the
    cooldown, after which the state is dropped.
    """

    def __init__(self, cooldown_s: int):
        self.cooldown = int(cooldown_s) * 1_000_000

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "us long, load_mw double")
        self.last = handle.getValueState("last", "us long")
        self.timer = handle.getValueState("timer", "ms long")

    def _set_timer(self, ms: int | None) -> None:
        now = self.timer.get()[0] if self.timer.exists() else None
        if now == ms:
            return
        if now is not None:
            self.handle.deleteTimer(now)
            self.timer.clear()
        if ms is not None:
            self.handle.registerTimer(ms)
            self.timer.update((ms,))

    def _release(self, key, watermark_ms: int) -> Iterator[pd.DataFrame]:
        """Decides the alerts up to the watermark; the others wait on."""
        rows = sorted(self.waiting.get(), key=lambda r: (r[0], r[1] is not None, r[1] or 0.0))
        stamps = np.array([r[0] for r in rows], np.int64)
        due = int(np.searchsorted(stamps, watermark_ms * 1000, side="right"))
        last = self.last.get()[0] if self.last.exists() else None
        if due:
            taken = admitted_times(stamps[:due], last, self.cooldown)
            if len(taken):
                last = int(stamps[taken[-1]])
                self.last.update((last,))
                yield pd.DataFrame({"series_id": [key[0]] * len(taken), "ds": pd.to_datetime(stamps[taken], unit="us", utc=True),
                                    "load_mw": [rows[i][1] for i in taken]})
            if due < len(rows):
                self.waiting.put([tuple(r) for r in rows[due:]])
            else:
                self.waiting.clear()
        if due < len(rows):
            self._set_timer(-(-int(stamps[due]) // 1000))
        elif last is not None and last + self.cooldown <= watermark_ms * 1000:
            self.last.clear()                                  # any later alert is beyond the cooldown
            self._set_timer(None)
        elif last is not None:
            self._set_timer(-(-(last + self.cooldown) // 1000))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        earliest = None
        for pdf in rows:
            if len(pdf):
                self.waiting.appendList(list(zip(pdf["us"].tolist(), pdf["load_mw"].tolist())))
                earliest = min(int(pdf["us"].min()), earliest if earliest is not None else int(pdf["us"].min()))
        if earliest is None:
            return
        watermark = timerValues.getCurrentWatermarkInMs()
        if earliest <= watermark * 1000:
            yield from self._release(key, watermark)
            return
        due = -(-earliest // 1000)
        if not self.timer.exists() or self.timer.get()[0] > due:           # an earlier timer comes first and sets the next one
            self._set_timer(due)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.timer.exists() and self.timer.get()[0] == expiredTimerInfo.getExpiryTimeInMs():
            self.timer.clear()                                 # it has fired and is gone
        yield from self._release(key, timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb_state(spark: SparkSession):
    """Streams started inside keep their state in RocksDB, which list state and timers need."""
    before = spark.conf.get(STATE_STORE)
    spark.conf.set(STATE_STORE, ROCKSDB)
    try:
        yield spark
    finally:
        spark.conf.set(STATE_STORE, before)


def stream_admit_alerts(alerts: DataFrame, cooldown_s: int = C.ALERT_COOLDOWN_S, delay: str = "1 hour") -> DataFrame:
    """The admitted alerts ``(series_id, ds, load_mw)``, exact for all rows that come within ``delay``.

    An alert goes out once the watermark passes it, whatever the order of the
    files. Of alerts of one instant the one with the smallest load is first.
    Start the stream inside :func:`rocksdb_state`. A series' alerts of one
    micro-batch go to one task, which keeps (time, load) pairs of the delay
    and one search for each admitted alert; size batches with ``maxFilesPerTrigger``.
    """
    return (
        alerts.withWatermark("ds", delay).where(F.col("ds").isNotNull())
        .select("series_id", "ds", "load_mw", F.unix_micros("ds").alias("us"))
        .groupBy("series_id")
        .transformWithStateInPandas(CooldownProcessor(cooldown_s), ALERT_OUT, "Append", "EventTime")
    )


def stream_dedupe_within_watermark(alerts: DataFrame, cooldown: str = "5 minutes", keys=("series_id",)) -> DataFrame:
    """Built-in de-dupe: drop rows whose ``keys`` repeat while the first one's state lives.

    With ``keys=("series_id",)`` it approximates the cooldown in event time;
    with ``("series_id", "ds")`` it drops replayed copies of the same alert.
    """
    return alerts.withWatermark("ds", cooldown).dropDuplicatesWithinWatermark(list(keys))


# --------------------------------------------------------------------------- R4
LOAD = "series_id STRING, ds TIMESTAMP_NTZ, load DOUBLE, load_mw DOUBLE, temp_c DOUBLE, batch_id BIGINT"
ALERT_LOG = ("series_id STRING, timestamp TIMESTAMP_NTZ, peak_mw DOUBLE, model STRING, schedule ARRAY<STRUCT<priority: INT, zone: STRING, "
             "start: STRING, end: STRING, duration_hrs: DOUBLE, load_mw: DOUBLE>>, batch_id BIGINT")


def forecast_alert_batch(batch: DataFrame, batch_id: int, load_path: str, model_path: str, alert_path: str,
                         hours: int = 24, threshold: float = C.THRESHOLD_MW, state_path: str | None = None,
                         weather: DataFrame | None = None, refit: bool = False) -> None:
    """One micro-batch of the hourly job.

    1. append the batch's closed hours to the load table (partition
       ``batch_id``) with ``load_mw`` and ``temp_c``, the columns that training
       reads; with ``state_path`` the load is rescaled by the moving bounds of
       the sketches kept there, without it it is taken as MW;
    2. with ``state_path``, add the hours to the sums that both models are fitted from;
    3. forecast ``hours`` ahead for the series in the batch from the newest
       additive fit (model table, or with ``refit`` the sums just updated),
       anchored at the series' newest hour;
    4. peak per series, shedding schedule, alert event rows appended to the
       alert log (partition ``batch_id``; a replay overwrites itself).
    """
    from ..models import sums as SU
    from ..models.additive import forecast_additive
    from ..models.store import read_model
    from ..plans.requests import alert_events

    spark = batch.sparkSession
    # read several times below; the stateful source must not run again for each use
    closed = batch.select("series_id", F.col("ds").cast("timestamp_ntz").alias("ds"), "load").persist()
    none = F.lit(None).cast("double")
    bounds = None
    if state_path:
        if closed.isEmpty():
            closed.unpersist()
            return
        update_sketches(closed, batch_id, state_path + "/sketches")
        bounds = sketch_bounds(spark, state_path + "/sketches", batch_id).select("series_id", "_lo", "_hi")
    known = closed.join(bounds, "series_id", "left") if bounds is not None else closed.withColumns({"_lo": none, "_hi": none})
    hours_df = known.withColumn("load_mw", rescaled(F.col("load"), F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi")
    hours_df = attach_weather(hours_df, weather) if weather is not None else hours_df.withColumn("temp_c", temperature_proxy("ds"))
    hours_df = hours_df.select("series_id", "ds", "load", "load_mw", "temp_c")
    write_batch(hours_df, load_path, batch_id)
    hours_df = read_table(spark, load_path, LOAD).where(F.col("batch_id") == int(batch_id)).drop("batch_id")
    if state_path:
        SU.add_batch(hours_df, batch_id, state_path)
    newest = hours_df.groupBy("series_id").agg(F.max("ds").alias("_newest"))
    model = SU.fit_from_sums(spark, state_path, "additive") if refit and state_path else read_model(spark, model_path, "additive")
    model = model.join(newest, "series_id", "inner")
    model = model.withColumn("last_ds", F.greatest("last_ds", "_newest")).drop("_newest")
    forecast = forecast_additive(model, hours, threshold).persist()
    log = alert_events(forecast, threshold)["log"]
    write_batch(log, alert_path, batch_id)
    forecast.unpersist()
    closed.unpersist()


def run_forecast_job(readings: DataFrame, checkpoint: str, load_path: str, model_path: str, alert_path: str,
                     hours: int = 24, threshold: float = C.THRESHOLD_MW, delay: str = "1 hour",
                     available_now: bool = True, interval: str = "1 hour", state_path: str | None = None,
                     weather: DataFrame | None = None, refit: bool = False):
    """Start the hourly job: R1 feeding :func:`forecast_alert_batch` through ``foreachBatch``."""
    hourly = stream_hourly_load(readings, delay)
    writer = hourly.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(
        lambda df, bid: forecast_alert_batch(df, bid, load_path, model_path, alert_path, hours, threshold, state_path, weather, refit))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)
    return writer.start()
