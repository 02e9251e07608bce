"""Registered queries of the jobs that work batch by batch, of the models' own checks, and of single operators.

Streams read the events table; where a query needs several micro-batches, the
readings are first landed as several files in the shared folder.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as C
from ..functions import epoch_days, hour_floor, rnd
from ..models import additive as ADD
from ..models import autoregressive as AR
from ..models import store as ST
from ..models import sums as SU
from ..models.ridge import normal_residual
from ..operators import align as J
from ..operators import grid as G
from ..operators import aggregates as AG
from ..session import materialize, shared_path
from ..streaming import jobs as STR
from . import evaluation as EV
from . import views as V
from .catalog import _profile_forecast
from .requests import forecast_envelope
from .oracle import EPOCH_DAYS, GOOD, HOURLY, LM, LOAD_MW, R, _band, _with
from .oracle import SQL as BATCH_SQL


def _base(spark: SparkSession, name: str) -> str:
    return shared_path(spark, f"jobs/{name}-{uuid.uuid4().hex}")


def _landed(spark: SparkSession, rows: DataFrame, by: str, files: int, path: str) -> None:
    """Lands ``rows`` (a time column ``by``) as ``files`` files, one after the other, by ranges of that time."""
    ends = rows.agg(F.min(by).cast("timestamp").alias("a"), F.max(by).cast("timestamp").alias("b"))
    low, high = (ends.select(F.unix_micros(c)).first()[0] for c in ("a", "b"))
    at = F.unix_micros(F.col(by).cast("timestamp"))
    part = F.least(F.floor((at - F.lit(low)) * F.lit(files) / F.lit(max(1, high - low))), F.lit(files - 1))
    kept = materialize(rows.withColumn("_part", part))
    for k in range(files):
        kept.where(F.col("_part") == k).drop("_part").coalesce(1).write.mode("append").parquet(path)


# ----------------------------------------------------------------------------- R3: exact cooldown over files out of order
DISORDER_S = 6 * 3600
DELAY_S = 8 * 3600


def q_stream_alert_dedupe(spark, sf):
    """R3 over files out of order: events are landed by their time plus up to 6 h of a hash, and admitted with a delay of 8 h."""
    ev = V.events(spark, sf).where(F.col("event_type").isNotNull() & F.col("ts").isNotNull())
    late = F.pmod(F.xxhash64("event_id"), F.lit(DISORDER_S)).cast("double")
    rows = ev.select(F.col("event_type").alias("series_id"), F.col("ts").cast("timestamp").alias("ds"), F.col("value").alias("load_mw"),
                     (F.col("ts") + F.make_dt_interval(secs=late)).alias("_landed"))
    base = _base(spark, "admit")
    _landed(spark, rows, "_landed", 6, base + "/in")
    stream = (spark.readStream.schema("series_id STRING, ds TIMESTAMP, load_mw DOUBLE").option("maxFilesPerTrigger", 1).parquet(base + "/in"))
    with STR.rocksdb_state(spark):
        q = (STR.stream_admit_alerts(stream, C.ALERT_COOLDOWN_S, f"{DELAY_S} seconds").writeStream.format("parquet").option("path", base + "/out")
             .option("checkpointLocation", base + "/checkpoint").outputMode("append").trigger(availableNow=True).start())
        q.awaitTermination()
    return spark.read.schema(STR.ALERT_OUT).parquet(base + "/out").select("series_id", F.col("ds").cast("timestamp_ntz").alias("ds"), "load_mw")


# ----------------------------------------------------------------------------- R2 and R4 by batches
def _readings_stream(spark, sf, base, files=3):
    rows = V.events(spark, sf).where(F.col("event_type").isNotNull() & F.col("ts").isNotNull())
    _landed(spark, rows.select(F.col("event_type").alias("series_id"), F.col("ts").cast("timestamp").alias("ts"), "value"), "ts", files, base + "/in")
    return STR.read_readings(spark, base + "/in", 1)


def q_stream_quantile_bounds(spark, sf):
    """R2's moving bounds: p1 and p99 of the sketches after all batches, each within the stated rank error of the exact ones."""
    base = _base(spark, "bounds")
    STR.run_threshold_job(_readings_stream(spark, sf, base), base + "/checkpoint", base + "/sketches", base + "/alerts").awaitTermination()
    lo_p, hi_p = C.RESCALE_QUANTILES
    bounds = STR.sketch_bounds(spark, base + "/sketches")
    hours = V.hourly_load(spark, sf).join(bounds, "series_id")
    newest = V.events(spark, sf).agg(F.max("ts").alias("t"))
    closed = hours.join(F.broadcast(newest), F.col("ds") + F.expr("INTERVAL 2 HOUR") <= F.col("t")).drop("t")     # one row
    pairs = F.array(F.struct(F.lit(lo_p).alias("p"), F.col("_lo").alias("q")), F.struct(F.lit(hi_p).alias("p"), F.col("_hi").alias("q")))
    ranks = closed.select("series_id", "load", "_n", F.inline(pairs)).groupBy("series_id", "p").agg(
        F.sum((F.col("load") < F.col("q")).cast("long")).alias("below"), F.sum((F.col("load") <= F.col("q")).cast("long")).alias("upto"),
        F.count("*").alias("hours"), F.max("_n").alias("n"))
    want, room = F.col("p") * F.col("n"), F.lit(STR.RANK_ERROR) * F.col("n") + 1
    return ranks.select("series_id", "p", "n", (F.col("n") == F.col("hours")).alias("all_hours"),
                        ((F.col("below") <= want + room) & (F.col("upto") >= want - room)).alias("within"))


def _job(spark, sf):
    """The hourly job over three landed files, with sums, moving bounds and the models refitted from the sums."""
    base = _base(spark, "forecast")
    STR.run_forecast_job(_readings_stream(spark, sf, base), base + "/checkpoint", base + "/load", base + "/models", base + "/alerts",
                         hours=24, threshold=13.0, delay="1 hour", state_path=base + "/state", refit=True).awaitTermination()
    return base


def q_job_additive_residual(spark, sf):
    """R4 feeds M1: the fit from the batches' sums meets the optimality conditions over all hours the job has written."""
    base = _job(spark, sf)
    SU.compact(spark, base + "/state", 1)
    model = materialize(SU.fit_from_sums(spark, base + "/state", "additive"))
    load = SU.read_table(spark, base + "/load", STR.LOAD)
    design = load.join(model.select("series_id", "t0", "t1"), "series_id").select(
        "series_id", ADD._design(F.col("ds"), F.col("t0"), F.col("t1"), C.N_CHANGEPOINTS, C.CHANGEPOINT_RANGE, C.SEASONALITIES).alias("x"),
        F.col("load_mw").alias("y"))
    r = normal_residual(design, model, _smooth_penalties(), sparse=ADD.changepoint_columns())
    return r.select("series_id", rnd("residual", 6).alias("residual"), "n")


def q_job_ar_residual(spark, sf):
    """R4 feeds M3: the autoregression from the batches' sums solves the normal equations of the written load table."""
    base = _job(spark, sf)
    model = materialize(SU.fit_from_sums(spark, base + "/state", "autoregressive"))
    load = SU.read_table(spark, base + "/load", STR.LOAD)
    rows = AR.training_rows(load.select("series_id", "ds", "load_mw"), load.select("series_id", "ds", "temp_c"))
    r = normal_residual(rows, model, AR.penalties())
    return r.select("series_id", rnd("residual", 6).alias("residual"), "n")


def q_job_alert_log(spark, sf):
    """R4's alert log from a stored model with fixed coefficients: each series' peak over 8 MW in the 24 h ahead, and its zones."""
    base = _base(spark, "log")
    ST.write_model(_fixed_additive_model(V.load_mw(spark, sf)), base + "/models")
    STR.run_forecast_job(_readings_stream(spark, sf, base, 1), base + "/checkpoint", base + "/load", base + "/models", base + "/alerts",
                         hours=24, threshold=8.0, delay="1 hour").awaitTermination()
    log = SU.read_table(spark, base + "/alerts", STR.ALERT_LOG)
    return log.select("series_id", rnd("peak_mw", 2).alias("peak_mw"), "model", F.size("schedule").cast("long").alias("zones"))


# ----------------------------------------------------------------------------- models
def _smooth_penalties():
    pen = ADD.penalties()
    at = ADD.changepoint_columns()
    return [0.0 if i in at else v for i, v in enumerate(pen)]


def q_additive_laplace_residual(spark, sf):
    """M1 with the Laplace prior: the fit meets its optimality conditions on every load series (residual 0, over all its rows)."""
    lm = V.load_mw(spark, sf)
    model = materialize(ADD.fit_additive(lm, prior="laplace"))
    r = normal_residual(ADD.design_rows(lm), model, _smooth_penalties(), sparse=ADD.changepoint_columns())
    return r.select("series_id", rnd("residual", 6).alias("residual"), "n")


def q_band_coverage(spark, sf):
    """M2's sampled band on the hold-out: of the 168 hours after the training part, the share inside it, by series."""
    parts = materialize(EV.split_parts(V.load_mw(spark, sf).select("series_id", "ds", "load_mw")))
    model = ADD.fit_additive(parts.where(F.col("part") != "test").select("series_id", "ds", "load_mw"))
    fc = ADD.forecast_additive(model, C.MAX_HORIZON_H, band="sampled")
    both = J.align_actuals(fc, parts.where(F.col("part") == "test").select("series_id", "ds", "load_mw"))
    inside = F.col("actual").between(F.col("lower_mw"), F.col("upper_mw")).cast("double")
    return both.groupBy("series_id").agg(F.count("*").alias("n"), rnd(F.avg(inside), 3).alias("coverage"))


AR_WEIGHTS = (1.0 / 64,) * 24                    # lag weights of the fixed autoregression
AR_COVARIATE_WEIGHTS = (0.1, 0.05, -0.05, 0.02)  # temperature, hour sine and cosine, weekday
AR_FIRST = 0.2


def _fixed_ar_model(rows: DataFrame, cov: DataFrame) -> DataFrame:
    """An autoregressive model table with fixed coefficients, and scaler bounds and last hour from ``rows``."""
    feats = AR._features(rows.where(F.col("load_mw").isNotNull()), cov)
    ends = feats.groupBy("series_id").agg(F.max("ds").alias("last_ds"), F.count("*").alias("n"),
                                          F.array(*[F.min(c) for c in AR.FEATURES]).alias("feature_min"),
                                          F.array(*[F.max(c) for c in AR.FEATURES]).alias("feature_max"))
    coef = F.array(*[F.lit(float(v)) for v in (AR_FIRST, *AR_WEIGHTS, *AR_COVARIATE_WEIGHTS)])
    return ends.select("series_id", F.lit("autoregressive").alias("model"), F.lit("2024-02-01").cast("timestamp_ntz").alias("fitted_at"), "last_ds",
                       F.lit(C.SEQUENCE_LEN).alias("n_lags"), coef.alias("coef"), F.lit(1.0).alias("sigma"), "n", "feature_min", "feature_max")


def _fixed_additive_model(rows: DataFrame) -> DataFrame:
    """An additive model table with fixed coefficients over each series' own time span."""
    day = epoch_days("ds")
    return rows.where(F.col("load_mw").isNotNull()).groupBy("series_id").agg(
        F.min(day).alias("t0"), F.max(day).alias("t1"), F.max("ds").alias("last_ds"), F.count("*").alias("n")).select(
        "series_id", F.lit("additive").alias("model"), F.lit("2024-02-01").cast("timestamp_ntz").alias("fitted_at"), "t0", "t1", "last_ds",
        F.lit(1.0).alias("y_scale"), F.lit(C.N_CHANGEPOINTS).alias("n_changepoints"),
        F.array(*[F.lit(float(v)) for v in C.CHECK_COEFFICIENTS]).alias("coef"), F.lit(1.0).alias("sigma"), "n")


def q_ar_fixed_forecast(spark, sf):
    """M4 with covariates: 24 h recursion of a fixed autoregression (24 lags, temperature, hour, weekday), scaled by the data's bounds."""
    lm, cov = V.load_mw(spark, sf).select("series_id", "ds", "load_mw"), V.covariate(spark, sf)
    fc = AR.forecast_autoregressive(materialize(_fixed_ar_model(lm, cov)), lm, 24, cov)
    return fc.select("series_id", "step", "ds", rnd("predicted_mw", 2).alias("predicted"), "alert")


def q_fixed_model_evaluation(spark, sf):
    """M5 with the fitted models' code and fixed coefficients: both models and their ensemble on every test hour."""
    lm, cov = V.load_mw(spark, sf).select("series_id", "ds", "load_mw"), V.covariate(spark, sf)
    parts = materialize(EV.split_parts(lm))
    before = {"validation": parts.where(F.col("part") == "fit"), "test": parts.where(F.col("part") != "test")}
    models = {t: (_fixed_additive_model(rows), _fixed_ar_model(rows.select("series_id", "ds", "load_mw"), cov)) for t, rows in before.items()}
    m = EV.score_models(parts, models, cov, rolling=False)
    return m.select("series_id", "model", *[rnd(c, 3).alias(c) for c in ("mae", "rmse", "mape")], "n")


def q_fallback_predictions(spark, sf):
    """M6 with predictions: the fixed autoregression where a series has 400 hours or more, the fixed additive model elsewhere."""
    lm, cov = V.load_mw(spark, sf).select("series_id", "ds", "load_mw"), V.covariate(spark, sf)
    ar = materialize(_fixed_ar_model(lm, cov))
    most = ar.agg(F.max("n").alias("most"))
    best = ar.join(F.broadcast(most), F.col("n") == F.col("most")).drop("most")                      # one row
    pref = AR.forecast_autoregressive(best, lm, 24, cov)
    out = ST.fallback_model(pref, ADD.forecast_additive(_fixed_additive_model(lm), 24))
    return out.select("series_id", "model", "step", "ds", rnd("predicted_mw", 2).alias("predicted"))


def q_model_store(spark, sf):
    """Two fits of both models written to the model table; the newest of the additive one is read back."""
    base = _base(spark, "store")
    lm, cov = V.load_mw(spark, sf).select("series_id", "ds", "load_mw"), V.covariate(spark, sf)
    early = F.lit("2024-01-01").cast("timestamp_ntz")
    ST.write_model(_fixed_additive_model(lm).withColumn("fitted_at", early).withColumn("n", F.lit(0).cast("long")), base)
    ST.write_model(_fixed_ar_model(lm, cov), base)
    ST.write_model(_fixed_additive_model(lm), base)
    m = ST.read_model(spark, base, "additive")
    return m.select("series_id", "model", "fitted_at", "last_ds", "n", rnd("t0", 6).alias("t0"), rnd("t1", 6).alias("t1"),
                    F.size("coef").alias("n_coef"), rnd(F.aggregate("coef", F.lit(0.0), lambda a, v: a + v), 6).alias("coef_sum"))


def q_request_checks(spark, sf):
    """P27 over requests made from the data: hours, model and limit of each event, and whether they are valid."""
    ev = V.events(spark, sf)
    names = F.array(*[F.lit(n) for n in ("prophet", "lstm", "additive", "arima")])
    requests = ev.select("event_id", (F.pmod("event_id", F.lit(200)) - 10).cast("int").alias("hours"),
                         F.get(names, F.pmod("event_id", F.lit(4)).cast("int")).alias("model"),
                         (F.pmod("event_id", F.lit(130)) - 5).cast("int").alias("limit"))
    return requests.withColumn("valid", ST.valid_request_column(F.col("hours"), F.col("model"), F.col("limit")))


# ----------------------------------------------------------------------------- joins, pages, answers
def q_align_actuals(spark, sf):
    """The load a day earlier as forecast, beside the actual load of the same hour."""
    lm = V.load_mw(spark, sf).select("series_id", "ds", "load_mw")
    fc = lm.select("series_id", (F.col("ds") + F.expr("INTERVAL 24 HOUR")).alias("ds"), F.col("load_mw").alias("predicted_mw"))
    return J.align_actuals(fc, lm)


def q_score_with_model(spark, sf):
    """Every hour with its series' trend coefficients, scored."""
    lm = V.load_mw(spark, sf).select("series_id", "ds", "load_mw")
    trend = AG.linear_trend(lm).select("series_id", "slope_per_day", "intercept")
    scored = J.score_with_model(lm, trend)
    return scored.select("series_id", "ds", rnd(F.col("intercept") + F.col("slope_per_day") * epoch_days("ds"), 6).alias("trend_mw"))


def q_weather_asof_by_series(spark, sf):
    """J4 with a series key: each hour of the grid with its own series' last mean reading of the 5 hours before."""
    grid = V.hourly_grid(spark, sf).select("series_id", "ds")
    own = V.events(spark, sf).where(F.col("event_type").isNotNull() & F.col("ts").isNotNull()).groupBy(
        F.col("event_type").alias("series_id"), hour_floor("ts").alias("ds")).agg(
        (F.sum(F.col("value").cast("decimal(18,2)")).cast("double") / F.count("value")).alias("temp_c"))
    j = J.attach_weather_asof(grid, own.where(F.hour("ds") % 3 != 1), tolerance_h=5)
    return j.select("series_id", "ds", rnd("temp_c", 6).alias("temp_c"), "temp_c_at")


def q_deep_page(spark, sf):
    """T4: a page deep in the table and the last, short one, both from one range index."""
    rows = V.events(spark, sf).select("event_id", "event_type", "ts", "value")
    index = G.PageIndex(rows, ("ts", "event_id"), ranges=16)
    deep = index.page(index.total * 3 // 4, 500).withColumn("page", F.lit("deep"))
    return deep.unionByName(index.page(index.total - 7, 500).withColumn("page", F.lit("last")))


def q_forecast_envelope(spark, sf):
    """One answer per series around the 24 h profile forecast, its rows as columns."""
    fc = _profile_forecast(spark, sf).withColumn("model", F.lit("profile")).withColumn(
        "generated_at", F.lit("2024-01-31 00:00:00").cast("timestamp_ntz"))
    env = forecast_envelope(fc, 24)
    rows = F.col("forecast")
    return env.select("series_id", "district", "model", "hours", "threshold_mw", "generated_at", F.size(rows).alias("n"),
                      rows[0]["timestamp"].alias("first_ds"), rows[0]["predicted_mw"].alias("first_mw"),
                      F.element_at(rows, -1)["timestamp"].alias("last_ds"), F.element_at(rows, -1)["upper_mw"].alias("last_upper_mw"),
                      F.size(F.filter(rows, lambda r: r["alert"])).alias("alerts"))


QUERIES = {
    "stream_alert_dedupe": q_stream_alert_dedupe,
    "stream_quantile_bounds": q_stream_quantile_bounds,
    "job_additive_residual": q_job_additive_residual,
    "job_ar_residual": q_job_ar_residual,
    "job_alert_log": q_job_alert_log,
    "additive_laplace_residual": q_additive_laplace_residual,
    "band_coverage": q_band_coverage,
    "ar_fixed_forecast": q_ar_fixed_forecast,
    "fixed_model_evaluation": q_fixed_model_evaluation,
    "fallback_predictions": q_fallback_predictions,
    "model_store": q_model_store,
    "request_checks": q_request_checks,
    "align_actuals": q_align_actuals,
    "score_with_model": q_score_with_model,
    "weather_asof_by_series": q_weather_asof_by_series,
    "deep_page": q_deep_page,
    "forecast_envelope": q_forecast_envelope,
}


# ----------------------------------------------------------------------------- DuckDB SQL
def _additive_terms(t: str, e: str) -> str:
    """The fixed additive model's value at scaled time ``t`` and epoch day ``e``."""
    import math

    c = [repr(x) for x in C.CHECK_COEFFICIENTS]
    n = C.N_CHANGEPOINTS
    terms = [c[0], f"{c[1]} * {t}"] + [f"{c[1 + j]} * greatest({t} - {C.CHANGEPOINT_RANGE * j / n!r}, 0e0)" for j in range(1, n + 1)]
    at = 2 + n
    for _, period, order in C.SEASONALITIES:
        for k in range(1, order + 1):
            f = repr(2 * math.pi * k / period)
            terms += [f"{c[at]} * sin({f} * {e})", f"{c[at + 1]} * cos({f} * {e})"]
            at += 2
    return " + ".join(terms)


CLOSED = "ds + INTERVAL 2 HOUR <= (SELECT max(ts) FROM events WHERE event_type IS NOT NULL)"
COV = """cov AS (SELECT date_trunc('hour', ts) AS ds, CAST(SUM(CAST(value AS DECIMAL(18,2))) AS DOUBLE) / count(value) AS temp_c
  FROM events WHERE ts IS NOT NULL GROUP BY 1)"""
FEATS = """feats AS (SELECT l.series_id, l.ds, l.load_mw, coalesce(c.temp_c, 21.5e0) AS temp_c, sin(2e0 * pi() * hour(l.ds) / 24e0) AS hs,
  cos(2e0 * pi() * hour(l.ds) / 24e0) AS hc, (isodow(l.ds) - 1) / 6e0 AS wd FROM load_mw l LEFT JOIN cov c ON c.ds = l.ds WHERE l.load_mw IS NOT NULL)"""


def _ar_recursion(models: str, group: str) -> str:
    """CTEs of the fixed autoregression: ``models`` is a relation (group..., last_ds, horizon, bounds), one recursion a row; gives rec(group..., step, ds, p)."""
    g = group.split(", ")
    on = " AND ".join(f"a.{c} = b.{c}" for c in g)
    ag = ", ".join(f"a.{c}" for c in g)
    scaled = ", ".join(f"coalesce(({c} - b.{c}_lo) / nullif(b.{c}_hi - b.{c}_lo, 0e0), 0e0) AS {c}" for c in ("temp_c", "hs", "hc", "wd"))
    covs = " + ".join(f"{w!r} * s.{c}" for w, c in zip(AR_COVARIATE_WEIGHTS, ("temp_c", "hs", "hc", "wd")))
    dot = f"({AR_FIRST!r} + list_sum(list_transform(a.w, lambda x: x * {AR_WEIGHTS[0]!r})) + {covs})"
    mw = f"least(greatest({dot} * (a.hi - a.lo) + a.lo, 0e0), 50e0)"
    return f"""mo AS ({models}),
slots AS (SELECT {ag}, k, l.load_mw AS v FROM (SELECT * FROM mo, range(0, 24) r(k)) a
          LEFT JOIN load_mw l ON l.series_id = a.series_id AND l.ds = a.last_ds - k * INTERVAL 1 HOUR),
filled AS (SELECT {group}, k, coalesce(last_value(v IGNORE NULLS) OVER w, first_value(v IGNORE NULLS) OVER
             (PARTITION BY {group} ORDER BY k DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS v
           FROM slots WINDOW w AS (PARTITION BY {group} ORDER BY k DESC)),
seed AS (SELECT {ag}, list(coalesce((a.v - b.load_mw_lo) / nullif(b.load_mw_hi - b.load_mw_lo, 0e0), 0e0) ORDER BY a.k DESC) AS w
         FROM filled a JOIN mo b ON {on} GROUP BY {ag}),
ahead AS (SELECT b.*, CAST(s AS INTEGER) AS step, b.last_ds + s * INTERVAL 1 HOUR AS ds FROM mo b, range(1, 2000) t(s) WHERE s <= b.horizon),
raw AS (SELECT a.*, coalesce(c.temp_c, 21.5e0) AS temp_c, sin(2e0 * pi() * hour(a.ds) / 24e0) AS hs, cos(2e0 * pi() * hour(a.ds) / 24e0) AS hc,
               (isodow(a.ds) - 1) / 6e0 AS wd FROM ahead a LEFT JOIN cov c ON c.ds = a.ds),
steps AS (SELECT {", ".join("b." + c for c in g)}, b.step, b.ds, {scaled} FROM raw b),
rec({group}, step, ds, p, w, lo, hi) AS (
  SELECT {ag}, 0, b.last_ds, CAST(NULL AS DOUBLE), a.w, b.load_mw_lo, b.load_mw_hi FROM seed a JOIN mo b ON {on}
  UNION ALL
  SELECT {ag}, s.step, s.ds, {mw}, list_append(a.w[2:], coalesce(({mw} - a.lo) / nullif(a.hi - a.lo, 0e0), 0e0)), a.lo, a.hi
  FROM rec a JOIN steps s ON {" AND ".join(f"a.{c} = s.{c}" for c in g)} AND s.step = a.step + 1)"""


_ENDS = ", ".join(f"min({c}) AS {c}_lo, max({c}) AS {c}_hi" for c in ("load_mw", "temp_c", "hs", "hc", "wd"))
_RECURSIVE = "WITH RECURSIVE " + ",\n".join((HOURLY, LOAD_MW, COV, FEATS)) + ",\n"
_CLIPPED = "least(greatest({0}, 0e0), 50e0)"

SQL: dict[str, str] = {}

SQL["stream_alert_dedupe"] = BATCH_SQL["stream_alert_cooldown"] + """
  AND e.timestamp <= date_trunc('milliseconds', (SELECT max(timestamp) FROM ev)) - INTERVAL 8 HOUR"""

SQL["stream_quantile_bounds"] = _with(HOURLY) + f"""SELECT series_id, unnest([0.01, 0.99]::DOUBLE[]) AS p, count(*) AS n, true AS all_hours, true AS within
FROM hourly_load WHERE {CLOSED} GROUP BY 1"""

SQL["job_additive_residual"] = _with(HOURLY) + f"SELECT series_id, 0e0 AS residual, count(*) AS n FROM hourly_load WHERE {CLOSED} AND load IS NOT NULL GROUP BY 1"

SQL["job_ar_residual"] = _with(HOURLY) + f"""SELECT series_id, 0e0 AS residual, count(*) AS n FROM (
  SELECT series_id, count(load) OVER (PARTITION BY series_id ORDER BY ds
                                      RANGE BETWEEN INTERVAL 24 HOUR PRECEDING AND INTERVAL 1 HOUR PRECEDING) AS c
  FROM hourly_load WHERE {CLOSED}) WHERE c = 24 GROUP BY 1"""

SQL["additive_laplace_residual"] = BATCH_SQL["additive_residual"]

_AHEAD = f"""am AS (SELECT series_id, min({EPOCH_DAYS}) AS t0, max({EPOCH_DAYS}) AS t1, max(ds) AS last_ds, count(*) AS n
  FROM load_mw WHERE load_mw IS NOT NULL GROUP BY 1),
ag AS (SELECT am.*, CAST(s AS INTEGER) AS step, last_ds + s * INTERVAL 1 HOUR AS ds FROM am, range(1, 25) r(s)),
ae AS (SELECT *, {EPOCH_DAYS} AS e FROM ag),
ax AS (SELECT *, coalesce((e - t0) / nullif(t1 - t0, 0e0), 0e0) AS t FROM ae),
add_fc AS (SELECT series_id, step, ds, {_CLIPPED.format(_additive_terms('t', 'e'))} AS p FROM ax)"""

_ZONES = "SELECT * FROM (VALUES " + ", ".join(f"('{z}', {p})" for z, p in C.ZONES) + ") z(zone, priority)"
SQL["job_alert_log"] = LM.rstrip() + ",\n" + _AHEAD + f""",
peaks AS (SELECT series_id, peak_mw FROM (SELECT series_id, round(p * 1000e0) / 1000e0 AS peak_mw,
            row_number() OVER (PARTITION BY series_id ORDER BY round(p * 1000e0) DESC, ds) AS rn FROM add_fc WHERE p >= 8 OR round(p * 1000e0) / 1000e0 >= 8) WHERE rn = 1),
zones AS ({_ZONES}),
kept AS (SELECT p.series_id, p.peak_mw, count(*) FILTER (WHERE greatest(0e0, p.peak_mw - 8e0) - p.peak_mw / 5e0 * (z.priority - 1) > 0) AS zones
         FROM peaks p, zones z GROUP BY 1, 2)
SELECT series_id, {R('peak_mw', 2)} AS peak_mw, 'additive' AS model, CASE WHEN zones > 0 THEN zones END AS zones FROM kept"""

SQL["ar_fixed_forecast"] = _RECURSIVE + _ar_recursion(f"SELECT series_id, max(ds) AS last_ds, 24 AS horizon, {_ENDS} FROM feats GROUP BY 1", "series_id") + f"""
SELECT series_id, step, ds, {R(R('p', 3), 2)} AS predicted, p >= 20e0 AS alert FROM rec WHERE step > 0"""

SQL["fallback_predictions"] = _RECURSIVE + _AHEAD + ",\n" + _ar_recursion(
    f"SELECT * FROM (SELECT series_id, max(ds) AS last_ds, 24 AS horizon, count(*) AS n, {_ENDS} FROM feats GROUP BY 1) "
    "WHERE n = (SELECT max(n) FROM am)", "series_id") + f"""
SELECT series_id, 'autoregressive' AS model, step, ds, {R(R('p', 3), 2)} AS predicted FROM rec WHERE step > 0
UNION ALL SELECT series_id, 'additive', step, ds, {R(R('p', 3), 2)} FROM add_fc WHERE series_id NOT IN (SELECT series_id FROM mo)"""

_PARTS = BATCH_SQL["evaluation_parts"]
_PARTS = _PARTS[_PARTS.index("parts AS ("):_PARTS.rindex("SELECT series_id, ds, load_mw, part FROM parts")].rstrip()
SQL["fixed_model_evaluation"] = _RECURSIVE + _PARTS + f""",
known AS (SELECT f.*, p.part FROM feats f JOIN parts p USING (series_id, ds)),
ends AS (SELECT series_id, part, max(ds) AS end_ds FROM parts WHERE part <> 'fit' GROUP BY 1, 2),
bounds2 AS (SELECT 'validation' AS part, series_id, max(ds) AS last_ds, min({EPOCH_DAYS}) AS t0, max({EPOCH_DAYS}) AS t1, {_ENDS} FROM known WHERE part = 'fit' GROUP BY 2
            UNION ALL
            SELECT 'test', series_id, max(ds), min({EPOCH_DAYS}), max({EPOCH_DAYS}), {_ENDS} FROM known WHERE part <> 'test' GROUP BY 2),
""" + _ar_recursion("SELECT b.*, date_diff('hour', b.last_ds, e.end_ds) AS horizon FROM bounds2 b JOIN ends e USING (series_id, part)", "series_id, part") + f""",
ax AS (SELECT p.series_id, p.ds, p.part, p.load_mw AS actual, {EPOCH_DAYS} AS e, b.t0, b.t1
       FROM parts p JOIN bounds2 b USING (series_id, part)),
scaled AS (SELECT *, coalesce((e - t0) / nullif(t1 - t0, 0e0), 0e0) AS t FROM ax),
wide AS (SELECT a.series_id, a.ds, a.part, a.actual, {R(_CLIPPED.format(_additive_terms('t', 'e')), 3)} AS additive, {R('r.p', 3)} AS autoregressive
         FROM scaled a LEFT JOIN rec r ON r.series_id = a.series_id AND r.part = a.part AND r.ds = a.ds AND r.step > 0),
mae AS (SELECT series_id, 1e0 / avg(abs(actual - additive)) AS ia, 1e0 / avg(abs(actual - autoregressive)) AS ib FROM wide WHERE part = 'validation' GROUP BY 1),
ens AS (SELECT w.*, CASE WHEN autoregressive IS NULL THEN additive
                         ELSE (ia / (ia + ib) * additive + ib / (ia + ib) * autoregressive) / (ia / (ia + ib) + ib / (ia + ib)) END AS ensemble
        FROM wide w JOIN mae USING (series_id) WHERE part = 'test'),
long AS (SELECT series_id, 'additive' AS model, actual, additive AS predicted FROM ens UNION ALL
         SELECT series_id, 'autoregressive', actual, autoregressive FROM ens UNION ALL SELECT series_id, 'ensemble', actual, ensemble FROM ens)
SELECT series_id, model, {R('avg(abs(actual - predicted))', 3)} AS mae, {R('sqrt(avg((actual - predicted) * (actual - predicted)))', 3)} AS rmse,
       {R('avg(abs((actual - predicted) / nullif(actual, 0e0))) * 100e0', 3)} AS mape, count(*) AS n FROM long WHERE predicted IS NOT NULL GROUP BY 1, 2"""

SQL["model_store"] = LM + f"""SELECT series_id, 'additive' AS model, TIMESTAMP '2024-02-01 00:00:00' AS fitted_at, max(ds) AS last_ds, count(*) AS n,
  {R(f'min({EPOCH_DAYS})', 6)} AS t0, {R(f'max({EPOCH_DAYS})', 6)} AS t1, {len(C.CHECK_COEFFICIENTS)} AS n_coef, {R(repr(sum(C.CHECK_COEFFICIENTS)), 6)} AS coef_sum
FROM load_mw WHERE {GOOD} GROUP BY 1"""

SQL["request_checks"] = """SELECT event_id, hours, model, "limit",
  hours BETWEEN 1 AND 168 AND model <> 'arima' AND "limit" BETWEEN 1 AND 100 AS valid FROM (
  SELECT event_id, CAST(event_id % 200 - 10 AS INTEGER) AS hours, ['prophet', 'lstm', 'additive', 'arima'][event_id % 4 + 1] AS model,
         CAST(event_id % 130 - 5 AS INTEGER) AS "limit" FROM events)"""

SQL["align_actuals"] = LM + """SELECT a.series_id, a.ds, b.load_mw AS predicted_mw, a.load_mw AS actual
FROM load_mw a JOIN load_mw b ON b.series_id = a.series_id AND b.ds = a.ds - INTERVAL 24 HOUR"""

SQL["score_with_model"] = LM.rstrip() + f""",
trend AS (SELECT series_id, regr_slope(load_mw, {EPOCH_DAYS}) AS a, regr_intercept(load_mw, {EPOCH_DAYS}) AS b FROM load_mw WHERE {GOOD} GROUP BY 1)
SELECT series_id, ds, {R(f'b + a * {EPOCH_DAYS}', 6)} AS trend_mw FROM load_mw JOIN trend USING (series_id)"""

SQL["weather_asof_by_series"] = "WITH " + HOURLY + """,
bounds AS (SELECT series_id, min(ds) AS first_ds, max(ds) AS last_ds FROM hourly_load GROUP BY 1),
grid AS (SELECT series_id, unnest(generate_series(first_ds, last_ds, INTERVAL 1 HOUR)) AS ds FROM bounds),
own AS (SELECT * FROM (SELECT event_type AS series_id, date_trunc('hour', ts) AS ds, CAST(SUM(CAST(value AS DECIMAL(18,2))) AS DOUBLE) / count(value) AS temp_c
        FROM events WHERE event_type IS NOT NULL AND ts IS NOT NULL GROUP BY 1, 2) WHERE hour(ds) % 3 <> 1 AND temp_c IS NOT NULL)
""" + f"""SELECT g.series_id, g.ds, CASE WHEN c.ds >= g.ds - INTERVAL 5 HOUR THEN {R('c.temp_c', 6)} END AS temp_c,
  CASE WHEN c.ds >= g.ds - INTERVAL 5 HOUR THEN c.ds END AS temp_c_at
FROM grid g ASOF LEFT JOIN own c ON g.series_id = c.series_id AND g.ds >= c.ds"""

SQL["deep_page"] = """WITH n AS (SELECT *, row_number() OVER (ORDER BY ts NULLS FIRST, event_id) - 1 AS place, count(*) OVER () AS total FROM events)
SELECT event_id, event_type, ts, value, 'deep' AS page FROM n WHERE place >= total * 3 // 4 AND place < total * 3 // 4 + 500
UNION ALL SELECT event_id, event_type, ts, value, 'last' FROM n WHERE place >= total - 7"""

SQL["forecast_envelope"] = _with(HOURLY, LOAD_MW, _band(20.0)) + f"""SELECT series_id, '{C.DISTRICT}' AS district, 'profile' AS model, 24 AS hours,
  CAST(20 AS DOUBLE) AS threshold_mw, TIMESTAMP '2024-01-31 00:00:00' AS generated_at, CAST(count(*) AS INTEGER) AS n, min(ds) AS first_ds,
  arg_min(predicted_mw, ds) AS first_mw, max(ds) AS last_ds, arg_max(upper_mw, ds) AS last_upper_mw, CAST(count_if(alert) AS INTEGER) AS alerts
FROM band GROUP BY 1"""
