"""Model evaluation (M5) with two SQL-checkable forecasters.

Per series, rows in time order are split by position: the first
``int(n * 0.8)`` rows are training, the rest test; the last 10% of the
training rows are validation and the rest "fit".

* ``seasonal_naive`` predicts the value 24 hours earlier (matched by time,
  not by position: a range frame of exactly -24 hours).
* ``profile`` predicts the fit-part mean by (hour, weekday).
* ``ensemble`` combines them with inverse-MAE weights measured on the
  validation part (not on the test rows it is scored on), hour by hour.

All three are scored on the same test hours (those where both base models
have a prediction). The split times are selected by counting, the profile is
a grouped mean, and the value a day before comes from blocks of hours, so no
step gathers a series.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from ..functions import add_hours, epoch_hours, exact_mean, weekday0
from ..operators.align import align_actuals
from ..operators.grid import BLOCK_H, overlapping_blocks
from ..operators.metrics import error_metrics, error_weights
from ..operators.windows import times_at

MODELS = ("seasonal_naive", "profile", "ensemble")


def split_parts(df: DataFrame, value: str = "load_mw", test_ratio: float = C.TEST_RATIO,
                val_ratio: float = C.VALIDATION_RATIO, key: str = "series_id", ts: str = "ds") -> DataFrame:
    """Label each row ``fit``, ``validation`` or ``test`` by its position in the series."""
    rows = df.where(F.col(value).isNotNull())

    def train_end(n):
        return F.floor(n * F.lit(1.0 - test_ratio))

    cuts = times_at(rows, {"_fit": lambda n: F.floor(train_end(n) * F.lit(1.0 - val_ratio)), "_train": train_end}, key, ts)
    return rows.join(cuts, key).withColumn(
        "part", F.when(F.col(ts) <= F.col("_fit"), "fit").when(F.col(ts) <= F.col("_train"), "validation").otherwise("test")).drop("_fit", "_train")


def wide_predictions(df: DataFrame, value: str = "load_mw", key: str = "series_id", ts: str = "ds") -> DataFrame:
    """``(series_id, ds, part, actual, seasonal_naive, profile)`` for every row of the series."""
    parts = split_parts(df, value, key=key, ts=ts)
    slot = [key, F.hour(ts).alias("_hour"), weekday0(ts).alias("_weekday")]
    profile = parts.where(F.col("part") == "fit").groupBy(*slot).agg(exact_mean(value).alias("profile"))
    day_before = Window.partitionBy(key, "_block").orderBy(epoch_hours(ts)).rangeBetween(-24, -24)
    rows = overlapping_blocks(parts, 24, BLOCK_H, ts).withColumn("seasonal_naive", F.first(value).over(day_before)).where("_mine")
    return rows.withColumn("_hour", F.hour(ts)).withColumn("_weekday", weekday0(ts)).join(profile, [key, "_hour", "_weekday"], "left").select(
        key, ts, "part", F.col(value).alias("actual"), "seasonal_naive", "profile")


def _long(df: DataFrame, models, key: str, ts: str) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).alias("predicted")) for m in models])
    return df.select(key, ts, "part", "actual", F.inline(pairs))


def model_predictions(df: DataFrame, value: str = "load_mw", key: str = "series_id", ts: str = "ds") -> DataFrame:
    """Long table ``(series_id, ds, part, actual, model, predicted)`` of both base models, non-fit rows."""
    wide = wide_predictions(df, value, key, ts).where(F.col("part") != "fit")
    return _long(wide, MODELS[:2], key, ts)


def scored_wide(df: DataFrame, value: str = "load_mw", key: str = "series_id", ts: str = "ds") -> DataFrame:
    """Common evaluation rows (both base models present) with the ensemble column and weights."""
    wide = wide_predictions(df, value, key, ts)
    common = wide.where((F.col("part") != "fit") & F.col("seasonal_naive").isNotNull() & F.col("profile").isNotNull())
    val = F.col("part") == "validation"
    mae = common.groupBy(key).agg(*[F.avg(F.when(val, F.abs(F.col("actual") - F.col(m)))).alias(f"_{m}") for m in MODELS[:2]])
    wa, wb = error_weights(*[F.col(f"_{m}") for m in MODELS[:2]])
    weights = mae.select(key, wa.alias("w_seasonal_naive"), wb.alias("w_profile"))
    a, b = F.col("w_seasonal_naive"), F.col("w_profile")
    ens = F.try_divide(a * F.col("seasonal_naive") + b * F.col("profile"), a + b)
    return common.join(weights, key).withColumn("ensemble", ens)


def evaluate(df: DataFrame, value: str = "load_mw", key: str = "series_id", ts: str = "ds") -> DataFrame:
    """``(series_id, model, mae, rmse, mape, n)`` for the three models on the test part."""
    test = scored_wide(df, value, key, ts).where(F.col("part") == "test")
    return error_metrics(_long(test, MODELS, key, ts), (key, "model"))


def ensemble_weights(df: DataFrame, value: str = "load_mw", key: str = "series_id", ts: str = "ds") -> DataFrame:
    """Validation-part inverse-MAE weights of the two base models, one row per (series, model)."""
    wide = wide_predictions(df, value, key, ts)
    val = wide.where((F.col("part") == "validation") & F.col("seasonal_naive").isNotNull() & F.col("profile").isNotNull())
    mae = val.groupBy(key).agg(*[F.avg(F.abs(F.col("actual") - F.col(m))).alias(m) for m in MODELS[:2]])
    weights = error_weights(*[F.col(m) for m in MODELS[:2]])
    pairs = F.array(*[F.struct(F.lit(m).alias("model"), w.alias("weight")) for m, w in zip(MODELS[:2], weights)])
    return mae.select(key, F.inline(pairs))


FITTED = ("additive", "autoregressive")


def fit_before(parts: DataFrame, weather: DataFrame | None = None) -> dict[str, tuple[DataFrame, DataFrame]]:
    """Both models for the two parts that are predicted: from the rows before validation, and from those before test.

    ``parts`` is (series_id, ds, load_mw, part). The normal equations of the
    fit and of the validation rows are added up once; the second pair of
    models comes from both sums, without another pass over the rows. Both
    additive models run over the time span of all training rows.
    """
    from ..models import sums as SU
    from ..models.autoregressive import feature_bounds, lagged_sums, solve_autoregressive, with_temperature
    from ..session import materialize

    known = with_temperature(parts.where((F.col("part") != "test") & F.col("load_mw").isNotNull()), weather)
    frames = feature_bounds(known)
    additive = SU.additive_sums(known, frames, carry=["part"]).withColumn("model", F.lit("additive"))
    lagged = lagged_sums(known, part="part").withColumn("model", F.lit("autoregressive"))
    entries = materialize(additive.unionByName(lagged).groupBy("model", "series_id", "part", "i").agg(F.sum("v").alias("v")))
    fit_bounds = feature_bounds(known.where(F.col("part") == "fit")).drop("t0", "t1").join(frames.select("series_id", "t0", "t1"), "series_id")
    out = {}
    for target, bounds, which in (("validation", fit_bounds, F.col("part") == "fit"), ("test", frames, F.lit(True))):
        rows = entries.where(which)
        add, auto = (rows.where(F.col("model") == m).select("series_id", "i", "v") for m in FITTED)
        out[target] = (SU.solve_additive(add, bounds), solve_autoregressive(auto, bounds))
    return out


def score_models(parts: DataFrame, models: dict[str, tuple[DataFrame, DataFrame]], weather: DataFrame | None = None,
                 rolling: bool = True) -> DataFrame:
    """Additive and autoregressive models scored on each series' whole test part: ``(series_id, model, mae, rmse, mape, n)``.

    ``parts`` is (series_id, ds, load_mw, part); ``models`` gives, for the
    parts ``validation`` and ``test``, the (additive, autoregressive) tables
    of models that know the rows before that part. All hours of both parts are
    predicted in one table, the autoregressive ones in one recursion for each
    series and part with the hours' actual covariates. Each model is scored
    on its own hours: a series without an autoregressive fit keeps its
    additive scores. The ensemble averages the models present in an hour,
    with the inverse MAEs of the validation part as weights. With
    ``rolling``, ``autoregressive_rolling`` is also scored: a fresh 24 h
    recursion every 24 h from the actual history up to each origin (the
    first origin is the last training hour).
    """
    from ..functions import clip_forecast, rnd
    from ..models.additive import additive_value
    from ..models.autoregressive import fold_forecast, rolling_forecast_autoregressive
    from ..session import materialize

    key, ts = "series_id", "ds"
    targets = ("validation", "test")
    wanted = parts.where(F.col("part").isin(*targets) & F.col("load_mw").isNotNull()).select(key, ts, "part", F.col("load_mw").alias("actual"))
    add = [models[t][0].select(key, F.lit(t).alias("part"), "t0", "t1", "coef", "y_scale") for t in targets]
    auto = {t: models[t][1] for t in targets}
    mo = [auto[t].select(key, F.lit(t).alias("part"), F.col("last_ds").alias("_origin"), "n_lags", "coef", "feature_min", "feature_max") for t in targets]
    ends = wanted.groupBy(key, "part").agg(F.max(ts).alias("_end"))
    mo = materialize(mo[0].unionByName(mo[1]).join(ends, [key, "part"])
                     .withColumn("_hours", (epoch_hours("_end") - epoch_hours("_origin")).cast("int")).drop("_end"))
    history = parts.where(F.col("load_mw").isNotNull()).select(key, ts, F.col("load_mw").alias("_v"))
    seeds = history.join(mo.select(key, "part", "_origin", "n_lags"), key).where(
        (F.col(ts) <= F.col("_origin")) & (F.col(ts) > add_hours("_origin", -F.col("n_lags")))).select(key, "part", ts, "_v")
    folded = fold_forecast(mo, seeds, "_hours", weather, [key, "part"], ts).select(key, "part", ts, rnd("_p", 3).alias("autoregressive"))
    rows = wanted.join(add[0].unionByName(add[1]), [key, "part"], "left").withColumn("additive", rnd(clip_forecast(additive_value(ts)), 3))
    wide = materialize(rows.select(key, ts, "part", "actual", "additive").join(folded, [key, "part", ts], "left"))

    checked = wide.where(F.col("part") == "validation")
    mae = checked.groupBy(key).agg(*[F.avg(F.abs(F.col("actual") - F.col(m))).alias(m) for m in FITTED])
    weights = mae.select(key, *[w.alias(f"w_{m}") for m, w in zip(FITTED, error_weights(*[F.col(m) for m in FITTED]))])
    test = wide.where(F.col("part") == "test").join(weights, key, "left")
    w = {m: F.when(F.col(m).isNotNull(), F.coalesce(F.col(f"w_{m}"), F.lit(1.0))) for m in FITTED}
    total = sum(F.coalesce(w[m], F.lit(0.0)) for m in FITTED)
    blend = sum(F.coalesce(w[m] * F.col(m), F.lit(0.0)) for m in FITTED)
    alone = F.coalesce(*FITTED)                                # the only model present may have weight 0
    scored = test.withColumn("ensemble", F.coalesce(F.try_divide(blend, total), alone))
    long = _long(scored, (*FITTED, "ensemble"), key, ts)
    if rolling:
        anchors = parts.where((F.col("part") != "test") & F.col("load_mw").isNotNull()).groupBy(key).agg(F.max(ts).alias("anchor"))
        roll = rolling_forecast_autoregressive(materialize(auto["test"]), parts.select(key, ts, "load_mw"), anchors, 24, 24, weather)
        rolled = align_actuals(roll.select(key, ts, F.col("predicted_mw").alias("autoregressive_rolling")),
                               wanted.where(F.col("part") == "test"), (key, ts), "actual")
        long = long.unionByName(_long(rolled.withColumn("part", F.lit("test")), ("autoregressive_rolling",), key, ts))
    return error_metrics(long, (key, "model"))


def evaluate_models(df: DataFrame, weather: DataFrame | None = None, value: str = "load_mw",
                    key: str = "series_id", ts: str = "ds", rolling: bool = True) -> DataFrame:
    """M5 with the fitted models: split, fit on what lies before each part, and score (:func:`score_models`)."""
    from ..session import materialize

    rows = df.select(F.col(key).alias("series_id"), F.col(ts).alias("ds"), F.col(value).alias("load_mw"))
    parts = materialize(split_parts(rows))
    metrics = score_models(parts, fit_before(parts, weather), weather, rolling)
    return metrics.withColumnRenamed("series_id", key)
