"""Joins on time: actuals, models, weather, zones, model coefficients.

The reference aligns arrays by position; here every alignment is an
equi-join on ``(series_id, ds)`` (or on ``ds`` for a shared covariate).
The as-of join carries readings forward inside blocks of hours, to which the
readings of the tolerance before them are added, so it never needs a window
over a whole series.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from ..functions import add_hours, epoch_hours
from .grid import hour_block


def align_actuals(forecast: DataFrame, actual: DataFrame, keys=("series_id", "ds"), value: str = "load_mw",
                  out: str = "actual") -> DataFrame:
    """Forecast rows with the actual value of the same series and hour (inner join)."""
    keys = list(keys)
    return forecast.join(actual.select(*keys, F.col(value).alias(out)), keys, "inner")


def align_models(a: DataFrame, b: DataFrame, keys=("series_id", "ds"), names=("a", "b"),
                 value: str = "predicted", how: str = "inner") -> DataFrame:
    """Two models' predictions side by side on the same hour."""
    keys = list(keys)
    return a.select(*keys, F.col(value).alias(f"{names[0]}_{value}")).join(
        b.select(*keys, F.col(value).alias(f"{names[1]}_{value}")), keys, how)


def attach_weather(df: DataFrame, weather: DataFrame, value: str = "temp_c", ts: str = "ds",
                   fallback: float = C.FALLBACK_TEMP_C, key: str = "series_id") -> DataFrame:
    """Left join the hourly covariate; missing hours take the fallback temperature.

    Weather with a ``key`` column is each series' own; without one it is the
    same for all series.
    """
    on = [ts, key] if key in weather.columns else [ts]
    return df.join(weather.select(*on, F.col(value).alias("_wv")), on, "left").withColumn(
        value, F.coalesce(F.col("_wv"), F.lit(float(fallback)))
    ).drop("_wv")


ASOF_BLOCK_H = 168


def attach_weather_asof(df: DataFrame, weather: DataFrame, tolerance_h: int = 3, value: str = "temp_c",
                        ts: str = "ds", wts: str = "ds", out: str | None = None, key: str = "series_id") -> DataFrame:
    """Latest reading at or before each row's time, no older than ``tolerance_h`` hours; ``<out>_at`` is its time.

    Weather with a ``key`` column is each series' own; without one it is the
    same for all series. Rows and readings are put together in blocks of
    hours, readings also in the blocks that their tolerance reaches into, and
    the last reading is carried forward in time order: each row is dealt
    once, whatever the tolerance. Shared readings go to a fixed number of
    salts, over which the rows of a block are spread. Of readings at one time
    the largest counts, a reading without value counts as none; rows with no reading in range get null.
    """
    out = out or value
    tol = int(tolerance_h)
    own = key in weather.columns
    hours = max(ASOF_BLOCK_H, tol)
    salts = 1 if own else int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = df.columns
    row = F.struct(*names)
    first, last = hour_block(wts, hours), F.floor((epoch_hours(wts) + F.lit(tol)) / F.lit(float(hours)))
    group = F.col(key) if own else F.pmod(F.xxhash64(*[c for c in names if dict(df.dtypes)[c] != "map"]), F.lit(salts)).cast("string")
    # a row without a time has no reading, but stays
    rows = df.select(group.alias("_g"), hour_block(ts, hours).alias("_block"), F.col(ts).alias("_t"), F.lit(1).alias("_kind"),
                     F.lit(None).cast(dict(weather.dtypes)[value]).alias("_wv"), row.alias("_row"))
    groups = F.array(F.col(key)) if own else F.transform(F.sequence(F.lit(0), F.lit(salts - 1)), lambda i: i.cast("string"))
    readings = (weather.where(F.col(value).isNotNull() & F.col(wts).isNotNull())
                .withColumn("_block", F.explode(F.sequence(first, last))).withColumn("_g", F.explode(groups))
                .select("_g", "_block", F.col(wts).alias("_t"), F.lit(0).alias("_kind"), F.col(value).alias("_wv"),
                        F.lit(None).cast(rows.schema["_row"].dataType).alias("_row")))
    w = Window.partitionBy("_g", "_block").orderBy("_t", "_kind", "_wv").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = F.last(F.when(F.col("_kind") == 0, F.struct("_t", "_wv")), ignorenulls=True).over(w)
    both = readings.unionByName(rows).withColumn("_seen", seen).where(F.col("_kind") == 1)
    near = F.col("_t").isNotNull() & (F.col("_seen._t") >= add_hours("_t", -tol))
    return both.select("_row.*", F.when(near, F.col("_seen._wv")).alias(out), F.when(near, F.col("_seen._t")).alias(f"{out}_at"))


def score_with_model(df: DataFrame, model: DataFrame, key: str = "series_id") -> DataFrame:
    """Attach each series' fitted coefficients (one row per series; Catalyst/AQE choose broadcast)."""
    return df.join(model, key, "inner")
