"""Per-series summaries, profiles, Fourier coefficients and trends.

All are ``groupBy`` aggregates with partial (map-side) aggregation; the
exact percentile keeps a value->count map per group, which on hourly series
is bounded by the hours of history.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import epoch_days, exact_mean, not_missing, rnd, weekday0


def load_summary(df: DataFrame, value: str = "load_mw", key: str = "series_id", ts: str = "ds",
                 source: str = "hourly demand from readings") -> DataFrame:
    """Rows, first/last time, min/max (2 decimals), status and a source label per series.

    A series without a usable value has no rows and the status ``no_data``.
    """
    good = not_missing(value)
    v, t = F.when(good, F.col(value)), F.when(good, F.col(ts))
    return df.groupBy(key).agg(
        F.count(v).alias("rows"),
        F.min(t).alias("first_ds"),
        F.max(t).alias("last_ds"),
        rnd(F.min(v), 2).alias("load_min_mw"),
        rnd(F.max(v), 2).alias("load_max_mw"),
    ).withColumn("status", F.when(F.col("rows") > 0, "ready").otherwise("no_data")).withColumn("source", F.lit(source))


def describe_load(df: DataFrame, value: str = "load_mw", key: str = "series_id") -> DataFrame:
    """count, mean, std (sample), min, 25/50/75% (linear interpolation), max per series."""
    v = F.col(value)
    q = F.percentile(v, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return df.where(not_missing(value)).groupBy(key).agg(
        F.count(v).alias("count"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"),
        F.min(v).alias("min"), q.alias("_q"), F.max(v).alias("max"),
    ).select(key, "count", "mean", "std", "min", F.col("_q")[0].alias("p25"), F.col("_q")[1].alias("p50"),
             F.col("_q")[2].alias("p75"), "max")


def quantiles(df: DataFrame, ps, value: str = "load_mw", key: str = "series_id") -> DataFrame:
    """Exact quantiles (linear interpolation) per series; one row per (series, p)."""
    arr = F.array(*[F.lit(float(p)) for p in ps])
    agg = df.where(not_missing(value)).groupBy(key).agg(F.percentile(value, arr).alias("_q"))
    return agg.select(key, F.posexplode("_q").alias("_i", "value")).select(
        key, F.element_at(arr, F.col("_i") + 1).alias("p"), "value")


def approx_quantiles(df: DataFrame, ps, value: str = "load_mw", key: str = "series_id", accuracy: int = 10000) -> DataFrame:
    """Approximate quantiles (bounded memory per group) for very long raw groups."""
    arr = F.array(*[F.lit(float(p)) for p in ps])
    agg = df.where(not_missing(value)).groupBy(key).agg(F.percentile_approx(value, arr, accuracy).alias("_q"))
    return agg.select(key, F.posexplode("_q").alias("_i", "value")).select(
        key, F.element_at(arr, F.col("_i") + 1).alias("p"), "value")


def peak_row_history(df: DataFrame, value: str = "load_mw", key: str = "series_id", ts: str = "ds") -> DataFrame:
    """Maximum value and its (earliest) time per series."""
    order = F.struct((-F.col(value)).alias("n"), F.col(ts).alias("t"))
    return df.where(not_missing(value)).groupBy(key).agg(
        F.min_by(F.struct(F.col(value).alias("peak_mw"), F.col(ts).alias("peak_ds")), order).alias("_p")
    ).select(key, "_p.peak_mw", "_p.peak_ds")


def seasonal_profile(df: DataFrame, value: str = "load_mw", key: str = "series_id", ts: str = "ds") -> DataFrame:
    """Mean load by hour and weekday with rollup subtotals (per hour, per series)."""
    base = df.where(not_missing(value)).select(
        key, F.hour(ts).cast("int").alias("hour"), weekday0(ts).cast("int").alias("weekday"), value)
    return base.rollup(key, "hour", "weekday").agg(
        exact_mean(value).alias("mean_mw"), F.count(F.lit(1)).alias("n")
    ).where(F.col(key).isNotNull())


def fourier_coefficients(df: DataFrame, order: int, period_days: float, value: str = "load_mw",
                         key: str = "series_id", ts: str = "ds") -> DataFrame:
    """``a_k = 2/n sum(y cos(2 pi k t / P))``, ``b_k = 2/n sum(y sin(...))`` for k = 1..order.

    Exact least-squares coefficients only on a gap-free grid of whole
    periods; on other data they are the projections. ``t`` is days since epoch.
    """
    t = epoch_days(ts)
    aggs = [F.count(F.col(value)).alias("n")]
    for k in range(1, order + 1):
        arg = F.lit(2 * math.pi * k / period_days) * t
        aggs += [F.sum(F.col(value) * F.cos(arg)).alias(f"_c{k}"), F.sum(F.col(value) * F.sin(arg)).alias(f"_s{k}")]
    wide = df.where(not_missing(value)).groupBy(key).agg(*aggs)
    rows = F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"_c{k}").alias("c"), F.col(f"_s{k}").alias("s"))
                     for k in range(1, order + 1)])
    return wide.select(key, "n", F.inline(rows)).select(
        key, "k", (F.lit(2.0) * F.col("c") / F.col("n")).alias("a_cos"), (F.lit(2.0) * F.col("s") / F.col("n")).alias("b_sin"))


def linear_trend(df: DataFrame, value: str = "load_mw", key: str = "series_id", ts: str = "ds") -> DataFrame:
    """Least-squares slope (per day) and intercept (at epoch day 0) per series."""
    t = epoch_days(ts)
    return df.where(not_missing(value)).groupBy(key).agg(
        F.regr_slope(F.col(value), t).alias("slope_per_day"),
        F.regr_intercept(F.col(value), t).alias("intercept"),
        F.count(F.col(value)).alias("n"),
    )
