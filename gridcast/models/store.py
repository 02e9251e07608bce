"""Models and forecasts as tables.

A fitted model is a row per series in a Parquet table (partitioned by
model name); the newest fit of each series wins on read. Forecast results
are also a table, so "cached" forecasts are a freshness filter on it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as C


def write_model(model: DataFrame, path: str, mode: str = "append") -> None:
    """Append a fit (one row per series) to the model table."""
    model.write.mode(mode).partitionBy("model").parquet(path)


def latest_fit(models: DataFrame, key: str = "series_id") -> DataFrame:
    """Newest ``fitted_at`` row per (series, model); of equal times the fit with more and later data. Partial aggregate, no sort."""
    rest = [c for c in models.columns if c not in (key, "model")]
    order = F.struct(*[c for c in ("fitted_at", "last_ds", "n") if c in rest], F.xxhash64(*[c for c in ("coef", "sigma") if c in rest]))
    return models.groupBy(key, "model").agg(F.max_by(F.struct(*rest), order).alias("_m")).select(key, "model", "_m.*")


def read_model(spark: SparkSession, path: str, model: str, key: str = "series_id") -> DataFrame:
    """The newest fit of ``model`` for every series (only that model's partition is read)."""
    if model not in ("additive", "autoregressive"):
        raise ValueError(f"unknown model {model!r}")
    # Each model kind has its own columns: read only its partition directory (its own schema).
    base = path.rstrip("/")
    return latest_fit(spark.read.option("basePath", base).parquet(f"{base}/model={model}"), key)


def fallback_model(preferred: DataFrame, fallback: DataFrame, key: str = "series_id") -> DataFrame:
    """Per series: the preferred model's forecast if it has one, else the fallback's.

    Works on forecast (or model) tables with the same columns; the choice is
    per series, decided by a left-anti join on the key.
    """
    have = preferred.select(key).distinct()
    rest = fallback.join(have, key, "left_anti")
    return preferred.unionByName(rest, allowMissingColumns=True)


def fresh_forecast(forecasts: DataFrame, now, ttl_s: int = 300, keys=("series_id", "model", "hours")) -> DataFrame:
    """Latest stored forecast run per key if it is younger than ``ttl_s`` seconds at ``now``.

    ``forecasts`` holds runs (``generated_at``) of step rows; the newest run
    per key is kept whole, older runs and stale keys are dropped.
    """
    keys = list(keys)
    now_c = F.lit(now).cast("timestamp_ntz")
    limit = now_c - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(float(ttl_s)))
    recent = forecasts.where((F.col("generated_at") > limit) & (F.col("generated_at") <= now_c))
    newest = recent.groupBy(*keys).agg(F.max("generated_at").alias("_g"))
    return recent.join(newest, keys, "inner").where(F.col("generated_at") == F.col("_g")).drop("_g")


def valid_request_column(hours: Column, model: Column, limit: Column) -> Column:
    """The same checks over a table of requests: true where a request is valid (false for nulls)."""
    names = [*C.MODEL_NAMES, "additive", "autoregressive"]
    return F.coalesce(hours.between(1, C.MAX_HORIZON_H) & model.isin(*names) & limit.between(1, C.MAX_ALERT_LIMIT), F.lit(False))


def valid_request(hours: int, model: str, limit: int = 20) -> None:
    """Argument checks of the forecast and alert requests."""
    if not 1 <= int(hours) <= C.MAX_HORIZON_H:
        raise ValueError("hours must be in 1..168")
    if model not in C.MODEL_NAMES and model not in ("additive", "autoregressive"):
        raise ValueError(f"model must be one of {C.MODEL_NAMES}")
    if not 1 <= int(limit) <= C.MAX_ALERT_LIMIT:
        raise ValueError("limit must be in 1..100")
