"""Canonical inputs built from the driver tables.

``events`` readings are the demand source: one series per ``event_type``,
hourly totals of ``value``. ``orders`` give a long daily history per
``o_orderpriority``. These are the same definitions the oracle SQL uses.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as C
from ..functions import exact_mean, hour_floor
from ..operators.grid import hourly_spine as _spine
from ..operators.prep import rescale_minmax
from ..sources.readers import demand_from_events, read_table


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "events")


def hourly_load(spark: SparkSession, sf_dir: str, start=None, end=None) -> DataFrame:
    """``(series_id, ds, load)``: per event type and hour, ``value`` summed exactly (optional hour range)."""
    return demand_from_events(events(spark, sf_dir).select("event_type", "ts", "value"), start=start, end=end)


def hourly_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly load on the complete per-series grid (missing hours have null load)."""
    return _spine(hourly_load(spark, sf_dir))


def load_mw(spark: SparkSession, sf_dir: str, cfg: C.GridConfig = C.GridConfig()) -> DataFrame:
    """``(series_id, ds, load, load_mw)``: hourly load rescaled per series to the district range."""
    return rescale_minmax(hourly_load(spark, sf_dir), "load", "load_mw", cfg)


def covariate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(ds, temp_c)``: mean ``value`` of all readings of the hour, which stands in for temperature."""
    return events(spark, sf_dir).where(F.col("ts").isNotNull()).groupBy(hour_floor("ts").alias("ds")).agg(exact_mean("value").alias("temp_c"))


def daily_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(series_id, ds, load)``: order value per order day, one series per order priority."""
    o = read_table(spark, sf_dir, "orders")
    return o.groupBy(
        F.col("o_orderpriority").alias("series_id"),
        F.make_timestamp_ntz(F.year("o_orderdate"), F.month("o_orderdate"), F.dayofmonth("o_orderdate"),
                             F.lit(0), F.lit(0), F.lit(0)).alias("ds"),
    ).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("load"))


def zones_from_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five regions used as five shedding zones: ``zone = r_name``, ``priority = r_regionkey + 1``."""
    r = read_table(spark, sf_dir, "region")
    return r.select(F.col("r_name").alias("zone"), (F.col("r_regionkey") + 1).cast("int").alias("priority"))
