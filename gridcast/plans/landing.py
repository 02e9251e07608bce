"""Queries over landed files: the events are written as pages, CSV, weather documents and logs, and read back.

Writing the stand-in files only gives rows the format that the readers
expect; the reading, cleaning and combining is the library's own.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions import day_of, format_period, rnd, temperature_proxy
from ..operators import alerts as AL
from ..operators import grid as G
from ..operators import prep as PR
from ..session import shared_path
from ..sources import readers as RD
from . import evaluation as EV
from . import views as V


def _folder(spark, name: str) -> str:
    return shared_path(spark, f"landing/{name}-{uuid.uuid4().hex}")


def _landed_pages(spark, sf) -> str:
    """One page per series and day, with a bad period, a bad number and a row of another type in each, and days that are even landed twice."""
    load = V.hourly_load(spark, sf).withColumn("day", day_of("ds"))
    row = F.struct(format_period("ds").alias("period"), F.col("series_id").alias("respondent"), F.lit("D").alias("type"),
                   F.col("load").cast("string").alias("value"))
    pages = load.groupBy("series_id", "day").agg(F.collect_list(row).alias("data"))        # 24 hours at most

    def extra(period, kind, value):
        return F.struct(period.alias("period"), F.col("series_id").alias("respondent"), F.lit(kind).alias("type"), F.lit(value).alias("value"))

    data = F.concat("data", F.array(extra(F.lit("no period"), "D", "1.5"), extra(format_period("day"), "D", "n/a"),
                                    extra(format_period("day"), "DF", "99.0")))
    copies = F.explode(F.when(F.dayofmonth("day") % 2 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    docs = pages.withColumn("data", data).withColumn("copy", copies)
    path = _folder(spark, "pages")
    docs.select(F.struct(F.size("data").cast("string").alias("total"), "data").alias("response")).write.json(path)
    return path


def q_demand_pages(spark, sf) -> DataFrame:
    """S1 pages, P6 type, P2 period, P3 numbers, P4 missing rows, U1 repeated pages: the hourly load again."""
    raw = RD.read_demand_pages(spark, _landed_pages(spark, sf))
    typed = RD.clean_demand(raw.drop("page"), kind="D").withColumn("page", F.lit(1))
    return G.combine_pages(typed, key=("series_id", "period"), order="page").select("series_id", F.col("period").alias("ds"), F.col("value_mw").alias("load"))


def q_page_report(spark, sf) -> DataFrame:
    """S2 over the same pages; every page declares its own total, so the declared one is the largest page."""
    return RD.page_completeness(spark, _landed_pages(spark, sf))


def q_load_csv(spark, sf) -> DataFrame:
    """S3: the highest series of each hour as CSV with its columns in another order, read by name."""
    rows = V.load_mw(spark, sf).groupBy("ds").agg(F.max("load_mw").alias("load_mw"))
    path = _folder(spark, "csv")
    rows.select(temperature_proxy("ds").alias("temp_c"), F.lit("x").alias("note"), "load_mw",
                F.date_format("ds", "yyyy-MM-dd HH:mm:ss").alias("ds")).write.option("header", True).csv(path)
    return RD.read_load_csv(spark, path)


def q_load_store(spark, sf) -> DataFrame:
    """S4 load table by month, read back through P1 names, P4 missing values and a P5 time range."""
    path = _folder(spark, "load")
    RD.write_load(V.load_mw(spark, sf), path)
    back = PR.select_model_columns(RD.read_load(spark, path, "2024-01-10", "2024-01-20"), {"ds": "ds", "load_mw": "y"}, keep=["series_id"])
    return PR.time_range(PR.drop_null(back, ["y"]), "2024-01-10", "2024-01-20")


def q_weather_file(spark, sf) -> DataFrame:
    """The hourly covariate as one columnar document a day, read back as rows."""
    cov = V.covariate(spark, sf).withColumn("day", day_of("ds"))
    item = F.array_sort(F.collect_list(F.struct(F.date_format("ds", "yyyy-MM-dd'T'HH:mm").alias("time"), "temp_c")))       # 24 hours at most
    days = cov.groupBy("day").agg(item.alias("i"))
    path = _folder(spark, "weather")
    days.select(F.struct(F.col("i.time").alias("time"), F.col("i.temp_c").alias("temperature_2m")).alias("hourly")).write.json(path)
    return RD.read_weather(spark, path).select("ds", rnd("temperature_2m", 6).alias("temp_c"))


def q_eval_results_file(spark, sf) -> DataFrame:
    """S7 metrics as CSV with one unreadable row added, S6 back."""
    metrics = EV.evaluate(V.load_mw(spark, sf))
    bad = spark.range(1).select(F.lit("s").alias("series_id"), F.lit("broken").alias("model"),
                                *[F.lit("n/a").alias(c) for c in ("mae", "rmse", "mape")])
    text = metrics.select("series_id", "model", *[F.col(c).cast("string").alias(c) for c in ("mae", "rmse", "mape")])
    path = _folder(spark, "eval")
    RD.write_eval_results(text.unionByName(bad), path)
    return RD.read_eval_results(spark, path).select("model", *[rnd(c, 6).alias(c) for c in ("mae", "rmse", "mape")])


def q_alert_log_file(spark, sf) -> DataFrame:
    """Each daily peak with its schedule appended to the log in two writes, read back with the number of zones."""
    days = V.load_mw(spark, sf).withColumn("day", day_of("ds"))
    peaks = AL.forecast_peak(AL.breaches(days, C.THRESHOLD_MW, value="load_mw"), ["series_id", "day"], value="load_mw")
    shed = AL.shed_array(AL.shed_schedule(peaks, C.THRESHOLD_MW, keys=["series_id", "day"]), ["series_id", "day"])
    item = F.transform("shed_schedule", lambda z: F.struct(*[z[c].alias(c) for c in ("zone", "priority", "start", "end", "duration_hrs", "load_mw")]))
    log = peaks.join(shed, ["series_id", "day"]).select("series_id", F.col("peak_ds").alias("timestamp"), "peak_mw", F.lit("history").alias("model"),
                                                        item.alias("schedule"))
    path = _folder(spark, "alerts")
    early = F.dayofmonth("timestamp") <= 15
    RD.write_alert_log(log.where(early), path)
    RD.write_alert_log(log.where(~early), path)
    return RD.read_alert_log(spark, path).select("series_id", "timestamp", "peak_mw", "model", F.size("schedule").cast("bigint").alias("zones"))


QUERIES = {
    "demand_pages": q_demand_pages,
    "page_report": q_page_report,
    "load_csv": q_load_csv,
    "load_store": q_load_store,
    "weather_file": q_weather_file,
    "eval_results_file": q_eval_results_file,
    "alert_log_file": q_alert_log_file,
}
