"""Plan-shape guards: no cross joins anywhere, one scan of the raw readings for the single-source plans."""

import os

import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
EAGER_OR_STREAM = {"alert_dedupe", "ar_forecast", "model_fallback", "model_evaluation", "model_leaderboard",
                   "stream_hourly_load", "stream_alert_cooldown", "stream_threshold_alerts", "stream_forecast_job"}


def _plan(spark, name):
    return E.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")
def test_no_cross_joins(spark):
    for name in E.queries():
        if name in EAGER_OR_STREAM:
            continue
        plan = _plan(spark, name)
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


@pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")
def test_single_scan_plans(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for name in ("evaluation_metrics", "leaderboard", "shed_schedule_t20", "load_mw", "lag_features"):
            scans = [line for line in _plan(spark, name).splitlines() if "FileScan parquet" in line]
            assert sum("events.parquet" in line for line in scans) == 1, name      # the zone table is another table
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
