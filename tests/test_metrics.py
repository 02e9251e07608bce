"""Metrics, leaderboard and report on the shipped evaluation results (fixture F7)."""

import math

import pytest
from pyspark.sql import functions as F

from gridcast.operators import metrics as ME
from gridcast.sources import readers as RD

# The three evaluation rows shipped with the reference.
F7 = """model,mae,rmse,mape
Prophet,5.32009202989083,5.946374457175538,35.42391004615149
LSTM,3.6324399552630293,4.01222756619461,23.96381444394785
Ensemble,4.123588081122433,4.611285474830212,27.578222444849725
"""


def _write(tmp, text, name="eval.csv"):
    path = f"{tmp}/{name}"
    with open(path, "w") as f:
        f.write(text)
    return path


def test_leaderboard_golden(spark, tmp):
    m = RD.read_eval_results(spark, _write(tmp, F7)).withColumn("series_id", F.lit("ERCO"))
    board = {r.model: r for r in ME.leaderboard(m).collect()}
    assert board["Prophet"].score == 14.809 and board["LSTM"].score == 10.041 and board["Ensemble"].score == 11.493
    assert [m for m, _ in sorted(((r.model, r.rank) for r in board.values()), key=lambda x: x[1])] == \
        ["LSTM", "Ensemble", "Prophet"]
    assert {r.quality for r in board.values()} == {"needs improvement"}
    rec = ME.recommendation_text(ME.leaderboard(m)).collect()[0]
    assert rec.recommended_model == "LSTM" and "Its MAPE is 23.96%" in rec.explanation


def test_report_winner_and_best(spark, tmp):
    m = RD.read_eval_results(spark, _write(tmp, F7)).withColumn("series_id", F.lit("ERCO"))
    m = m.withColumn("ordinal", F.when(F.col("model") == "Prophet", 1).when(F.col("model") == "LSTM", 2).otherwise(3))
    w = ME.report_winner(m).collect()[0]
    assert w.winner == "LSTM" and w.winner_tier == "needs improvement"
    best = {r.model: r for r in ME.best_per_metric(m).collect()}
    assert best["LSTM"].best_mae and best["LSTM"].best_rmse and best["LSTM"].best_mape
    assert not best["Prophet"].best_mae


def test_bad_files(spark, tmp):
    text = F7 + "Broken,abc,1.0,2.0\n"
    assert RD.read_eval_results(spark, _write(tmp, text)).count() == 3
    with pytest.raises(ValueError):
        RD.read_eval_results(spark, _write(tmp, "model,mae,rmse\nA,1,2\n", "missing.csv"))
    with pytest.raises(ValueError):
        RD.read_eval_results(spark, _write(tmp, "model,mae,rmse,mape\nA,x,y,z\n", "empty.csv"))


def test_error_metrics_properties(spark):
    rows = [("s", "m", float(a), float(p)) for a, p in [(10, 12), (0, 1), (20, 15), (5, 5)]]
    df = spark.createDataFrame(rows, "series_id string, model string, actual double, predicted double")
    r = ME.error_metrics(df).collect()[0]
    assert math.isclose(r.mae, (2 + 1 + 5 + 0) / 4)
    assert math.isclose(r.rmse, math.sqrt((4 + 1 + 25) / 4))
    assert math.isclose(r.mape, (0.2 + 0.25 + 0) / 3 * 100)   # actual 0 skipped
    assert r.rmse >= r.mae


def test_inverse_error_weights_sum_to_one(spark):
    df = spark.createDataFrame([("s", "a", 2.0), ("s", "b", 3.0), ("t", "a", 1.0), ("t", "b", 1.0)],
                               "series_id string, model string, mae double")
    w = ME.inverse_error_weights(df).groupBy("series_id").agg(F.sum("weight").alias("w")).collect()
    assert all(abs(r.w - 1.0) < 1e-12 for r in w)
