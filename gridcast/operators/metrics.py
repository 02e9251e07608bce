"""Forecast accuracy, ensemble weights and model ranking.

Metric tables are tiny (one row per series and model); the windows here are
partitioned by ``series_id`` over those tables only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from ..functions import fixed_text, quality_tier, report_tier, rnd


def error_metrics(df: DataFrame, keys=("series_id", "model"), actual: str = "actual",
                  predicted: str = "predicted") -> DataFrame:
    """MAE, RMSE and MAPE (%) per group; MAPE skips rows whose actual is 0."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    a, p = F.col(actual), F.col(predicted)
    err = a - p
    return df.where(a.isNotNull() & p.isNotNull()).groupBy(*keys).agg(
        F.avg(F.abs(err)).alias("mae"),
        F.sqrt(F.avg(err * err)).alias("rmse"),
        (F.avg(F.abs(F.try_divide(err, F.nullif(a, F.lit(0.0))))) * F.lit(100.0)).alias("mape"),
        F.count(F.lit(1)).alias("n"),
    )


def error_weights(*errors: Column) -> list[Column]:
    """Shares of inverse errors, one per model, summing to 1.

    Models without any error share all the weight; a model whose error is
    not known gets none, and if none is known all get the same.
    """
    free = sum(F.coalesce((e == 0).cast("double"), F.lit(0.0)) for e in errors)
    inverse = [F.coalesce(F.try_divide(F.lit(1.0), e), F.lit(0.0)) for e in errors]
    total = sum(inverse)
    return [F.when(free > 0, F.coalesce((e == 0).cast("double"), F.lit(0.0)) / free)
            .when(total > 0, i / total).otherwise(F.lit(1.0 / len(errors))) for e, i in zip(errors, inverse)]


def inverse_error_weights(metrics: DataFrame, keys=("series_id",), model: str = "model",
                          metric: str = "mae") -> DataFrame:
    """Weight of each model = (1 / metric) normalised to sum 1 within the group."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    inv = F.try_divide(F.lit(1.0), F.col(metric))
    w = Window.partitionBy(*keys)
    return metrics.select(*keys, model, inv.alias("_inv")).withColumn(
        "weight", F.try_divide(F.col("_inv"), F.sum("_inv").over(w))
    ).drop("_inv")


def best_per_metric(metrics: DataFrame, keys=("series_id",), cols=("mae", "rmse", "mape")) -> DataFrame:
    """Flag the best (minimum) model of each metric; ties are all flagged."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    w = Window.partitionBy(*keys)
    return metrics.withColumns({f"best_{c}": F.col(c) == F.min(c).over(w) for c in cols})


def leaderboard(metrics: DataFrame, keys=("series_id",), model: str = "model") -> DataFrame:
    """Rank by ``score = mae + rmse + mape / 10`` (ties by model name), with quality tier and winner.

    Values are shown rounded as the reference does (3, 3, 2, 3 decimals).
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    score = F.col("mae") + F.col("rmse") + F.col("mape") / F.lit(10.0)
    w = Window.partitionBy(*keys).orderBy(score.asc(), F.col(model).asc())
    ranked = metrics.withColumn("_score", score).withColumn("rank", F.row_number().over(w))
    return ranked.select(
        *keys, model, "rank",
        rnd("mae", 3).alias("mae"), rnd("rmse", 3).alias("rmse"), rnd("mape", 2).alias("mape"),
        rnd("_score", 3).alias("score"),
        quality_tier("mape").alias("quality"),
        (F.col("rank") == 1).alias("recommended"),
    )


def recommendation_text(board: DataFrame, keys=("series_id",), model: str = "model") -> DataFrame:
    """The explanation sentence for the top-ranked model of each group."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    top = board.where(F.col("rank") == 1)
    text = F.format_string(C.RECOMMENDATION_TEXT, F.col(model), fixed_text("mape", 2), F.col("quality"))
    return top.select(*keys, F.col(model).alias("recommended_model"), text.alias("explanation"))


def report_winner(metrics: DataFrame, keys=("series_id",), model: str = "model", ordinal: str = "ordinal") -> DataFrame:
    """Model with the lowest ``mae + rmse`` (first in ``ordinal`` order on ties), with the report tier."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    order = F.struct((F.col("mae") + F.col("rmse")).alias("s"), F.col(ordinal).alias("o"))
    return metrics.groupBy(*keys).agg(
        F.min_by(F.struct(F.col(model).alias("winner"), F.col("mape").alias("winner_mape")), order).alias("_w")
    ).select(*keys, "_w.winner", report_tier("_w.winner_mape").alias("winner_tier"))
