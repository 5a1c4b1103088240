"""Scores, grid choice and the leaderboard."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from panelcast.functions.errors import error_measures
from panelcast.functions.scalars import horizon_label

METRICS = ["mae", "mape", "nmae", "rmse", "nrmse", "r2"]


def forecast_metrics(predictions: DataFrame, keys: list[str]) -> DataFrame:
    """All error measures per group from ``y`` and ``y_hat``, in one aggregation."""
    return predictions.groupBy(*keys).agg(*[e.alias(c) for c, e in error_measures().items()])


def best_grid_point(scores: DataFrame, keys: list[str], order: str, score: str) -> DataFrame:
    """The grid point with the lowest mean fold score; ties go to the first in the grid."""
    means = scores.groupBy(*keys, order).agg(F.avg(score).alias("mean_score"))
    best = Window.partitionBy(*keys).orderBy(F.col("mean_score").asc_nulls_last(), order)
    return means.withColumn("_rank", F.row_number().over(best)).where("_rank = 1").drop("_rank")


def linspace_grid(df: DataFrame, low: float, high: float, points: int, ratios: list[float]) -> DataFrame:
    """Every row for each of evenly spaced alphas and each mixing ratio; ratios vary fastest."""
    step = (high - low) / (points - 1)
    alphas = df.select("*", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("alpha_ord"))
    rows = alphas.select("*", F.posexplode(F.array(*map(F.lit, ratios))).alias("ratio_ord", "l1_ratio"))
    order = F.col("alpha_ord").cast("long") * len(ratios) + F.col("ratio_ord")
    alpha = F.lit(low) + F.col("alpha_ord") * step
    return rows.select(*df.columns, order.alias("grid_ord"), alpha.alias("alpha"), "l1_ratio")


def union_performance(*tables: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def leaderboard(performance: DataFrame, horizon: int) -> DataFrame:
    """NMAE in percent per model and step, a ``best_model`` row, mean and deviation.

    ``performance`` has ticker, model, horizon, nmae and running_time. The
    deviation is the sample one, NULL for a single step. The best row takes the
    lowest value of every step and -1 as its running time.
    """
    step = Window.partitionBy("ticker", "horizon").orderBy(F.col("score").asc_nulls_last(), "model")
    ranked = performance.select(
        "ticker", "model", "horizon", (F.col("nmae") * 100).alias("score"), "running_time"
    ).withColumn("_rank", F.row_number().over(step))
    # The best row of every step counts twice: for its model and for best_model.
    own = F.struct("model", "running_time")
    best = F.struct(F.lit("best_model").alias("model"), F.lit(-1.0).alias("running_time"))
    counted = F.when(F.col("_rank") == 1, F.array(own, best)).otherwise(F.array(own))
    rows = ranked.select("ticker", "horizon", "score", F.inline(counted)).withColumn(
        "gap", horizon_label(F.col("horizon"))
    )
    gaps = [f"time_gap_{h}" for h in range(1, horizon + 1)]
    return rows.groupBy("ticker", "model").agg(
        *[F.max(F.when(F.col("gap") == gap, F.col("score"))).alias(gap) for gap in gaps],
        F.avg("score").alias("avg"),
        F.stddev_samp("score").alias("std"),
        F.avg("running_time").alias("running_time"),
    )


def best_models(performance: DataFrame) -> DataFrame:
    """Which model has the lowest NMAE per ticker and step; ties by name."""
    by_score = F.struct("nmae", "model")
    return performance.groupBy("ticker", "horizon").agg(
        F.min_by("model", by_score).alias("model"), F.min("nmae").alias("nmae")
    )


def score_of(board: DataFrame, model: str) -> DataFrame:
    return board.where(F.col("model") == model)
