"""k-nearest-neighbour regression for every ticker and step.

Seven rows per ticker and step are predicted (five folds, validation, test).
Every training row carries these seven, so distances grow linearly with the
history and need neither a join nor a second shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from panelcast.models.roles import FOLD_ROLES, FULL_SEGMENT, TRAIN_SEGMENT, last_train_row, staged
from panelcast.operators.evaluate import best_grid_point

# Neighbour counts tried by the reference (fixed values).
NEIGHBOURS = [3, 5, 7]
KEYS = ["ticker", "horizon"]


def knn_predictions(frame: DataFrame, features: list[str], horizon: int, ks: list[int]) -> DataFrame:
    """Predictions of every scored row for each k: ``yhat_{k}`` columns.

    Columns are scaled to the range of the training rows, or of all labelled
    rows for the test row. Equal distances are ordered by position.
    """
    rows = staged(frame, horizon)
    group = Window.partitionBy(*KEYS)

    def spread(c: str):
        """Range of the training rows, over the days of one ticker and step."""

        def width(segment: int):
            known = F.when(F.col("segment") <= segment, F.col(c))
            value = F.max(known).over(group) - F.min(known).over(group)
            return F.when(value == 0, 1.0).otherwise(value)

        return F.when(F.col("role") == "test", width(FULL_SEGMENT)).otherwise(width(TRAIN_SEGMENT))

    query = F.struct(
        F.col("role").alias("query"),
        F.col("y").alias("actual"),
        last_train_row(F.col("role")).alias("last_row"),
        *[F.col(c).alias(f"q_{c}") for c in features],
        *[F.col(f"s_{c}") for c in features],
    )
    scaled = rows.withColumns({f"s_{c}": spread(c) for c in features})
    asked = scaled.withColumn(
        "queries", F.collect_list(F.when(F.col("role").isNotNull(), query)).over(group)
    )
    pairs = (
        asked.where(F.col("segment").isNotNull())
        .select(*KEYS, "rn", "y", *features, F.inline("queries"))
        .where(F.col("rn") <= F.col("last_row"))
    )
    squares = [F.pow((F.col(f"q_{c}") - F.col(c)) / F.col(f"s_{c}"), F.lit(2)) for c in features]
    near = Window.partitionBy(*KEYS, "role").orderBy("distance", "rn")
    ranked = (
        pairs.select(
            *KEYS,
            F.col("query").alias("role"),
            "actual",
            "rn",
            "y",
            sum(squares[1:], squares[0]).alias("distance"),
        )
        .withColumn("rank", F.row_number().over(near))
        .where(F.col("rank") <= max(ks))
    )
    return ranked.groupBy(*KEYS, "role").agg(
        F.max("actual").alias("y"),
        *[F.avg(F.when(F.col("rank") <= k, F.col("y"))).alias(f"yhat_{k}") for k in ks],
    )


def fold_scores(predictions: DataFrame, ks: list[int]) -> DataFrame:
    """Error of every k on every fold; a fold has one row, so its RMSE is that error."""
    points = F.array(
        *[
            F.struct(F.lit(k).alias("k"), F.abs(F.col("y") - F.col(f"yhat_{k}")).alias("rmse"))
            for k in ks
        ]
    )
    folds = predictions.where(F.col("role").isin(FOLD_ROLES))
    return folds.select(*KEYS, F.col("role").alias("fold"), F.inline(points))


def choose_k(scores: DataFrame) -> DataFrame:
    return best_grid_point(scores, KEYS, "k", "rmse")


def _final(predictions: DataFrame, ks: list[int], chosen) -> DataFrame:
    picked = F.coalesce(*[F.when(chosen == k, F.col(f"yhat_{k}")) for k in ks])
    final = predictions.where(F.col("role").isin("validation", "test"))
    return final.select(*KEYS, "role", "y", picked.alias("y_hat"), chosen.cast("int").alias("k"))


def knn_forecast(frame: DataFrame, features: list[str], horizon: int, k: int = 5) -> DataFrame:
    """Forecasts with a given k."""
    return _final(knn_predictions(frame, features, horizon, [k]), [k], F.lit(k))


def knn_tuned(frame: DataFrame, features: list[str], horizon: int, ks: list[int] = NEIGHBOURS) -> DataFrame:
    """Forecasts with the k that does best on the folds of the training rows.

    The choice is a window over the few scored rows of a ticker and step, so
    predictions are computed once.
    """
    predictions = knn_predictions(frame, features, horizon, ks)
    group = Window.partitionBy(*KEYS)
    is_fold = F.col("role").isin(FOLD_ROLES)
    scores = F.array(
        *[
            F.struct(
                F.avg(F.when(is_fold, F.abs(F.col("y") - F.col(f"yhat_{k}")))).over(group).alias("score"),
                F.lit(k).alias("k"),
            )
            for k in ks
        ]
    )
    best = predictions.withColumn("_best", F.array_min(scores)["k"])
    return _final(best, ks, F.col("_best"))
