"""Ordinary least squares for every ticker and step."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from panelcast.models.moments import PREDICTION_SCHEMA, moment_rows, problems
from panelcast.models.roles import FULL_SEGMENT, TRAIN_SEGMENT, staged

# Singular values below this share of the largest count as zero: the two signal
# columns always add up to one, so the system is singular by construction.
RCOND = 1e-12
FITTED_ON = {"validation": TRAIN_SEGMENT, "test": FULL_SEGMENT}


def least_squares(cov: np.ndarray, cross: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Minimum-norm weights on standardised columns."""
    standard = cov / np.outer(scale, scale)
    return np.linalg.pinv(standard, rcond=RCOND, hermitian=True) @ (cross / scale)


def linear_forecast(frame: DataFrame, features: list[str], horizon: int) -> DataFrame:
    """Validation and test forecasts of a standardised linear regression."""
    width = len(features)

    def fit(batches):
        for row, moments, scored in problems(batches, width):
            out = []
            for role, segment in FITTED_ON.items():
                if role not in scored or moments.count[segment] < 1:
                    continue
                x, y = scored[role]
                scale = moments.scale[segment]
                weights = least_squares(moments.cov[segment], moments.cross[segment], scale)
                centred = (x - moments.x_mean[segment]) / scale
                y_hat = moments.y_mean[segment] + centred @ weights + row.y_shift
                out.append((row.ticker, row.horizon, role, y, y_hat))
            yield pd.DataFrame(out, columns=["ticker", "horizon", "role", "y", "y_hat"])

    rows = moment_rows(frame, features, horizon)
    return rows.mapInPandas(fit, PREDICTION_SCHEMA)


def single_feature_forecast(frame: DataFrame, feature: str, horizon: int) -> DataFrame:
    """Regression on one column with the built-in aggregates, without Python."""
    rows = staged(frame, horizon)
    label, x = F.col("y"), F.col(feature)
    exprs = []
    for role, segment in FITTED_ON.items():
        y = F.when(F.col("segment") <= segment, label)
        exprs += [
            F.regr_slope(y, x).alias(f"{role}_slope"),
            F.regr_intercept(y, x).alias(f"{role}_intercept"),
            F.max(F.when(F.col("role") == role, x)).alias(f"{role}_x"),
            F.max(F.when(F.col("role") == role, label)).alias(f"{role}_y"),
        ]
    wide = rows.groupBy("ticker", "horizon").agg(*exprs)
    phases = F.array(
        *[
            F.struct(
                F.lit(role).alias("role"),
                F.col(f"{role}_y").alias("y"),
                (F.col(f"{role}_slope") * F.col(f"{role}_x") + F.col(f"{role}_intercept")).alias("y_hat"),
            )
            for role in FITTED_ON
        ]
    )
    return wide.select("ticker", "horizon", F.inline(phases))
