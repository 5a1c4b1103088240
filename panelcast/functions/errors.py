"""Forecast error measures as aggregate expressions."""

from __future__ import annotations

import sys

from pyspark.sql import Column, functions as F

# Smallest denominator used by the percentage error (float64 machine epsilon).
EPSILON = sys.float_info.epsilon


def error_measures(actual: str = "y", predicted: str = "y_hat") -> dict[str, Column]:
    """MAE, MAPE, NMAE, RMSE, NRMSE and R2; R2 is NULL below two rows or without spread."""
    y = F.col(actual)
    error = y - F.col(predicted)
    mae = F.avg(F.abs(error))
    rmse = F.sqrt(F.avg(error * error))
    level = F.avg(F.abs(y))
    spread = F.var_pop(y)
    r2 = F.when((F.count(y) >= 2) & (spread > 0), 1 - F.try_divide(F.avg(error * error), spread))
    return {
        "mae": mae,
        "mape": F.avg(F.abs(error) / F.greatest(F.abs(y), F.lit(EPSILON))),
        "nmae": F.try_divide(mae, level),
        "rmse": rmse,
        "nrmse": F.try_divide(rmse, level),
        "r2": r2,
    }
