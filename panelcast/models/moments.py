"""Sums of products per ticker and step: all that linear models need of the rows.

One aggregation reduces the rows of every training set to a few dozen numbers.
What reaches Python is one short row per ticker and step.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from panelcast.models.roles import SEGMENTS, staged
from panelcast.operators.panel import whole

PREDICTION_SCHEMA = "ticker string, horizon int, role string, y double, y_hat double"
# Variance below which a column counts as constant.
FLAT = 1e-24


def moment_rows(frame: DataFrame, features: list[str], horizon: int, shifts: bool = False) -> DataFrame:
    """Per ticker and step: sums by segment and the rows to be predicted.

    With ``shifts`` also ``x_shift``, the means that were taken off the columns.

    Values are shifted by the ticker's mean first, which keeps the sums of
    squares accurate. A group holds at most 8 segments and 7 scored rows.
    """
    means = {"y_shift": F.avg("price").over(whole())}
    if shifts:
        means["x_shift"] = F.array(*[F.avg(c).over(whole()) for c in features])
    shifted = frame.withColumns({c: F.col(c) - F.avg(c).over(whole()) for c in features} | means)
    rows = staged(shifted, horizon).withColumn("t", F.col("y") - F.col("y_shift"))
    upper = [(i, j) for i in range(len(features)) for j in range(i, len(features))]
    sums = [
        F.count("t").cast("double"),
        F.sum("t"),
        F.sum(F.col("t") * F.col("t")),
        *[F.sum(c) for c in features],
        *[F.sum(F.col(c) * F.col("t")) for c in features],
        *[F.sum(F.col(features[i]) * F.col(features[j])) for i, j in upper],
    ]
    scored = F.when(
        F.col("role").isNotNull(),
        F.struct("role", F.array(*features).alias("x"), "y"),
    )
    keys = ["ticker", "horizon", *means]
    by_segment = rows.groupBy(*keys, "segment").agg(
        F.array(*sums).alias("sums"), F.collect_list(scored).alias("scored")
    )
    known = F.when(F.col("segment").isNotNull(), F.struct("segment", "sums"))
    collected = (
        by_segment.groupBy(*keys)
        .agg(F.collect_list(known).alias("known"), F.flatten(F.collect_list("scored")).alias("scored"))
        .select(
            *keys,
            F.col("known.segment").alias("segments"),
            F.col("known.sums").alias("sums"),
            F.col("scored.role").alias("roles"),
            F.col("scored.x").alias("xs"),
            F.col("scored.y").alias("ys"),
        )
    )
    # The rows are short but costly to fit, so every core gets a share of them.
    cores = frame.sparkSession.sparkContext.defaultParallelism
    return collected.repartition(cores, "ticker", "horizon")


@dataclass
class Moments:
    """Count, means and covariances of the nested training sets of one problem."""

    count: np.ndarray
    x_mean: np.ndarray
    y_mean: np.ndarray
    y_var: np.ndarray
    cov: np.ndarray
    cross: np.ndarray

    @property
    def scale(self) -> np.ndarray:
        variance = np.diagonal(self.cov, axis1=1, axis2=2)
        return np.where(variance > FLAT, np.sqrt(np.maximum(variance, 0.0)), 1.0)


def nested_moments(segments: np.ndarray, sums: np.ndarray, width: int) -> Moments:
    """Turn sums by segment into moments of every prefix of segments."""
    table = np.zeros((SEGMENTS, sums.shape[1]))
    table[segments] = sums
    table = table.cumsum(axis=0)
    count = table[:, 0]
    safe = np.maximum(count, 1.0)[:, None]
    y_mean = table[:, 1] / safe[:, 0]
    y_var = np.maximum(table[:, 2] / safe[:, 0] - y_mean**2, 0.0)
    x_sum, xy_sum, xx_sum = np.split(table[:, 3:], [width, 2 * width], axis=1)
    x_mean = x_sum / safe
    cross = xy_sum / safe - x_mean * y_mean[:, None]
    second = np.zeros((SEGMENTS, width, width))
    rows, cols = np.triu_indices(width)
    second[:, rows, cols] = xx_sum / safe
    second[:, cols, rows] = second[:, rows, cols]
    cov = second - x_mean[:, :, None] * x_mean[:, None, :]
    flat = np.diagonal(cov, axis1=1, axis2=2) <= np.maximum(
        FLAT, 1e-14 * np.diagonal(second, axis1=1, axis2=2)
    )
    cov = np.where(flat[:, :, None] | flat[:, None, :], 0.0, cov)
    cross = np.where(flat, 0.0, cross)
    return Moments(count, x_mean, y_mean, y_var, cov, cross)


def problems(batches: Iterator[pd.DataFrame], width: int):
    """Yield ``(row, moments, scored rows by role)`` for every ticker and step."""
    for batch in batches:
        for row in batch.itertuples(index=False):
            if len(row.segments) == 0:
                continue
            sums = np.stack([np.asarray(s, dtype=float) for s in row.sums])
            moments = nested_moments(np.asarray(row.segments, dtype=int), sums, width)
            scored = {
                role: (np.asarray(x, dtype=float), y) for role, x, y in zip(row.roles, row.xs, row.ys)
            }
            yield row, moments, scored
