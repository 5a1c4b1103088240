"""Rows of all tickers in one training set, for tree models.

Trees cannot share a training set of raw prices, so the label is the change of
the logged price over the step and the forecast adds the predicted change to the
last one. One model per step learns from every ticker.
"""

from __future__ import annotations

from collections.abc import Callable
from multiprocessing.pool import ThreadPool
from threading import Semaphore, local

from pyspark import inheritable_thread_target
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession, functions as F

from panelcast.models.roles import FOLD_ROLES, FULL_SEGMENT, TRAIN_SEGMENT, staged
from panelcast.operators.panel import running
from panelcast.session import materialize

# Fits that wait for each other's small jobs; the cluster interleaves them. Steps that
# start fits of their own share the same number of places.
PARALLEL_FITS = 8
_places = Semaphore(PARALLEL_FITS)
_held = local()


def vector_inputs(features: list[str]) -> list[str]:
    return [*features, "close_level", "close_gap"]


def pooled_rows(frame: DataFrame, features: list[str], horizon: int) -> DataFrame:
    """Every row and step with label, feature vector, segment and role, run once."""
    return materialize(pooled_asked(frame, features, horizon))


def pooled_asked(frame: DataFrame, features: list[str], horizon: int) -> DataFrame:
    """The same rows as a plan.

    The running mean of the close, which looks only back, tells tickers apart.
    """
    levelled = frame.withColumn("close_level", F.avg("close").over(running()))
    levelled = levelled.withColumn("close_gap", F.col("close") - F.col("close_level"))
    rows = staged(levelled, horizon).withColumn("label", F.log1p("y") - F.log1p("price"))
    vector = VectorAssembler(inputCols=vector_inputs(features), outputCol="features")
    kept = ["ticker", "date", "horizon", "price", "y", "label", "segment", "role", "features"]
    return vector.transform(rows).select(*kept)


def at_step(rows: DataFrame, horizon: int) -> DataFrame:
    return rows.where(F.col("horizon") == horizon)


def training(rows: DataFrame, segment: int) -> DataFrame:
    return rows.where(F.col("segment") <= segment)


def scored(rows: DataFrame, role: str) -> DataFrame:
    return rows.where(F.col("role") == role)


def run_fits(spark: SparkSession, jobs: list[Callable]) -> list:
    """Run independent fits side by side from the driver, ``PARALLEL_FITS`` in all.

    A job that runs fits of its own gives its place to them while it waits.
    """

    def placed(job: Callable):
        with _places:
            _held.own = True
            try:
                return job()
            finally:
                _held.own = False

    waiting = getattr(_held, "own", False)
    if waiting:
        _places.release()
    try:
        with ThreadPool(min(PARALLEL_FITS, len(jobs))) as pool:
            return pool.map(placed, [inheritable_thread_target(spark)(job) for job in jobs], chunksize=1)
    finally:
        if waiting:
            _places.acquire()


def rmse(predicted: DataFrame, prediction: str = "prediction") -> float:
    """Root mean squared error over the scored rows: one number to the driver."""
    error = F.col("label") - F.col(prediction)
    return predicted.agg(F.sqrt(F.avg(error * error))).first()[0]


def best_of(grid: list, scores: dict) -> int:
    """Position of the lowest mean fold score; ties go to the first."""
    means = [sum(scores[g, f] for f in range(len(FOLD_ROLES))) / len(FOLD_ROLES) for g in range(len(grid))]
    return means.index(min(means))


def as_forecast(predicted: DataFrame, prediction: str = "prediction") -> DataFrame:
    return predicted.select(
        "ticker",
        F.col("horizon").cast("int").alias("horizon"),
        "role",
        "y",
        F.expm1(F.log1p("price") + F.col(prediction)).alias("y_hat"),
    )


PHASES = {"validation": TRAIN_SEGMENT, "test": FULL_SEGMENT}
