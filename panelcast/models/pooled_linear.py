"""Linear regression of all tickers together, one fit per step and phase.

The label is the change of the logged price, as for the tree models. Spark's regression
scales the label, so its squared penalty acts as the given one over the label's deviation;
the penalty asked for is translated, and means the same for every label.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame, functions as F

from panelcast.models.pooled import PHASES, as_forecast, at_step, run_fits, scored, training
from panelcast.models.roles import staged
from panelcast.operators.features import SIGNALS
from panelcast.operators.panel import running
from panelcast.session import materialize

# Iterations and relative gain at which the penalised solver stops.
MAX_ITER = 1000
TOLERANCE = 1e-9


def independent(features: list[str]) -> list[str]:
    """The features without the last signal flag, which is one minus the others."""
    return [c for c in features if c != f"mfi_signal_{SIGNALS[-1]}"]


def regression_rows(frame: DataFrame, features: list[str], horizon: int) -> DataFrame:
    """Every row and step with label and vector; the running mean of the close tells
    tickers apart."""
    levelled = frame.withColumn("close_level", F.avg("close").over(running()))
    rows = staged(levelled, horizon).withColumn("label", F.log1p("y") - F.log1p("price"))
    vector = VectorAssembler(inputCols=[*independent(features), "close_level"], outputCol="features")
    kept = ["ticker", "date", "horizon", "price", "y", "label", "segment", "role", "features"]
    return materialize(vector.transform(rows).select(*kept))


def translated(alpha: float, l1_ratio: float, deviation: float) -> tuple[float, float]:
    """Spark's (regParam, elasticNetParam) for a penalty of ``alpha * l1_ratio`` on the sizes
    of weights and ``alpha * (1 - l1_ratio) / 2`` on their squares, on standardised columns."""
    sizes, squares = alpha * l1_ratio, alpha * (1 - l1_ratio) * deviation
    total = sizes + squares
    return total, sizes / total if total else 0.0


def fit_pooled(rows: DataFrame, alpha: float = 0.0, l1_ratio: float = 0.0):
    """One regression on ``rows`` with a label; without a penalty it is least squares."""
    known = rows.where(F.col("label").isNotNull())
    deviation = known.agg(F.stddev_pop("label")).first()[0] or 0.0
    penalty, mixing = translated(alpha, l1_ratio, deviation)
    solver = LinearRegression(regParam=penalty, elasticNetParam=mixing, maxIter=MAX_ITER, tol=TOLERANCE, solver="normal")
    return solver.fit(known)


def pooled_linear_forecast(
    frame: DataFrame, features: list[str], horizon: int, alpha: float = 0.0, l1_ratio: float = 0.0
) -> DataFrame:
    """Validation and test forecasts of every ticker by the regression of all."""
    rows = regression_rows(frame, features, horizon)

    def phase(h: int, role: str, segment: int) -> DataFrame:
        data = at_step(rows, h)
        return as_forecast(fit_pooled(training(data, segment), alpha, l1_ratio).transform(scored(data, role)))

    jobs = [lambda h=h, r=r, s=s: phase(h, r, s) for h in range(1, horizon + 1) for r, s in PHASES.items()]
    return reduce(DataFrame.unionByName, run_fits(frame.sparkSession, jobs))
