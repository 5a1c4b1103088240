"""Fitted models as tables and saved trees: fit once, predict whenever rows come.

A model store is a folder. The linear models of all tickers are one table of
coefficients per (ticker, horizon, phase); the neighbours are the scaled training
rows themselves; ARIMA is one number per key; tree models are saved by Spark, with
a table that says which folder holds which step and phase. To predict is a join of
the rows asked for with such a table, or a transform; nothing is fitted.

``phase`` tells what a model was fitted on: ``validation`` on the training rows,
``test`` on all rows with a known label.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.regression import DecisionTreeRegressionModel, GBTRegressionModel, RandomForestRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from panelcast.models import arima, elasticnet, goss, knn, trees
from panelcast.models.linear import FITTED_ON, least_squares
from panelcast.models.moments import moment_rows, problems
from panelcast.models.pooled import as_forecast, pooled_asked
from panelcast.models.roles import FULL_SEGMENT, TRAIN_SEGMENT, staged
from panelcast.operators.features import feature_columns
from panelcast.session import materialize

KEYS = ["ticker", "horizon", "phase"]
COEFFICIENTS = (
    "ticker string, horizon int, phase string, intercept double, "
    "centres array<double>, scales array<double>, weights array<double>"
)


def rows_asked(frame: DataFrame, features: list[str], horizon: int) -> DataFrame:
    """The rows that the two phases predict: ticker, horizon, phase, y, x."""
    rows = staged(frame, horizon).where(F.col("role").isin(*FITTED_ON))
    x = F.array(*[F.col(c) for c in features])
    return rows.select("ticker", F.col("horizon").cast("int").alias("horizon"), F.col("role").alias("phase"), "y", x.alias("x"))


# --- linear models -----------------------------------------------------------


def linear_coefficients(frame: DataFrame, features: list[str], horizon: int) -> DataFrame:
    """Least squares of every ticker, step and phase, as a table."""
    width = len(features)

    def fit(batches):
        for row, moments, _ in problems(batches, width):
            out = []
            for phase, segment in FITTED_ON.items():
                if moments.count[segment] >= 1:
                    scale = moments.scale[segment]
                    weights = least_squares(moments.cov[segment], moments.cross[segment], scale)
                    level = moments.y_mean[segment] + row.y_shift
                    out.append((row.ticker, row.horizon, phase, level, moments.x_mean[segment] + row.x_shift, scale, weights))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in COEFFICIENTS.split(", ")])

    return moment_rows(frame, features, horizon, shifts=True).mapInPandas(fit, COEFFICIENTS)


def elasticnet_coefficients(
    frame: DataFrame,
    features: list[str],
    horizon: int,
    alphas: np.ndarray = elasticnet.ALPHAS,
    ratios: np.ndarray = elasticnet.RATIOS,
    tolerance: float = elasticnet.TOLERANCE,
) -> DataFrame:
    """The tuned elastic net of every ticker, step and phase, with its penalty."""
    return elasticnet.elasticnet_coefficients(frame, features, horizon, alphas, ratios, tolerance)


def apply_coefficients(asked: DataFrame, coefficients: DataFrame) -> DataFrame:
    """intercept + sum of weight * (x - centre) / scale, for rows (ticker, horizon, phase, y, x).

    Any rows with these keys can be asked for, as often as wanted.
    """
    joined = asked.join(coefficients, KEYS)
    i = F.sequence(F.lit(0), F.size("x") - 1)

    def term(k: Column) -> Column:
        return F.get("weights", k) * ((F.get("x", k) - F.get("centres", k)) / F.get("scales", k))

    y_hat = F.col("intercept") + F.aggregate(i, F.lit(0.0), lambda total, k: total + term(k))
    extra = [c for c in ("alpha", "l1_ratio") if c in coefficients.columns]
    return joined.select("ticker", "horizon", F.col("phase").alias("role"), "y", y_hat.alias("y_hat"), *extra)


# --- neighbours --------------------------------------------------------------


def neighbour_rows(frame: DataFrame, features: list[str], horizon: int) -> DataFrame:
    """What the neighbours' model consists of: the labelled rows of every ticker and
    step with their segment, and the range of each column over either phase's rows.

    The phases share the rows: the one fitted on the training rows is a prefix.
    """
    rows = staged(frame, horizon).where(F.col("segment").isNotNull())
    group = Window.partitionBy("ticker", "horizon")

    def width(c: str, segment: int) -> Column:
        known = F.when(F.col("segment") <= segment, F.col(c))
        value = F.max(known).over(group) - F.min(known).over(group)
        return F.when(value == 0, 1.0).otherwise(value)

    ranges = [F.array(*[width(c, s) for c in features]).alias(f"{phase}_ranges") for phase, s in FITTED_ON.items()]
    x = F.array(*[F.col(c) for c in features]).alias("x")
    return rows.select("ticker", F.col("horizon").cast("int").alias("horizon"), "rn", "segment", "y", x, *ranges)


def apply_neighbours(asked: DataFrame, stored: DataFrame, chosen: DataFrame) -> DataFrame:
    """Mean label of the k nearest stored rows; ``chosen``: (ticker, horizon, k).

    The join is within a ticker and step, whose stored rows are bounded by the
    calendar; nearest rows are kept by a ranking that Spark limits before the shuffle.
    """
    pairs = asked.join(
        stored.select("ticker", "horizon", "rn", "segment", F.col("y").alias("label"), F.col("x").alias("near"), "validation_ranges", "test_ranges"),
        ["ticker", "horizon"],
    ).join(chosen, ["ticker", "horizon"])
    last = F.when(F.col("phase") == "test", FULL_SEGMENT).otherwise(TRAIN_SEGMENT)
    pairs = pairs.where(F.col("segment") <= last)
    ranges = F.when(F.col("phase") == "test", F.col("test_ranges")).otherwise(F.col("validation_ranges"))
    i = F.sequence(F.lit(0), F.size("x") - 1)

    def square(k: Column) -> Column:
        return F.pow((F.get("x", k) - F.get("near", k)) / F.get(ranges, k), F.lit(2))

    distance = F.aggregate(i, F.lit(0.0), lambda total, k: total + square(k))
    near = Window.partitionBy(*KEYS).orderBy("distance", "rn")
    ranked = pairs.select(*KEYS, "y", "k", "rn", "label", distance.alias("distance")).withColumn("rank", F.row_number().over(near))
    found = ranked.where(F.col("rank") <= F.col("k")).groupBy(*KEYS)
    found = found.agg(F.max("y").alias("y"), F.avg("label").alias("y_hat"), F.max("k").cast("int").alias("k"))
    return found.select("ticker", "horizon", F.col("phase").alias("role"), "y", "y_hat", "k")


def neighbour_choice(frame: DataFrame, features: list[str], horizon: int, ks: list[int]) -> DataFrame:
    predictions = knn.knn_predictions(frame, features, horizon, ks)
    if len(ks) == 1:
        return predictions.select("ticker", F.col("horizon").cast("int").alias("horizon"), F.lit(ks[0]).alias("k")).distinct()
    best = knn.choose_k(knn.fold_scores(predictions, ks))
    return best.select("ticker", F.col("horizon").cast("int").alias("horizon"), F.col("k").cast("int").alias("k"))


# --- the folder ---------------------------------------------------------------


class ModelStore:
    """Tables and saved trees below one folder that all executors share.

    What is written replaces what was there under the same name.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def place(self, *names: str) -> str:
        return "/".join([self.path, *names])

    def put(self, name: str, table: DataFrame) -> None:
        table.write.mode("overwrite").parquet(self.place(name))

    def get(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.place(name))

    # Every model has a fit that writes and a predict that only reads.

    def fit_linear(self, frame: DataFrame, features: list[str], horizon: int) -> None:
        self.put("Linear", linear_coefficients(frame, features, horizon))

    def fit_elasticnet(self, frame: DataFrame, features: list[str], horizon: int, **settings) -> None:
        self.put("ElasticNet", elasticnet_coefficients(frame, features, horizon, **settings))

    def fit_knn(self, frame: DataFrame, features: list[str], horizon: int, ks: list[int] = knn.NEIGHBOURS) -> None:
        self.put("KNN", neighbour_rows(frame, features, horizon))
        self.put("KNN_k", neighbour_choice(frame, features, horizon, ks))

    def fit_arima(self, frame: DataFrame, features: list[str], horizon: int) -> None:
        self.put("ARIMA", arima.coefficients(frame, horizon))

    def put_fits(self, name: str, fits: list[trees.Fit]) -> None:
        """Saved trees of every step and phase, and a table of what was chosen."""
        rows = []
        for fit in fits:
            for number, model in enumerate(fit.models):
                model.write().overwrite().save(self.place(name, f"h{fit.horizon}-{fit.phase}-{number}"))
            rows.append((fit.horizon, fit.phase, len(fit.models), fit.start, fit.step, fit.count))
        schema = "horizon int, phase string, models int, start double, step double, count int"
        self.put(f"{name}_fits", self.spark.createDataFrame(rows, schema))

    def get_fits(self, name: str, kind) -> list[trees.Fit]:
        fits = []
        for r in self.get(f"{name}_fits").orderBy("horizon", "phase").collect():
            models = [kind.load(self.place(name, f"h{r['horizon']}-{r['phase']}-{i}")) for i in range(r["models"])]
            fits.append(trees.Fit(r["horizon"], r["phase"], models, r["start"], r["step"], r["count"]))
        return fits

    def fit_gbt(self, frame: DataFrame, features: list[str], horizon: int, **settings) -> None:
        self.put_fits("XGB_GBT", trees.gbt_fits(frame, features, horizon, **settings))

    def fit_forest(self, frame: DataFrame, features: list[str], horizon: int, **settings) -> None:
        self.put_fits("LGB_RandomForest", trees.forest_fits(frame, features, horizon, **settings))

    def fit_goss(self, frame: DataFrame, features: list[str], horizon: int, **settings) -> None:
        self.put_fits("LGB_GOSS", goss.goss_fits(frame, features, horizon, **settings))

    def predict(self, model: str, frame: DataFrame, horizon: int) -> DataFrame:
        """Validation and test forecasts of the rows of ``frame`` by a stored model."""
        features = feature_columns(frame)
        if model in ("Linear", "ElasticNet"):
            return apply_coefficients(rows_asked(frame, features, horizon), self.get(model))
        if model == "KNN":
            return apply_neighbours(rows_asked(frame, features, horizon), self.get("KNN"), self.get("KNN_k"))
        if model == "ARIMA":
            return arima.apply_coefficients(frame, self.get("ARIMA"), horizon)
        kinds: dict[str, tuple[type, Callable]] = {
            "XGB_GBT": (GBTRegressionModel, trees.apply_fit),
            "LGB_RandomForest": (RandomForestRegressionModel, trees.apply_forest_fit),
            "LGB_GOSS": (DecisionTreeRegressionModel, goss.apply_fit),
        }
        if model not in kinds:
            raise ValueError(f"unknown model {model!r}")
        kind, apply = kinds[model]
        rows = materialize(pooled_asked(frame, features, horizon))
        tables = [apply(rows, fit) for fit in self.get_fits(model, kind)]
        return reduce(DataFrame.unionByName, [as_forecast(t) for t in tables])
