"""The forecast job: request parameters to forecasts and scores for all tickers."""

from __future__ import annotations

import datetime as dt
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from panelcast.functions.calendar import add_business_days
from panelcast.functions.errors import error_measures
from panelcast.functions.scalars import round_half_even
from panelcast.models.arima import arima_forecast
from panelcast.models.elasticnet import elasticnet_forecast
from panelcast.models.goss import goss_forecast
from panelcast.models.knn import knn_tuned
from panelcast.models.linear import linear_forecast
from panelcast.models.trees import forest_forecast, gbt_forecast
from panelcast.operators.features import feature_columns, model_frame
from panelcast.operators.panel import build_panel, business_day_until, request_date
from panelcast.session import materialize
from panelcast.sources.market import Market, latest_day, load_market

PREDICTION = ["ticker", "model", "horizon", "role", "y", "y_hat"]


MODELS = {
    "Linear": linear_forecast,
    "ElasticNet": elasticnet_forecast,
    "KNN": knn_tuned,
    "XGB_GBT": gbt_forecast,
    "LGB_RandomForest": forest_forecast,
    "LGB_GOSS": goss_forecast,
    "ARIMA": lambda frame, features, horizon: arima_forecast(frame, horizon),
}
#: Settings by model, passed on to its function: numbers of trees, grids, patience.
Settings = dict[str, dict]


def training_start(end: dt.date, train_period: int) -> dt.date:
    """``train_period`` business days before ``end``."""
    return np.busday_offset(np.datetime64(end), -train_period, roll="forward").astype(dt.date)


def load_request(
    spark: SparkSession, folder: str, train_period: int, by: str = "segment", tickers: list[str] | None = None
) -> tuple[Market, dt.date]:
    """The market of a request and its date: only its days and tickers are read."""
    end = business_day_until(latest_day(spark, folder, by))
    return load_market(spark, folder, by, training_start(end, train_period), end, tickers), end


def load_frame(market: Market, end: dt.date | None = None, train_period: int | None = None) -> DataFrame:
    """The model frame of a request, run once; every model reads the same copy.

    Without ``train_period`` the whole history is used. Rows stay partitioned by
    ticker, so the models' windows and aggregations need no further shuffle.
    """
    end = end or request_date(market)
    start = training_start(end, train_period) if train_period else None
    return materialize(model_frame(build_panel(market, start, end)))


def predict(frame: DataFrame, models: list[str], horizon: int, settings: Settings | None = None) -> DataFrame:
    """Validation and test predictions of the named models."""
    if horizon < 1:
        raise ValueError("horizon must be at least 1")
    unknown = [m for m in models if m not in MODELS]
    if unknown or not models:
        raise ValueError(f"unknown models {unknown}; choose from {sorted(MODELS)}")
    features = feature_columns(frame)
    tables = [
        MODELS[name](frame, features, horizon, **(settings or {}).get(name, {}))
        .withColumn("model", F.lit(name))
        .select(*PREDICTION)
        for name in models
    ]
    return reduce(DataFrame.unionByName, tables)


def performance(predictions: DataFrame, running_times: dict[str, float] | None = None) -> DataFrame:
    """Scores of the validation rows.

    The job has no timers: seconds per model come from ``running_times``, else they are NULL.
    """
    seconds = F.lit(None).cast("double")
    for model, taken in (running_times or {}).items():
        seconds = F.when(F.col("model") == model, float(taken)).otherwise(seconds)
    validation = predictions.where(F.col("role") == "validation")
    measures = [e.alias(c) for c, e in error_measures().items()]
    scored = validation.groupBy("ticker", "model", "horizon").agg(*measures)
    return scored.withColumn("running_time", seconds)


def forecast_table(predictions: DataFrame, end: dt.date) -> DataFrame:
    """Rounded test predictions, dated by business days after the request date."""
    return predictions.where(F.col("role") == "test").select(
        "ticker",
        "model",
        "horizon",
        add_business_days(F.lit(end), F.col("horizon")).alias("date"),
        round_half_even(F.col("y_hat")).alias("forecast"),
    )


def forecast_job(
    market: Market,
    models: list[str],
    horizon: int,
    end: dt.date | None = None,
    train_period: int | None = None,
    settings: Settings | None = None,
) -> DataFrame:
    """Forecast and validation score per ticker, model and step, in one aggregation."""
    end = end or request_date(market)
    predictions = predict(load_frame(market, end, train_period), models, horizon, settings)
    measures = [e.alias(c) for c, e in error_measures().items()]
    is_test = F.col("role") == "test"
    rows = predictions.groupBy("ticker", "model", "horizon").agg(
        *measures, F.max(F.when(is_test, F.col("y_hat"))).alias("y_hat")
    )
    return rows.select(
        "ticker",
        "model",
        "horizon",
        add_business_days(F.lit(end), F.col("horizon")).alias("date"),
        round_half_even(F.col("y_hat")).alias("forecast"),
        *error_measures(),
    )
