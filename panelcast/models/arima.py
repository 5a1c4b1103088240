"""ARIMA(1,2,0) without constant, by Burg's estimate of the coefficient."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from panelcast.operators.panel import by_date, running, whole


def arima_forecast(frame: DataFrame, horizon: int) -> DataFrame:
    """Validation and test forecasts for every step.

    ``w`` is the second difference of the price. phi is twice the sum of products
    of neighbours over the sum of both their squares, which keeps it between -1 and
    1 on every series. Running sums give phi for every training length at once:
    validation of step h learns from all but the last h rows and is compared
    with the last row; the forecast learns from all rows.
    """
    return apply_phi(moves(frame, horizon), horizon)


def moves(frame: DataFrame, horizon: int) -> DataFrame:
    """The last rows of every ticker with first and second difference and the phi of
    all rows up to them."""
    price = F.col("price")
    first = F.lag(price, 1).over(by_date())
    second = F.lag(price, 2).over(by_date())
    moved = frame.select("ticker", "date", "rn", "n", "price").withColumns(
        {"d": price - first, "w": price - 2 * first + second}
    )
    before = F.lag("w").over(by_date())
    return (
        moved.withColumn("w_before", before)
        .withColumns(
            {
                "up": F.sum(2 * F.col("w") * F.col("w_before")).over(running()),
                "down": F.sum(F.col("w") * F.col("w") + F.col("w_before") * F.col("w_before")).over(running()),
                "last_price": F.max_by("price", "rn").over(whole()),
            }
        )
        .withColumn("phi", F.try_divide("up", "down"))
        .where(F.col("rn") >= F.col("n") - 1 - horizon)
        .withColumn("back", (F.col("n") - 1 - F.col("rn")).cast("int"))
    )


def coefficients(frame: DataFrame, horizon: int) -> DataFrame:
    """phi of every ticker, step and phase, as a table."""
    rows = moves(frame, horizon).select("ticker", "back", "phi")
    steps = F.sequence(F.lit(1), F.lit(horizon))
    test = rows.where("back = 0").select("ticker", F.explode(steps).alias("horizon"), F.lit("test").alias("phase"), "phi")
    own = rows.where("back > 0").select("ticker", F.col("back").alias("horizon"), F.lit("validation").alias("phase"), "phi")
    return test.unionAll(own)


def apply_coefficients(frame: DataFrame, stored: DataFrame, horizon: int) -> DataFrame:
    """Forecasts from the last rows of ``frame`` with given phi."""
    rows = moves(frame, horizon).drop("phi")
    test = stored.where("phase = 'test' AND horizon = 1").select("ticker", F.lit(0).alias("back"), "phi")
    own = stored.where("phase = 'validation'").select("ticker", F.col("horizon").alias("back"), "phi")
    return apply_phi(rows.join(test.unionAll(own), ["ticker", "back"]), horizon)


def apply_phi(fitted: DataFrame, horizon: int) -> DataFrame:
    """The last row of a ticker forecasts every step, the row h before it step h."""
    all_steps = F.sequence(F.lit(1), F.lit(horizon))
    steps = F.when(F.col("back") == 0, all_steps).otherwise(F.array("back"))
    spread = fitted.withColumn("horizon", F.explode(steps))
    momentum = F.aggregate(
        F.sequence(F.lit(1), F.col("horizon")),
        F.lit(0.0),
        lambda total, j: total + (F.col("horizon") - j + 1) * F.pow(F.col("phi"), j),
    )
    y_hat = F.col("price") + F.col("horizon") * F.col("d") + F.col("w") * momentum
    is_test = F.col("back") == 0
    return spread.select(
        "ticker",
        "horizon",
        F.when(is_test, "test").otherwise("validation").alias("role"),
        F.when(~is_test, F.col("last_price")).alias("y"),
        y_hat.alias("y_hat"),
        "phi",
    )
