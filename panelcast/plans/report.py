"""Series behind the charts: actual closes followed by forecasts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from panelcast.operators.indicators import moving_average
from panelcast.operators.panel import tail_rows


def chart_series(closes: DataFrame, forecasts: DataFrame, average: int, tick: int) -> DataFrame:
    """Actual and predicted closes of a ticker in one series.

    ``closes`` has ticker, date, close; ``forecasts`` has ticker, date, forecast.
    Adds the moving average over the joined series, the first predicted date
    and every ``tick``-th day counted back from the last one.
    """
    actual = closes.select("ticker", "date", "close", F.lit("actual").alias("part"))
    predicted = forecasts.select(
        "ticker", "date", F.col("forecast").alias("close"), F.lit("predicted").alias("part")
    )
    series = actual.unionByName(predicted)
    whole = Window.partitionBy("ticker")
    back = Window.partitionBy("ticker").orderBy(F.desc("date"))
    first_predicted = F.min(F.when(F.col("part") == "predicted", F.col("date"))).over(whole)
    return series.select(
        "ticker",
        "date",
        "part",
        "close",
        moving_average(F.col("close"), average).alias("moving_average"),
        (F.col("date") == first_predicted).alias("is_boundary"),
        ((F.row_number().over(back) - 1) % tick == 0).alias("is_tick"),
    )


def whole_chart(closes: DataFrame, forecasts: DataFrame) -> DataFrame:
    """All history with the 20-day average and a tick every 20 days."""
    return chart_series(closes, forecasts, average=20, tick=20)


def recent_chart(closes: DataFrame, forecasts: DataFrame, horizon: int) -> DataFrame:
    """As many actual days as forecast days, 5-day average, a tick every 5 days."""
    return chart_series(tail_rows(closes, horizon), forecasts, average=5, tick=5)
