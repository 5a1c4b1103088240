"""Daily bars, investor flows and the index, derived from order trades.

Every order is one trade. Trades are combined into one row per ticker and day by
aggregates that Spark combines before the shuffle, so a ticker that holds a
large share of all trades still sends at most one row per day and map task.
Everything downstream has at most one row per ticker and calendar day; that
bounds a ticker's window partition by the length of the calendar (about 26,000
business days in a century) however many trades there are.
"""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from panelcast.session import materialize
from panelcast.sources.listing import padded_code
from panelcast.sources.tables import read_table

# Order priorities counted as institutional flow; all others count as foreign.
INSTITUTION_PRIORITIES = ["1-URGENT", "2-HIGH"]
PRICE = "decimal(18,2)"


@dataclass(frozen=True)
class Market:
    """The inputs of the panel; flows and index are optional sources.

    ``daily`` has bars and flows as whole rows, for a market that was read so.
    """

    bars: DataFrame
    flows: DataFrame | None = None
    index: DataFrame | None = None
    daily: DataFrame | None = None


def _orders(spark: SparkSession, folder: str, start: dt.date | None = None, end: dt.date | None = None) -> DataFrame:
    """Orders of ``[start, end]``; the range reaches the scan."""
    orders = read_table(spark, folder, "orders")
    if start is not None:
        orders = orders.where(F.col("o_orderdate") >= F.lit(start))
    if end is not None:
        orders = orders.where(F.col("o_orderdate") < F.lit(end + dt.timedelta(days=1)))
    return orders


def _trades(
    spark: SparkSession,
    folder: str,
    by: str,
    start: dt.date | None = None,
    end: dt.date | None = None,
    tickers: list[str] | None = None,
    ownerless: bool = False,
) -> DataFrame:
    """Trades with their ticker; the range and the tickers are filtered before the join.

    ``ownerless`` keeps trades whose owner is unknown, without a ticker.
    """
    orders = _orders(spark, folder, start, end).select(
        "o_orderkey",
        "o_custkey",
        "o_totalprice",
        "o_orderpriority",
        F.col("o_orderdate").cast("date").alias("date"),
    )
    customer = read_table(spark, folder, "customer")
    if by == "segment":
        owner = customer.select("c_custkey", F.col("c_mktsegment").alias("ticker"))
    elif by == "nation":
        nation = read_table(spark, folder, "nation")
        owner = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
            "c_custkey", F.col("n_name").alias("ticker")
        )
    elif by == "customer":
        owner = customer.select("c_custkey", padded_code(F.col("c_custkey")).alias("ticker"))
    else:
        raise ValueError(f"unknown ticker grain {by!r}; use 'segment', 'nation' or 'customer'")
    if tickers is not None:
        owner = owner.where(F.col("ticker").isin(tickers))
    return orders.join(owner, F.col("o_custkey") == F.col("c_custkey"), "left" if ownerless else "inner")


def _bar_columns():
    return [
        F.min_by("o_totalprice", "o_orderkey").alias("open"),
        F.max("o_totalprice").alias("high"),
        F.min("o_totalprice").alias("low"),
        F.max_by("o_totalprice", "o_orderkey").alias("close"),
        F.count(F.lit(1)).cast("double").alias("volume"),
    ]


def _flow_columns():
    institution = F.col("o_orderpriority").isin(INSTITUTION_PRIORITIES)
    return [
        F.count(F.when(institution, 1)).cast("double").alias("inst"),
        F.count(F.when(~institution, 1)).cast("double").alias("fore"),
    ]


def daily_bars(spark: SparkSession, folder: str, by: str = "segment") -> DataFrame:
    return _trades(spark, folder, by).groupBy("ticker", "date").agg(*_bar_columns())


def daily_flows(spark: SparkSession, folder: str, by: str = "segment") -> DataFrame:
    return _trades(spark, folder, by).groupBy("ticker", "date").agg(*_flow_columns())


def daily_index(
    spark: SparkSession, folder: str, start: dt.date | None = None, end: dt.date | None = None
) -> DataFrame:
    """Mean price per day of all orders, with or without a customer.

    Decimal sums do not depend on the row order.
    """
    orders = _orders(spark, folder, start, end)
    return orders.groupBy(F.col("o_orderdate").cast("date").alias("date")).agg(
        (F.sum(F.col("o_totalprice").cast(PRICE)).cast("double") / F.count(F.lit(1))).alias("kospi")
    )


def latest_day(spark: SparkSession, folder: str, by: str = "segment") -> dt.date | None:
    """The day of the market's last trade: two columns are scanned, one value comes to the driver.

    A request for a company that stopped trading before has the market's date.
    """
    return _trades(spark, folder, by).agg(F.max("date")).first()[0]


def load_market(
    spark: SparkSession,
    folder: str,
    by: str = "segment",
    start: dt.date | None = None,
    end: dt.date | None = None,
    tickers: list[str] | None = None,
) -> Market:
    """Bars and flows of the tickers and days asked for, from one pass over the trades.

    The daily table is run once and kept, because the spine, the flows and the
    request date all read it again. The index is that of the whole market; if all
    tickers are read it comes from the same table, whose rows without a ticker are the
    trades of unknown owners.
    """
    everyone = tickers is None
    price = F.col("o_totalprice").cast(PRICE)
    daily = materialize(
        _trades(spark, folder, by, start, end, tickers, ownerless=everyone)
        .groupBy("ticker", "date")
        .agg(*_bar_columns(), *_flow_columns(), F.sum(price).alias("_paid"))
    )
    if everyone:
        paid = F.sum("_paid").cast("double") / F.sum("volume").cast("long")
        index = daily.groupBy("date").agg(paid.alias("kospi"))
    else:
        index = daily_index(spark, folder, start, end)
    daily = daily.where(F.col("ticker").isNotNull()).drop("_paid")
    return Market(
        bars=daily.select("ticker", "date", "open", "high", "low", "close", "volume"),
        flows=daily.select("ticker", "date", "inst", "fore"),
        index=index,
        daily=daily,
    )


def bars_between(bars: DataFrame, start: dt.date | None, end: dt.date | None, tickers: list[str] | None = None) -> DataFrame:
    """Bars in ``[start, end]``, both ends included, of the given tickers."""
    if start is not None:
        bars = bars.where(F.col("date") >= F.lit(start))
    if end is not None:
        bars = bars.where(F.col("date") <= F.lit(end))
    if tickers is not None:
        bars = bars.where(F.col("ticker").isin(tickers))
    return bars


#: Rows of a stored file, which bounds a task of the writer and what a lookup reads.
ROWS_PER_FILE = 1 << 20


def write_bars(bars: DataFrame, path: str, rows_per_file: int = ROWS_PER_FILE) -> None:
    """Store bars in a folder per year, ordered by ticker and day.

    Rows are dealt by ranges of (year, ticker, date), about ``rows_per_file`` to each, so
    a year of all tickers is as many tasks and files as it needs, and sorted inside. A
    ticker's rows are next to each other then, and a lookup skips the files and row groups
    that have others. Years without a date are not stored.
    """
    stored = bars.where(F.col("date").isNotNull()).withColumn("year", F.year("date"))
    files = max(1, -(-stored.count() // rows_per_file))
    keys = ["year", "ticker", "date"]
    stored = stored.repartitionByRange(files, *keys).sortWithinPartitions(*keys)
    stored.write.mode("overwrite").partitionBy("year").parquet(path)


def stored_years(spark: SparkSession, path: str) -> list[int]:
    """The years of a bar store, from the names of its folders; no data is read."""
    files = spark.read.parquet(path).inputFiles()
    return sorted({int(year) for file in files for year in re.findall(r"/year=(\d+)/", file)})


def latest_stored_day(spark: SparkSession, path: str, tickers: list[str] | None = None) -> dt.date | None:
    """The last day of a bar store, of some tickers if asked for.

    Years are tried from the last one back, so usually one is read; a ticker that stopped
    trading has the last day of its own.
    """
    for year in reversed(stored_years(spark, path)):
        own = bars_between(spark.read.parquet(path).where(F.col("year") == year), None, None, tickers)
        latest = own.agg(F.max("date")).first()[0]
        if latest is not None:
            return latest
    return None


def read_bars(
    spark: SparkSession,
    path: str,
    start: dt.date | None = None,
    end: dt.date | None = None,
    tickers: list[str] | None = None,
) -> DataFrame:
    """Stored bars in ``[start, end]``: years prune folders, dates and tickers reach the scan."""
    stored = spark.read.parquet(path)
    if start is not None:
        stored = stored.where(F.col("year") >= start.year)
    if end is not None:
        stored = stored.where(F.col("year") <= end.year)
    return bars_between(stored, start, end, tickers).drop("year")
