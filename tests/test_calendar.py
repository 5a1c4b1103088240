import datetime as dt

import numpy as np
import pandas as pd
from pandas.tseries.offsets import BDay
from pyspark.sql import functions as F

from panelcast.functions import calendar, scalars
from panelcast.plans.forecast import training_start


def test_shifts_match_pandas(spark):
    days = pd.date_range("2020-01-01", "2021-12-31")
    df = spark.createDataFrame([(d.date(),) for d in days], "d date").crossJoin(
        spark.createDataFrame([(n,) for n in (1, 2, 5, 7, 20, 30, 250)], "n int")
    )
    rows = df.select(
        "d",
        "n",
        calendar.add_business_days(F.col("d"), F.col("n")).alias("plus"),
        calendar.subtract_business_days(F.col("d"), F.col("n")).alias("minus"),
    ).collect()
    for r in rows:
        assert r["plus"] == (pd.Timestamp(r["d"]) + BDay(r["n"])).date()
        assert r["minus"] == (pd.Timestamp(r["d"]) - BDay(r["n"])).date()


def test_business_days_between(spark):
    start, end = dt.date(2021, 1, 1), dt.date(2021, 3, 7)
    df = spark.createDataFrame([("A", start, end), ("B", end, start)], "ticker string, a date, b date")
    got = [r["date"] for r in calendar.explode_business_days(df, "a", "b").orderBy("date").collect()]
    assert got == [d.date() for d in pd.bdate_range(start, end)]


def test_week_of_month_counts_back(spark):
    days = [d.date() for d in pd.date_range("2020-01-01", "2021-12-31")]
    df = spark.createDataFrame([(d,) for d in days], "d date")
    for r in df.select("d", calendar.week_of_month(F.col("d")).alias("w")).collect():
        weeks, day = 0, r["d"]
        while day.month == r["d"].month:
            weeks += 1
            day -= dt.timedelta(days=7)
        assert r["w"] == weeks


def test_date_text(spark):
    df = spark.createDataFrame([("2021-10-29",), ("20211029",)], "s string")
    parsed = calendar.parse_compact_date(F.col("s"))
    rows = df.select(parsed.alias("d"), calendar.format_compact_date(parsed).alias("t")).collect()
    assert all(r["d"] == dt.date(2021, 10, 29) and r["t"] == "20211029" for r in rows)


def test_training_start_matches_pandas():
    for day in pd.date_range("2021-01-01", "2021-01-20"):
        for n in (1, 5, 250):
            assert training_start(day.date(), n) == (day - BDay(n)).date()


def test_rounding_is_half_even(spark):
    values = [0.5, 1.5, 2.5, -0.5, -1.5, 2.4999]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = [r[0] for r in df.select(scalars.round_half_even(F.col("v"))).collect()]
    assert got == np.round(values).tolist()


def test_nan_becomes_null(spark):
    df = spark.createDataFrame([(float("nan"), 1), (2.0, 2)], "v double, k int")
    assert [r["v"] for r in scalars.null_if_nan(df).orderBy("k").collect()] == [None, 2.0]
