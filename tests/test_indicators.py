"""Window indicators against plain loops over each series."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from series import bars, by_ticker, shaped, spark_frame

from panelcast.operators import indicators


@pytest.fixture(scope="module")
def data():
    return shaped(np.random.default_rng(7))


def same(got, want, tol=1e-9):
    for a, b in zip(got, want, strict=True):
        if b is None or (isinstance(b, float) and np.isnan(b)):
            assert a is None or pd.isna(a)
        else:
            assert a == pytest.approx(b, rel=tol, abs=tol)


@pytest.mark.parametrize("ties", ["add", "zero"])
def test_obv(spark, data, ties):
    got = by_ticker(indicators.add_obv(spark_frame(spark, data), ties))
    for ticker, g in data.groupby("ticker"):
        close, volume = g["close"].tolist(), g["volume"].tolist()
        total, want = 0.0, [np.nan]
        for i in range(1, len(close)):
            if close[i] > close[i - 1] or (close[i] == close[i - 1] and ties == "add"):
                total += volume[i]
            elif close[i] < close[i - 1]:
                total -= volume[i]
            want.append(total)
        same(got[ticker]["obv"], want)


def test_obv_rejects_unknown_rule(spark, data):
    with pytest.raises(ValueError):
        indicators.add_obv(spark_frame(spark, data), "other")


def test_mfi(spark, data):
    got = by_ticker(indicators.add_mfi(spark_frame(spark, data)))
    for ticker, g in data.groupby("ticker"):
        flow = (g["volume"] * (g["high"] + g["low"] + g["close"]) / 3).tolist()
        rose = [None] + [flow[i] >= flow[i - 1] for i in range(1, len(flow))]
        want, signal = [], []
        for i in range(len(flow)):
            if i < 13:
                want.append(np.nan)
            else:
                up = sum(flow[j] for j in range(i - 13, i) if rose[j] is True)
                down = sum(flow[j] for j in range(i - 13, i) if rose[j] is False)
                want.append(100 - 100 / (1 + (up + 1) / (down + 10)))
            signal.append("buy" if want[-1] > 50 else "sell")
        same(got[ticker]["mfi"], want)
        assert got[ticker]["mfi_signal"].tolist() == signal


@pytest.mark.parametrize("window", [5, 20])
def test_moving_average(spark, data, window):
    df = spark_frame(spark, data).withColumn("ma", indicators.moving_average(F.col("close"), window))
    for ticker, g in by_ticker(df).items():
        same(g["ma"], g["close"].rolling(window, min_periods=window).mean())


def test_stochastic(spark, data):
    flat = data.copy()
    flat.loc[flat["ticker"] == "equal", ["high", "low"]] = 10.0
    got = by_ticker(indicators.add_stochastic(spark_frame(spark, flat)))
    for ticker, g in flat.groupby("ticker"):
        high = g["high"].rolling(14, min_periods=14).max()
        low = g["low"].rolling(14, min_periods=14).min()
        fast = ((g["close"] - low) / (high - low) * 100).replace([np.inf, -np.inf], np.nan)
        slow = fast.ewm(span=5, min_periods=5).mean()
        slower = slow.ewm(span=5, min_periods=5).mean()
        same(got[ticker]["fast_k"], fast)
        same(got[ticker]["slow_k"], slow)
        same(got[ticker]["fast_d"], slow)
        same(got[ticker]["slow_d"], slower)


@pytest.mark.parametrize("span", [2, 5, 12])
def test_ewm_with_inner_nulls(spark, span):
    rng = np.random.default_rng(span)
    frame = bars(rng.normal(100, 10, 400))
    frame.loc[rng.random(400) < 0.3, "close"] = np.nan
    got = by_ticker(indicators.ewm_mean(spark_frame(spark, frame), "close", span, "ewm"))["A"]
    same(got["ewm"], frame["close"].ewm(span=span, min_periods=span).mean(), 1e-12)


def crossover_loop(first, second, close, patience):
    signal, state = [], None
    for i in range(len(close)):
        ahead = close[i + 1 : i + patience + 1]
        value = None
        if first[i] > second[i] and state != "buy" and all(c > close[i] for c in ahead):
            value = state = "buy"
        elif first[i] < second[i] and state != "sell" and all(c < close[i] for c in ahead):
            value = state = "sell"
        signal.append(value)
    start = next((i for i, v in enumerate(signal) if v), None)
    if start is not None:
        for i in range(1, start):
            signal[i] = "sell" if signal[start] == "buy" else "buy"
    last = None
    for i, v in enumerate(signal):
        last = v or last
        signal[i] = last
    return signal


@pytest.mark.parametrize("patience", [0, 1, 2, 3])
def test_crossover(spark, patience):
    rng = np.random.default_rng(patience)
    frames = []
    for i in range(60):
        n = int(rng.integers(1, 25))
        g = bars(rng.integers(1, 6, n), f"t{i}")
        g["fast"], g["slow"] = rng.integers(0, 4, n).astype(float), rng.integers(0, 4, n).astype(float)
        g.loc[: n // 4, "slow"] = np.nan
        frames.append(g)
    data = pd.concat(frames, ignore_index=True)
    got = by_ticker(indicators.crossover_signal(spark_frame(spark, data), "fast", "slow", patience))
    for ticker, g in data.groupby("ticker"):
        want = crossover_loop(g["fast"].tolist(), g["slow"].tolist(), g["close"].tolist(), patience)
        assert [v if isinstance(v, str) else None for v in got[ticker]["signal"]] == want


def test_ewm_forgets_nothing(spark):
    frame = bars([1e20] + [1.0] * 299)
    got = by_ticker(indicators.ewm_mean(spark_frame(spark, frame), "close", 5, "ewm"))["A"]
    same(got["ewm"], frame["close"].ewm(span=5, min_periods=5).mean(), 1e-9)
