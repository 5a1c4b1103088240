"""Small hand-made and random panels for the unit tests."""

from __future__ import annotations

import numpy as np
import pandas as pd


def bars(closes, ticker="A", volumes=None, spread=1.0, start="2021-01-04"):
    """One bar per business day from the given closes."""
    n = len(closes)
    closes = np.asarray(closes, dtype=float)
    return pd.DataFrame(
        {
            "ticker": ticker,
            "date": pd.bdate_range(start, periods=n).date,
            "open": closes,
            "high": closes + spread,
            "low": closes - spread,
            "close": closes,
            "volume": np.asarray(volumes if volumes is not None else np.arange(1, n + 1), dtype=float),
        }
    )


def random_bars(rng, n, ticker="A"):
    """Coarse closes, so that ties are common."""
    frame = bars(rng.integers(8, 13, n), ticker, rng.integers(1, 6, n))
    frame["high"] = frame["close"] + rng.integers(0, 3, n)
    frame["low"] = frame["close"] - rng.integers(0, 3, n)
    return frame


SHAPES = {
    "equal": [10.0] * 20,
    "rising": list(range(1, 31)),
    "falling": list(range(40, 10, -1)),
    "thirteen": [5, 6, 5, 7, 7, 6, 5, 8, 9, 9, 4, 5, 6],
    "fourteen": [5, 6, 5, 7, 7, 6, 5, 8, 9, 9, 4, 5, 6, 7],
    "single": [3.0],
}


def shaped(rng):
    frames = [bars(closes, name) for name, closes in SHAPES.items()]
    frames += [random_bars(rng, int(rng.integers(2, 60)), f"random{i}") for i in range(20)]
    return pd.concat(frames, ignore_index=True)


def spark_frame(spark, pdf):
    """Spark copy with NaN as NULL."""
    return spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), schema=_schema(pdf))


def _schema(pdf):
    kinds = {"ticker": "string", "date": "date"}
    return ", ".join(f"{c} {kinds.get(c, 'double')}" for c in pdf.columns)


def by_ticker(df):
    """Collected rows per ticker, ordered by date."""
    pdf = df.toPandas().sort_values(["ticker", "date"])
    return {t: g.reset_index(drop=True) for t, g in pdf.groupby("ticker")}
