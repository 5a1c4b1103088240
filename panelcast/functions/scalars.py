"""Scalar column helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def trading_amount(close: Column, volume: Column) -> Column:
    return close * volume


def log1p_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """``log1p`` on those of ``names`` that the frame has."""
    present = [c for c in names if c in df.columns]
    return df.withColumns({c: F.log1p(c) for c in present})


def round_half_even(value: Column) -> Column:
    """Whole number nearest to ``value``; halves go to the even neighbour."""
    return F.rint(value)


def round_and_clamp(value: Column, low: Column, high: Column) -> Column:
    return F.least(F.greatest(F.rint(value), low), high)


def horizon_label(horizon: Column) -> Column:
    return F.concat(F.lit("time_gap_"), horizon.cast("string"))


def null_if_nan(df: DataFrame) -> DataFrame:
    """Replace NaN by NULL in every floating column, as Spark sorts NaN above all numbers."""
    floats = [c for c, t in df.dtypes if t in ("double", "float")]
    return df.withColumns({c: F.nanvl(F.col(c), F.lit(None).cast(df.schema[c].dataType)) for c in floats})
