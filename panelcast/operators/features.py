"""Feature frame, lead targets, sequence windows, scaling and correlation."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from panelcast.functions.scalars import log1p_columns, trading_amount
from panelcast.operators.encoders import one_hot
from panelcast.operators.indicators import add_mfi, add_obv
from panelcast.operators.panel import by_date, drop_incomplete, lower_sorted, select_available

# Feature choice and transforms of the forecast job (fixed values).
SELECTED = ["date", "close", "kospi", "obv", "trading_amount", "mfi_signal"]
LOGGED = ["close", "kospi", "trading_amount"]
SIGNALS = ["buy", "sell"]


def dense_frame(panel: DataFrame) -> DataFrame:
    """Indicators on the filled panel, then complete rows only, with positions.

    ``price`` keeps the raw close, from which targets are taken.
    """
    with_amount = panel.withColumn("trading_amount", trading_amount(F.col("close"), F.col("volume")))
    indicated = add_mfi(add_obv(with_amount))
    trimmed = indicated.drop("mf", "p_n", "mfr", "open", "high", "low")
    return drop_incomplete(trimmed).withColumn("price", F.col("close"))


def feature_columns(df: DataFrame) -> list[str]:
    """Model inputs present in the frame, in sorted order."""
    wanted = {"close", "kospi", "obv", "trading_amount", *[f"mfi_signal_{s}" for s in SIGNALS]}
    return sorted(wanted & set(df.columns))


def feature_frame(dense: DataFrame) -> DataFrame:
    """Selected columns, log-transformed and one-hot encoded."""
    selected = select_available(lower_sorted(dense), SELECTED)
    logged = log1p_columns(selected, LOGGED)
    return one_hot(logged, {"mfi_signal": SIGNALS})


def model_frame(panel: DataFrame, others: list[str] = ()) -> DataFrame:
    """Keys, position, raw price and features: the input of every model.

    ``others`` are further columns of the dense frame to keep, those it has.
    """
    dense = dense_frame(panel)
    logged = log1p_columns(dense, LOGGED)
    encoded = one_hot(logged, {"mfi_signal": SIGNALS})
    features = [F.col(c).cast("double").alias(c) for c in feature_columns(encoded)]
    kept = [c for c in others if c in encoded.columns and c not in feature_columns(encoded)]
    return encoded.select("ticker", "date", "rn", "n", "price", *features, *kept)


def lead_targets(dense: DataFrame, horizon: int) -> DataFrame:
    """One row per day and step 0..horizon with the raw close that many rows later."""
    leads = F.array(*[F.lead("price", h).over(by_date()) for h in range(horizon + 1)])
    return dense.select("ticker", "date", leads.alias("_leads")).select(
        "ticker", "date", F.posexplode("_leads").alias("horizon", "y")
    )


def with_horizons(frame: DataFrame, horizon: int, first: int = 1) -> DataFrame:
    """Repeat every row for each step with its target ``y`` that many rows ahead."""
    steps = F.array(
        *[
            F.struct(F.lit(h).alias("horizon"), F.lead("price", h).over(by_date()).alias("y"))
            for h in range(first, horizon + 1)
        ]
    )
    return frame.withColumn("_steps", steps).select("*", F.inline("_steps")).drop("_steps")


def sequence_windows(frame: DataFrame, features: list[str], length: int = 5) -> DataFrame:
    """The last ``length`` feature rows of every day, with the last row's label."""
    steps = F.collect_list(F.array(*features)).over(by_date().rowsBetween(-(length - 1), 0))
    return frame.withColumn("sequence", steps).where(F.size("sequence") == length)


def centre_and_scale(column: Column, kind: str, group: WindowSpec) -> tuple[Column, Column]:
    """Mean and population deviation, or minimum and range; a scale of zero becomes one."""
    if kind == "standard":
        centre, scale = F.avg(column).over(group), F.stddev_pop(column).over(group)
    elif kind == "minmax":
        centre = F.min(column).over(group)
        scale = F.max(column).over(group) - centre
    else:
        raise ValueError(f"unknown scaler {kind!r}")
    return centre, F.when(scale == 0, 1.0).otherwise(scale)


def scale_split(split: DataFrame, columns: list[str], kind: str) -> DataFrame:
    """Scale every role by the statistics of the rows its model is fitted on.

    ``train`` serves itself and ``validation``, ``full`` itself and ``test``.
    The statistics are windows over a ticker's days, which already sit together.
    """
    fitted_on = F.when(F.col("role").isin("train", "validation"), "train").otherwise("full")
    group = Window.partitionBy("ticker", "horizon", "fitted_on")
    phased = split.withColumn("fitted_on", fitted_on)
    scaled = []
    for c in columns:
        fitted = F.when(F.col("role") == F.col("fitted_on"), F.col(c))
        centre, scale = centre_and_scale(fitted, kind, group)
        scaled.append(((F.col(c) - centre) / scale).alias(c))
    return phased.select("ticker", "date", "horizon", "role", *scaled)


def correlation_pairs(frame: DataFrame, columns: list[str], digits: int = 3) -> DataFrame:
    """Rounded correlation of every column pair per ticker, in one aggregation.

    A column without spread has no correlation, so its pairs are NULL.
    """

    def correlation(a: str, b: str):
        spread = F.stddev_pop(a) * F.stddev_pop(b)
        return F.try_divide(F.covar_pop(a, b), spread)

    pairs = list(combinations(sorted(columns), 2))
    wide = frame.groupBy("ticker").agg(
        F.array(
            *[
                F.struct(
                    F.lit(a).alias("col_a"),
                    F.lit(b).alias("col_b"),
                    F.round(correlation(a, b), digits).alias("corr"),
                )
                for a, b in pairs
            ]
        ).alias("pairs")
    )
    return wide.select("ticker", F.inline("pairs"))
