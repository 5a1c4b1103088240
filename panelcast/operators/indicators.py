"""Technical indicators as windows over one ticker's business days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelcast.operators.panel import by_date, running, whole


def add_obv(panel: DataFrame, ties: str = "add") -> DataFrame:
    """On-balance volume from 0 at the first row, which itself is NULL.

    With ``ties="add"`` an unchanged close adds the volume; ``"zero"`` is the
    textbook rule.
    """
    if ties not in ("add", "zero"):
        raise ValueError(f"unknown rule {ties!r} for unchanged closes")
    previous = F.lag("close").over(by_date())
    close, volume = F.col("close"), F.col("volume")
    step = F.when(close > previous, volume).when(close < previous, -volume)
    step = step.when(close == previous, volume if ties == "add" else F.lit(0.0))
    return (
        panel.withColumn("_step", step)
        .withColumn("obv", F.sum("_step").over(running()))
        .drop("_step")
    )


def add_money_flow(panel: DataFrame) -> DataFrame:
    """``mf`` = volume times typical price; ``p_n`` tells whether it rose."""
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3
    with_flow = panel.withColumn("mf", F.col("volume") * typical)
    previous = F.lag("mf").over(by_date())
    return with_flow.withColumn(
        "p_n", F.when(F.col("mf") >= previous, "p").when(F.col("mf") < previous, "n")
    )


def add_mfi(panel: DataFrame, days: int = 14) -> DataFrame:
    """Money flow ratio, index and buy/sell signal.

    The ratio looks at the ``days - 1`` rows before the current one. It is
    smoothed by 1 above and 10 below, and NULL for the first ``days - 1`` rows.
    """
    frame = by_date().rowsBetween(-(days - 1), -1)

    def flow(sign: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("p_n") == sign, F.col("mf"))).over(frame), F.lit(0.0))

    ratio = F.when(F.row_number().over(by_date()) >= days, (flow("p") + 1) / (flow("n") + 10))
    return (
        add_money_flow(panel)
        .withColumn("mfr", ratio)
        .withColumn("mfi", 100 - 100 / (1 + F.col("mfr")))
        .withColumn("mfi_signal", F.when(F.col("mfi") > 50, "buy").otherwise("sell"))
    )


def moving_average(value: Column, window: int) -> Column:
    """Mean of the last ``window`` rows; NULL until all of them are known."""
    frame = by_date().rowsBetween(-(window - 1), 0)
    return F.when(F.count(value).over(frame) >= window, F.avg(value).over(frame))


def rolling_extreme(value: Column, window: int, kind: str) -> Column:
    """Rolling ``max`` or ``min``; NULL until ``window`` values are known."""
    frame = by_date().rowsBetween(-(window - 1), 0)
    extreme = {"max": F.max, "min": F.min}[kind]
    return F.when(F.count(value).over(frame) >= window, extreme(value).over(frame))


EWM_BLOCK = 64


def ewm_mean(df: DataFrame, column: str, span: int, name: str) -> DataFrame:
    """Exponentially weighted mean with ``min_periods = span``.

    Weights fall by a constant factor for every row back, null rows included,
    and are normalised over the known values. Every row counts, however old: rows
    are summed within blocks, blocks are carried over to later ones, and a row adds
    the carry of its block to its own block's sums. At a null row all weights
    shrink alike, so the mean stays what it was.
    """
    decay = F.lit(1 - 2 / (span + 1))
    inside = Window.partitionBy("ticker", "_block").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("ticker").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    known = F.col(column).isNotNull()

    def decayed(rows: Column, age) -> Column:
        empty = F.struct(F.lit(0.0).alias("xw"), F.lit(0.0).alias("w"))
        return F.aggregate(
            rows,
            empty,
            lambda total, r: F.struct(
                (total["xw"] + r["xw"] * F.pow(decay, age(r))).alias("xw"),
                (total["w"] + r["w"] * F.pow(decay, age(r))).alias("w"),
            ),
        )

    placed = df.withColumn("_pos", F.row_number().over(by_date()) - 1)
    placed = placed.withColumn("_block", F.floor(F.col("_pos") / EWM_BLOCK))
    one = F.when(known, F.struct(F.col("_pos").alias("pos"), F.col(column).alias("xw"), F.lit(1.0).alias("w")))
    placed = placed.withColumns(
        {"_recent": F.collect_list(one).over(inside), "_known": F.count(column).over(running())}
    )
    back = F.pow(decay, (F.col("_block") + 1) * EWM_BLOCK - 1 - F.col("_pos"))
    blocks = placed.groupBy("ticker", "_block").agg(
        F.coalesce(F.sum(F.col(column) * back), F.lit(0.0)).alias("xw"),
        F.coalesce(F.sum(F.when(known, back)), F.lit(0.0)).alias("w"),
    )
    before = F.collect_list(F.struct(F.col("_block").alias("block"), "xw", "w")).over(earlier)
    carried = blocks.withColumn("_before", before).select(
        "ticker",
        "_block",
        decayed(F.col("_before"), lambda r: (F.col("_block") - 1 - r["block"]) * EWM_BLOCK).alias("_carry"),
    )
    own = decayed(F.col("_recent"), lambda r: F.col("_pos") - r["pos"])
    since = F.pow(decay, F.col("_pos") - F.col("_block") * EWM_BLOCK + 1)
    mean = (F.col("_own.xw") + F.col("_carry.xw") * since) / (F.col("_own.w") + F.col("_carry.w") * since)
    return (
        placed.join(carried, ["ticker", "_block"])
        .withColumn("_own", own)
        .withColumn("_mean", F.when(known & (F.col("_known") >= span), mean))
        .withColumn(name, F.last("_mean", ignorenulls=True).over(running()))
        .select(*[c for c in df.columns if c != name], name)
    )


def add_stochastic(panel: DataFrame, n: int = 14, m: int = 5, t: int = 5) -> DataFrame:
    """``fast_k`` and its two smoothings; ``fast_d`` equals ``slow_k``."""
    high = rolling_extreme(F.col("high"), n, "max")
    low = rolling_extreme(F.col("low"), n, "min")
    bounded = panel.withColumns({"_high": high, "_low": low})
    fast_k = F.try_divide(F.col("close") - F.col("_low"), F.col("_high") - F.col("_low")) * 100
    fast = bounded.withColumn("fast_k", fast_k).drop("_high", "_low")
    slow = ewm_mean(fast, "fast_k", m, "slow_k")
    slower = ewm_mean(slow, "slow_k", t, "slow_d")
    return slower.withColumn("fast_d", F.col("slow_k"))


def crossover_signal(df: DataFrame, first: str, second: str, patience: int, name: str = "signal") -> DataFrame:
    """Buy when ``first`` is above ``second`` and the next closes confirm it.

    A buy needs each of the next ``patience`` closes (fewer at the end) to be
    higher, a sell needs them lower. The signal holds until the opposite one.
    Rows between the very first row and the first signal get its opposite.
    """
    ahead = by_date().rowsBetween(1, patience) if patience else None
    close = F.col("close")
    if ahead is None:
        rises = falls = F.lit(True)
    else:
        rises = F.coalesce(F.min("close").over(ahead) > close, F.lit(True))
        falls = F.coalesce(F.max("close").over(ahead) < close, F.lit(True))
    candidate = F.when((F.col(first) > F.col(second)) & rises, "buy").when(
        (F.col(first) < F.col(second)) & falls, "sell"
    )
    opening = F.first("_candidate", ignorenulls=True).over(whole())
    opposite = F.when(opening == "buy", "sell").when(opening == "sell", "buy")
    held = F.last("_candidate", ignorenulls=True).over(running())
    before_first = F.when(F.row_number().over(by_date()) > 1, opposite)
    return (
        df.withColumn("_candidate", candidate)
        .withColumn(name, F.coalesce(held, before_first))
        .drop("_candidate")
    )
