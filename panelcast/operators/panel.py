"""The business-day panel: spine, forward fill, null handling.

A panel has at most one row per ticker and business day. All windows use the
same partitioning, so the plan shuffles on ``ticker`` once for all of them.
"""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import DataFrame, Observation, Window, WindowSpec, functions as F

from panelcast.functions.calendar import is_business_day
from panelcast.functions.scalars import null_if_nan
from panelcast.sources.market import Market, bars_between

KEYS = ["ticker", "date"]


def by_date() -> WindowSpec:
    return Window.partitionBy("ticker").orderBy("date")


def running() -> WindowSpec:
    """From a ticker's first row to the current one."""
    return by_date().rowsBetween(Window.unboundedPreceding, Window.currentRow)


def request_date(market: Market) -> dt.date:
    """Last business day on or before the latest bar: one value comes to the driver."""
    latest = market.bars.agg(F.max("date")).first()[0]
    return business_day_until(latest)


def business_day_until(latest: dt.date | None) -> dt.date:
    """The day itself or the Friday before a weekend."""
    if latest is None:
        raise ValueError("there are no bars")
    return latest - dt.timedelta(days=max(latest.weekday() - 4, 0))


def whole() -> WindowSpec:
    """All rows of a ticker, in the order the other windows sort by."""
    return by_date().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def whole_days(market: Market) -> DataFrame:
    """Bars and flows as one row per ticker and day, with ``_bar`` for days that have a bar.

    A market read in one pass has such rows already. Separate tables are laid one below
    the other, sent to their ticker once, and merged there; no join is needed.
    """
    if market.daily is not None:
        return null_if_nan(market.daily).withColumn("_bar", F.lit(True))
    bars = null_if_nan(market.bars).withColumn("_bar", F.lit(True))
    if market.flows is None:
        return bars
    rows = bars.unionByName(null_if_nan(market.flows), allowMissingColumns=True).repartition("ticker")
    values = [c for c in rows.columns if c not in KEYS]
    return rows.groupBy(*KEYS).agg(*[F.max(c).alias(c) for c in values])


def known_days(market: Market, start: dt.date | None, end: dt.date) -> DataFrame:
    """The business days in ``[start, end]`` with a row, from a ticker's first bar on.

    ``_until`` is the last day before the ticker's next row, or ``end``.
    """
    rows = bars_between(whole_days(market), start, end).where(is_business_day(F.col("date")))
    if market.flows is not None and market.daily is None:
        first_bar = F.min(F.when(F.col("_bar"), F.col("date"))).over(whole())
        rows = rows.withColumn("_first", first_bar).where(F.col("date") >= F.col("_first")).drop("_first")
    until = F.coalesce(F.date_sub(F.lead("date").over(by_date()), 1), F.lit(end))
    return rows.drop("_bar").withColumn("_until", until)


def expand_gaps(rows: DataFrame, carry: bool) -> DataFrame:
    """A row for each business day from a known one up to ``_until``.

    The days after the known one are null, or with ``carry`` have its values.
    """
    days = F.filter(F.sequence("date", "_until", F.expr("interval 1 day")), is_business_day)
    values = [c for c in rows.columns if c not in (*KEYS, "_until")]
    spread = rows.select("ticker", *values, F.posexplode(days).alias("_gap", "date"))
    shown = [F.col(c) if carry else F.when(F.col("_gap") == 0, F.col(c)).alias(c) for c in values]
    return spread.select(*KEYS, *shown)


def join_index(panel: DataFrame, market: Market, start: dt.date | None, end: dt.date) -> DataFrame:
    """Left-join the index by day.

    It is brought to one row per day, the highest value of a repeated day, and cut to
    the days asked for, so what is broadcast is no longer than the calendar.
    """
    if market.index is None:
        return panel
    index = bars_between(null_if_nan(market.index), start, end)
    levels = [F.max(c).alias(c) for c in index.columns if c != "date"]
    joined = panel.join(F.broadcast(index.groupBy("date").agg(*levels)), "date", "left")
    return joined.select(*KEYS, *[c for c in joined.columns if c not in KEYS])


def spine_join(market: Market, start: dt.date | None = None, end: dt.date | None = None) -> DataFrame:
    """Every business day from a ticker's first bar to ``end``, with its bar, flows and index.

    Weekend bars vanish and days without a bar become null rows. Bars and flows
    hold at most one row per ticker and day, and NaN counts as null. The days between
    two rows of a ticker come from the rows themselves, so the only shuffle is that of
    the rows to their ticker, and the only join that with the index.
    """
    end = end or request_date(market)
    return join_index(expand_gaps(known_days(market, start, end), carry=False), market, start, end)


def forward_fill(panel: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Carry the last known value of the columns (all but the keys); leading nulls stay."""
    filled = [c for c in panel.columns if c not in KEYS] if columns is None else columns
    return panel.select(
        *[
            F.last(c, ignorenulls=True).over(running()).alias(c) if c in filled else F.col(c)
            for c in panel.columns
        ],
    )


def build_panel(market: Market, start: dt.date | None = None, end: dt.date | None = None) -> DataFrame:
    """The filled panel: known rows are filled before the gaps between them are laid out,
    then only the index, whose days are its own, is filled on all days."""
    end = end or request_date(market)
    rows = known_days(market, start, end)
    own = [c for c in rows.columns if c not in (*KEYS, "_until")]
    panel = expand_gaps(forward_fill(rows, own), carry=True)
    joined = join_index(panel, market, start, end)
    return forward_fill(joined, [c for c in joined.columns if c not in panel.columns])


def null_audit(df: DataFrame) -> DataFrame:
    """One row: null cells per column and their total."""
    counts = {c: F.count(F.when(F.col(c).isNull(), 1)) for c in df.columns}
    total = reduce(lambda a, b: a + b, counts.values())
    return df.agg(
        *[n.alias(f"{c}_nulls") for c, n in counts.items()],
        total.alias("total_nulls"),
    )


def observed_nulls(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """The frame, and the null cells by column and in all, counted while it is used.

    The counts are there after the first action on the frame; they cost no job.
    """
    found = Observation(name)
    counts = {c: F.count(F.when(F.col(c).isNull(), 1)) for c in df.columns}
    total = reduce(lambda a, b: a + b, counts.values())
    return df.observe(found, *[n.alias(f"{c}_nulls") for c, n in counts.items()], total.alias("total_nulls")), found


def require_no_nulls(df: DataFrame, what: str) -> DataFrame:
    """The frame with a check in its plan: the first row with a null cell ends the job
    that reads it, with an error that names the table and the columns."""
    missing = F.filter(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in df.columns]), lambda c: c.isNotNull())
    message = F.concat(F.lit(f"{what} has null values in "), F.array_join(missing, ", "))
    return df.where(F.when(F.size(missing) > 0, F.raise_error(message).cast("boolean")).otherwise(F.lit(True)))


def drop_incomplete(df: DataFrame) -> DataFrame:
    """Drop rows with any null and number the rest from 0 within the ticker.

    Adds ``rn`` (position) and ``n`` (rows of the ticker) for positional slices.
    """
    kept = df.na.drop("any")
    return kept.withColumns(
        {
            "rn": (F.row_number().over(by_date()) - 1).cast("long"),
            "n": F.count(F.lit(1)).over(whole()),
        }
    )


def lower_sorted(df: DataFrame) -> DataFrame:
    """Lower-case names; keys first, the rest in alphabetical order."""
    lowered = df.toDF(*[c.lower() for c in df.columns])
    keys = [c for c in KEYS if c in lowered.columns]
    return lowered.select(*keys, *sorted(c for c in lowered.columns if c not in keys))


def select_available(df: DataFrame, wanted: list[str]) -> DataFrame:
    """Those of ``wanted`` that exist, sorted; missing ones are left out."""
    present = sorted(set(df.columns) & set(wanted))
    return df.select(*[c for c in KEYS if c in df.columns], *[c for c in present if c not in KEYS])


def min_history(panel: DataFrame, horizon: int) -> DataFrame:
    """Whether each ticker has at least three training days per horizon step."""
    required = F.lit(3 * horizon).cast("long")
    days = panel.groupBy("ticker").agg(F.count(F.lit(1)).alias("n_days"))
    return days.select("ticker", "n_days", required.alias("required"), (F.col("n_days") >= required).alias("enough"))


def stride_from_end(df: DataFrame, *steps: int) -> DataFrame:
    """Every ``step``-th row of a ticker, counted back from its last row.

    With several steps a row comes once for each it falls on, and ``step`` tells which;
    the rows are numbered once for all of them.
    """
    back = Window.partitionBy("ticker").orderBy(F.desc("date"))
    numbered = df.withColumn("_back", F.row_number().over(back) - 1)
    if len(steps) == 1:
        return numbered.where(F.col("_back") % steps[0] == 0).drop("_back")
    hit = F.filter(F.array(*[F.lit(s).cast("long") for s in steps]), lambda s: F.col("_back") % s == 0)
    return numbered.withColumn("step", F.explode(hit)).drop("_back")


def tail_rows(df: DataFrame, count: int) -> DataFrame:
    """The last ``count`` rows of every ticker."""
    back = Window.partitionBy("ticker").orderBy(F.desc("date"))
    return df.withColumn("_back", F.row_number().over(back)).where(F.col("_back") <= count).drop("_back")
