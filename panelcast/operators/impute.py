"""Nearest-neighbour imputation of any table, within blocks of rows.

Rows with an open cell look for their neighbours among the rows of the same block
(a ticker, a segment, or the whole table). Open rows with equal values have the same
neighbours and are one question; of donors that differ in the asked column only, the
first k can be among the nearest.

Both are laid along a curve through the values and cut into tiles of a fixed number of
rows, whose ranges per column bound all distances between two tiles. A tile of questions
meets the tiles of donors that may hold one of the k nearest by these bounds, and no
others; ranges do not mix rows that know different columns. A task compares one tile of
questions with a bounded number of donors and gives the k nearest of them. Such lists
merge: the nearest of all are among the nearest of the tasks. So a block with any share
of the rows is spread over many tasks, nothing is approximate, and with few columns the
work grows with the rows. (With many columns that spread evenly, all tiles may be near.)
"""

from __future__ import annotations

from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from panelcast.functions.scalars import round_and_clamp
from panelcast.session import materialize

# Rows of a tile: donors, and questions of open rows. A task compares at most MEETING tiles
# of donors (by their rows) with one of questions, PART donors and CHUNK questions at a time.
DONORS, OPEN_ROWS = 4096, 2048
MEETING = 16
PART, CHUNK = 256, 512
# Bits of the curve's position, and the tasks over which a block's pairs of tiles are dealt.
BITS = 62
SALT = 16


def _squared_distances(rows: np.ndarray, donors: np.ndarray) -> np.ndarray:
    """Squared distance over the columns both sides know, scaled up to all columns.

    Pairs without a common column are infinitely far apart.
    """
    total = np.zeros((len(rows), len(donors)))
    shared = np.zeros((len(rows), len(donors)))
    for j in range(rows.shape[1]):
        gap = rows[:, j, None] - donors[None, :, j]
        known = ~np.isnan(gap)
        total += np.where(known, gap * gap, 0.0)
        shared += known
    scaled = total * (rows.shape[1] / np.where(shared > 0, shared, 1.0))
    return np.where(shared > 0, scaled, np.inf)


def _least_distances(rows: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """No donor with values from ``low`` to ``high`` is nearer to a row; rows by ranges.

    Sums are made as those of the distances, so rounding does not lift them above.
    """
    total = np.zeros((len(rows), len(low)))
    shared = np.zeros((len(rows), len(low)))
    for j in range(rows.shape[1]):
        known = ~np.isnan(rows[:, j, None]) & ~np.isnan(low[None, :, j])
        gap = np.maximum(np.maximum(rows[:, j, None] - high[None, :, j], low[None, :, j] - rows[:, j, None]), 0.0)
        total += np.where(known & ~np.isnan(gap), gap * gap, 0.0)
        shared += known
    return total * (rows.shape[1] / np.where(shared > 0, shared, 1.0))


def nearest_of_tiles(names: list[str], k: int):
    """(row, distance, place, value): the k nearest of some donors for every question of a
    tile; of equal distances the earlier places."""

    def run(rows: pa.Table, donors: pa.Table) -> pa.Table:
        if not rows.num_rows or not donors.num_rows:
            return pa.Table.from_arrays([pa.array([], t) for t in kinds], names=fields)
        known = donors.sort_by([("donor_mask", "ascending"), ("at", "ascending")])
        place, value, at = (known.column(c).to_numpy() for c in ("place", "value", "at"))
        ids, within = rows.column("row").to_numpy(), rows.column("within").to_numpy()
        x, d = (np.stack([t.column(c).to_numpy(zero_copy_only=False).astype(float) for c in names], axis=1) for t in (rows, known))
        # parts of a tile, whose rows are neighbours on the curve
        mask = known.column("donor_mask").combine_chunks().dictionary_encode().indices.to_numpy()
        tile = known.column("donor_tile").to_numpy()
        cut = np.concatenate([[True], (mask[1:] != mask[:-1]) | (tile[1:] != tile[:-1]) | (at[1:] // PART != at[:-1] // PART)])
        first = np.flatnonzero(cut)
        after = np.append(first[1:], len(d))
        low, high = np.fmin.reduceat(d, first), np.fmax.reduceat(d, first)
        parts = []
        for start in range(0, len(x), CHUNK):
            own = x[start : start + CHUNK]
            bound = _least_distances(own, low, high)
            nearest = bound.argmin(axis=1)
            distance = np.full((len(own), k), np.inf)
            donor = np.full((len(own), k), -1)
            for opening in (True, False):  # the nearest part first: it rules out most of the others
                for part in np.unique(nearest) if opening else range(len(first)):
                    limit = np.minimum(distance[:, -1], within[start : start + CHUNK])
                    asked = np.flatnonzero(nearest == part if opening else (nearest != part) & (bound[:, part] <= limit))
                    if not len(asked):
                        continue
                    new = np.arange(first[part], after[part])
                    both = np.concatenate([distance[asked], _squared_distances(own[asked], d[new])], axis=1)
                    who = np.concatenate([donor[asked], np.broadcast_to(new, (len(asked), len(new)))], axis=1)
                    order = np.lexsort((place[who], both), axis=1)[:, :k]
                    distance[asked] = np.take_along_axis(both, order, axis=1)
                    donor[asked] = np.take_along_axis(who, order, axis=1)
            row, rank = np.nonzero(np.isfinite(distance))
            donor = donor[row, rank]
            parts.append((ids[start + row], distance[row, rank], place[donor], value[donor]))
        columns = [np.concatenate(c) for c in zip(*parts)]
        return pa.Table.from_arrays([pa.array(c).cast(t) for c, t in zip(columns, kinds)], names=fields)

    fields = ["row", "distance", "place", "value"]
    kinds = [pa.int64(), pa.float64(), pa.int64(), pa.float64()]
    return run


def placed(df: DataFrame, order: list[str]) -> DataFrame:
    """Numbers the rows in the given order: ``place``. Partitions are ranges of the order,
    so no task sees all rows; the number grows with the order and has gaps."""
    spread = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return spread.withColumn("place", F.monotonically_increasing_id())


def known_columns(names: list[str]) -> Column:
    """A letter per column: unknown, infinite or a number."""
    infinite = lambda c: F.abs(c) == float("inf")
    return F.concat(*[F.when(F.col(c).isNull(), "0").when(infinite(c), "2").otherwise("1") for c in names])


def curve(names: list[str]) -> Column:
    """The position on a curve that keeps near rows near: the bits of all columns in turn,
    each within its block's range (``low_``, ``high_``). It decides on speed only."""
    bits = max(BITS // len(names), 1)
    position = []
    for j, c in enumerate(names[:BITS]):
        share = F.try_divide(F.col(c) - F.col(f"low_{c}"), F.col(f"high_{c}") - F.col(f"low_{c}"))
        share = F.least(F.greatest(F.nanvl(F.coalesce(share, F.lit(0.0)), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
        level = F.floor(share * float(2**bits - 1)).cast("long")
        # bit b of a column becomes bit b * len(names) + j
        for b in range(bits):
            bit = F.shiftright(level, b).bitwiseAND(F.lit(1).cast("long"))
            position.append(F.shiftleft(bit, b * min(len(names), BITS) + j))
    return reduce(add, position)


def tiled(df: DataFrame, names: list[str], size: int, own: str) -> DataFrame:
    """Adds ``at``, the place on the curve among rows that know the same columns, and the
    tiles that cut it: a tile is told by block, asked column, mask and number."""
    order = ["group", "column", f"{own}_mask", "position", *names]
    df = df.withColumn(f"{own}_mask", known_columns(names)).withColumn("position", curve(names))
    df = df.drop(*[f"{p}_{c}" for p in ("low", "high") for c in names])
    spread = df.repartitionByRange(*order, *(["place"] if "place" in df.columns else [])).sortWithinPartitions(*order)
    numbered = spread.withColumn("at", F.monotonically_increasing_id()).drop("position")
    return materialize(numbered.withColumn(f"{own}_tile", F.floor(F.col("at") / size).cast("long")))


def meetings(questions: DataFrame, donors: DataFrame, names: list[str], k: int, rows: int) -> DataFrame:
    """Tiles of questions and of donors that may hold one of the k nearest of a question.

    ``within``: k donors at least are not farther, for every question of the tile;
    ``meeting`` cuts the donors of a tile of questions into runs of about ``rows``.
    """
    block = ["group", "column"]

    def ranges(df: DataFrame, own: str) -> DataFrame:
        span = [f(c).alias(f"{own}_{p}_{c}") for c in names for p, f in (("low", F.min), ("high", F.max))]
        return df.groupBy(*block, f"{own}_mask", f"{own}_tile").agg(F.count(F.lit(1)).alias(f"{own}_n"), *span)

    asked = ranges(questions, "row").withColumn("salt", F.pmod(F.xxhash64("row_mask", "row_tile"), F.lit(SALT)))
    given = ranges(donors, "donor").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALT - 1).cast("long"))))
    pairs = asked.join(given, [*block, "salt"])
    shared = reduce(add, [F.col(f"row_low_{c}").isNotNull().cast("int") * F.col(f"donor_low_{c}").isNotNull().cast("int") for c in names])
    pairs = pairs.withColumn("shared", shared).where("shared > 0")
    scale = F.lit(float(len(names))) / F.col("shared")
    least, most = [], []
    for c in names:
        up = F.col(f"row_low_{c}") - F.col(f"donor_high_{c}"), F.col(f"donor_low_{c}") - F.col(f"row_high_{c}")
        gap = F.greatest(*[F.nanvl(x, F.lit(0.0)) for x in up], F.lit(0.0))
        wide = F.greatest(F.col(f"row_high_{c}") - F.col(f"donor_low_{c}"), F.col(f"donor_high_{c}") - F.col(f"row_low_{c}"))
        wide = F.nanvl(wide, F.lit(float("inf")))
        both = F.col(f"row_low_{c}").isNotNull() & F.col(f"donor_low_{c}").isNotNull()
        least.append(F.when(both, gap * gap).otherwise(0.0))
        most.append(F.when(both, wide * wide).otherwise(0.0))
    tile = [*block, "row_mask", "row_tile"]
    pairs = pairs.select(
        *tile, "donor_mask", "donor_tile", "donor_n",
        (reduce(add, least) * scale).alias("least"), (reduce(add, most) * scale).alias("most"),
    )
    upto = F.sum("donor_n").over(Window.partitionBy(*tile).orderBy("most"))
    pairs = pairs.withColumn("upto", upto)
    enough = F.min(F.when(F.col("upto") >= k, F.col("most"))).over(Window.partitionBy(*tile))
    near = pairs.withColumn("within", F.coalesce(enough, F.lit(float("inf")))).where("least <= within")
    before = Window.partitionBy(*tile).orderBy("least", "donor_mask", "donor_tile")
    meeting = F.floor((F.sum("donor_n").over(before) - F.col("donor_n")) / rows).cast("long")
    return near.select(*tile, "donor_mask", "donor_tile", "within", meeting.alias("meeting"))


def knn_impute(
    table: DataFrame,
    columns: list[str],
    categorical: list[str] | None = None,
    k: int = 5,
    donors: DataFrame | None = None,
    keys: list[str] = ("ticker", "date"),
    block: list[str] = ("ticker",),
    donor_rows: int = DONORS,
    open_rows: int = OPEN_ROWS,
) -> DataFrame:
    """Replace nulls of ``columns`` by the mean of the k nearest rows that know the column.

    ``keys`` tell rows apart and give the order by which equally near donors are taken;
    ``block`` are the columns whose values a row shares with its donors, none for the
    whole table. Neighbours come from ``donors`` (the fitted rows) if given, else from the
    table itself. NaN counts as null. A cell without a comparable donor gets the mean of
    its block, one of a block without any value stays null. Categorical columns are
    rounded and kept inside the range their block's donors have.
    """
    categorical = list(categorical or [])
    names, block, keys = list(columns), list(block), list(keys)
    value = [F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(c) for c in names]
    shown = list(dict.fromkeys([*block, *keys]))
    held = {c: f"_held_{c}" for c in shown}
    group = F.to_json(F.struct(*[F.col(held[c]) for c in block]), {"ignoreNullFields": "false"}) if block else F.lit("")

    def prepared(df: DataFrame) -> DataFrame:
        own = df.select(*[F.col(c).alias(h) for c, h in held.items()], *value)
        return materialize(placed(own, [held[c] for c in keys]).withColumn("group", group))

    rows = prepared(table)
    fitted = rows.select(*[F.col(c).alias(c) for c in rows.columns]) if donors is None else prepared(donors)

    stats = fitted.groupBy("group").agg(
        *[f(c).alias(f"{p}_{c}") for c in names for p, f in (("mean", F.avg), ("low", F.min), ("high", F.max))]
    )
    span = stats.select("group", *[f"{p}_{c}" for p in ("low", "high") for c in names])
    is_open = rows.agg(*[F.max(F.col(c).isNull()).alias(c) for c in names]).first()
    asked = [j for j, c in enumerate(names) if is_open[c]]

    # a row's open cells, and a donor's known ones among the columns that are asked for
    def told(df: DataFrame, wanted) -> DataFrame:
        cells = F.array(*[F.when(wanted(F.col(names[j])), F.lit(j)) for j in asked] or [F.lit(None).cast("int")])
        return df.withColumn("column", F.explode(F.filter(cells, lambda j: j.isNotNull())))

    gaps = told(rows, lambda c: c.isNull()).select("group", "column", "place", *names)
    questions = tiled(gaps.select("group", "column", *names).distinct().join(span, "group"), names, open_rows, "row")
    others = [F.when(F.col("column") != j, F.col(c)).alias(c) for j, c in enumerate(names)]
    cell = F.coalesce(*[F.when(F.col("column") == j, F.col(c)) for j, c in enumerate(names)])
    given = told(fitted, lambda c: c.isNotNull()).select("group", "column", "place", cell.alias("value"), *others)
    alike = Window.partitionBy("group", "column", *names).orderBy("place")
    given = given.withColumn("nth", F.row_number().over(alike)).where(F.col("nth") <= k).drop("nth")
    given = tiled(given.join(span, "group"), names, donor_rows, "donor")

    met = materialize(meetings(questions, given, names, k, MEETING * donor_rows))
    tile, meeting = ["group", "column", "row_mask", "row_tile"], ["group", "column", "row_mask", "row_tile", "meeting"]
    left = questions.withColumnRenamed("at", "row").join(met.select(*meeting, "within").distinct(), tile)
    right = given.join(met.drop("within"), ["group", "column", "donor_mask", "donor_tile"])
    near = (
        left.select(*meeting, "row", "within", *names)
        .groupBy(*meeting)
        .cogroup(right.select(*meeting, "donor_mask", "donor_tile", "at", "place", "value", *names).groupBy(*meeting))
        .applyInArrow(nearest_of_tiles(names, k), "row long, distance double, place long, value double")
    )
    first = Window.partitionBy("row").orderBy("distance", "place")
    near = near.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= k)
    answers = near.groupBy(F.col("row").alias("at")).agg(F.avg("value").alias("answer")).join(questions, "at")
    answers = answers.select("answer", *[F.col(c).alias(f"to_{c}") for c in ("group", "column", *names)])
    same = [F.col(c).eqNullSafe(F.col(f"to_{c}")) for c in ("group", "column", *names)]
    found = gaps.join(answers, reduce(lambda a, b: a & b, same)).groupBy(F.col("place").alias("row"))
    found = found.agg(*[F.max(F.when(F.col("column") == j, F.col("answer"))).alias(f"near_{c}") for j, c in enumerate(names)])

    filled = rows.join(found, F.col("place") == F.col("row"), "left").join(stats, "group", "left")
    out = []
    for c in names:
        cell = F.coalesce(c, f"near_{c}", f"mean_{c}")
        if c in categorical:
            cell = F.coalesce(round_and_clamp(cell, F.col(f"low_{c}"), F.col(f"high_{c}")), cell)
        out.append(cell.alias(c))
    return filled.select(*[F.col(h).alias(c) for c, h in held.items() if c not in names], *out)
