"""Walk-forward splits and folds by row position.

With N complete rows and horizon g the label of a row is the close g rows later:

* ``test``        the last row, whose label is not known yet;
* ``full``        all rows with a known label;
* ``validation``  the last row with a known label;
* ``train``       rows whose labels were known at the validation row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from panelcast.operators.features import with_horizons

FOLDS = 5
TEST_SIZE = 1
GAP = 1


def walk_forward(frame: DataFrame, horizon: int) -> DataFrame:
    """One row per day, step and role; a day can play several roles."""
    rn, n, g = F.col("rn"), F.col("n"), F.col("horizon")
    roles = F.filter(
        F.array(
            F.when(rn == n - 1, "test"),
            F.when(rn <= n - g - 1, "full"),
            F.when(rn == n - g - 1, "validation"),
            F.when(rn <= n - 2 * g - 1, "train"),
        ),
        lambda role: role.isNotNull(),
    )
    stepped = with_horizons(frame, horizon)
    return stepped.withColumn("role", F.explode(roles))


def time_series_folds(train: DataFrame, keys: list[str], folds: int = FOLDS) -> DataFrame:
    """Expanding folds over the training rows.

    Fold f tests one row; its training part ends two rows before that, so that
    one row lies between them.
    """
    place = Window.partitionBy(*keys).orderBy("date")
    sized = train.withColumns(
        {
            "_pos": F.row_number().over(place) - 1,
            "_rows": F.count(F.lit(1)).over(Window.partitionBy(*keys)),
        }
    )
    tested = F.col("_rows") - folds * TEST_SIZE + F.col("fold")
    spread = sized.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    fold_role = F.when(F.col("_pos") == tested, "test").when(F.col("_pos") < tested - GAP, "train")
    return spread.withColumn("fold_role", fold_role).where(F.col("fold_role").isNotNull()).drop("_pos", "_rows")


def shuffled_folds(frame: DataFrame, folds: int = 10, seed: int = 2323) -> DataFrame:
    """Equal-sized folds in an order that only the key and the seed decide."""
    scrambled = F.md5(F.concat_ws("|", "ticker", F.col("date").cast("string"), F.lit(str(seed))))
    order = Window.partitionBy("ticker").orderBy("_hash", "date")
    return (
        frame.withColumn("_hash", scrambled)
        .withColumn("fold", F.ntile(folds).over(order) - 1)
        .drop("_hash")
    )
