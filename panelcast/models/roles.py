"""Where a row stands in the walk-forward protocol, as column expressions.

Training sets are prefixes of a ticker's rows, so each row belongs to one
segment and every training set is a run of segments. Nothing is repeated per
fold: segment f ends where fold f's training part ends, segment 5 ends the
training rows, segment 6 ends the rows with a known label.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from panelcast.operators.features import with_horizons
from panelcast.operators.splits import FOLDS, GAP, TEST_SIZE

TRAIN_SEGMENT = FOLDS
FULL_SEGMENT = FOLDS + 1
SEGMENTS = FOLDS + 2
FOLD_ROLES = [f"fold{f}" for f in range(FOLDS)]


def last_known() -> Column:
    """Position of the last row whose label is known."""
    return F.col("n") - F.col("horizon") - 1


def train_rows() -> Column:
    return F.col("n") - 2 * F.col("horizon")


def last_fold0_row() -> Column:
    """Position of the last row that fold 0 trains on."""
    return train_rows() - FOLDS * TEST_SIZE - GAP - 1


def segment() -> Column:
    rn = F.col("rn")
    in_train = F.greatest(F.lit(0), F.least(rn - last_fold0_row(), F.lit(TRAIN_SEGMENT)))
    return F.when(rn < train_rows(), in_train).when(rn <= last_known(), F.lit(FULL_SEGMENT)).cast("int")


def scored_role() -> Column:
    """The role of a row that is predicted; NULL for rows that only train."""
    rn = F.col("rn")
    fold = rn - (train_rows() - FOLDS * TEST_SIZE)
    return (
        F.when(rn == F.col("n") - 1, "test")
        .when(rn == last_known(), "validation")
        .when((fold >= 0) & (fold < FOLDS), F.concat(F.lit("fold"), fold.cast("string")))
    )


def last_train_row(role: Column) -> Column:
    """Position of the last row a prediction of this role may learn from."""
    fold = F.substring(role, 5, 1).try_cast("int")
    return (
        F.when(role == "test", last_known())
        .when(role == "validation", train_rows() - 1)
        .otherwise(last_fold0_row() + fold)
    )


def staged(frame: DataFrame, horizon: int) -> DataFrame:
    """The model frame per step with target, segment and role."""
    return with_horizons(frame, horizon).withColumns({"segment": segment(), "role": scored_role()})
