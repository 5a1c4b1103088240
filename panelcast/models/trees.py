"""Gradient-boosted trees and random forests on the pooled panel."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.ml.regression import GBTRegressor, RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import DataFrame, Window, functions as F

from panelcast.models.pooled import (
    PHASES,
    as_forecast,
    at_step,
    best_of,
    pooled_rows,
    rmse,
    run_fits,
    scored,
    training,
)
from panelcast.models.roles import FOLD_ROLES, TRAIN_SEGMENT

# Grids of the reference model (fixed values): minimum rows of a leaf for the
# boosted trees; for the forest 15 and 63 leaves, which are depths 4 and 6, and
# the trees after which a forest without gain stops.
MIN_ROWS = [1, 3, 5]
DEPTHS = [4, 6]
PATIENCE = 20


@dataclass
class Fit:
    """What was fitted for one step and phase: the models, the value they start from,
    the weight of each one's prediction, and how many trees count."""

    horizon: int
    phase: str
    models: list
    start: float
    step: float
    count: int


def apply_fit(rows: DataFrame, fit: Fit) -> DataFrame:
    """Predictions of the rows of the fit's step and phase."""
    return fit.models[0].transform(scored(at_step(rows, fit.horizon), fit.phase))


def with_held_out(data: DataFrame, segment: int, role: str) -> DataFrame:
    """The rows up to a segment, and those of a role marked as held out."""
    held = F.col("role").eqNullSafe(F.lit(role))
    return data.where((F.col("segment") <= segment) | held).withColumn("held_out", held)


def boosted(leaf: int, count: int, step_size: float, seed: int, **more) -> GBTRegressor:
    return GBTRegressor(
        maxDepth=4,
        maxIter=count,
        stepSize=step_size,
        subsamplingRate=0.8,
        featureSubsetStrategy="all",
        minInstancesPerNode=leaf,
        minInfoGain=0.0,
        seed=seed,
        **more,
    )


def stopped_early(
    data: DataFrame, segment: int, role: str, leaf: int, trees: int, step_size: float, tolerance: float, seed: int
):
    """Boosted trees up to the best one on the held-out rows of ``role``.

    Boosting ends with the first tree whose gain on them is below ``tolerance`` (of the
    error, or of 0.01 if that is more); trees beyond are never grown.
    """
    model = boosted(leaf, trees, step_size, seed, validationIndicatorCol="held_out", validationTol=tolerance)
    return model.fit(with_held_out(data, segment, role))


def gbt_fits(
    frame: DataFrame,
    features: list[str],
    horizon: int,
    trees: int = 1000,
    step_size: float = 0.01,
    min_rows: list[int] = MIN_ROWS,
    tolerance: float = 0.0,
    seed: int = 11,
    rows: DataFrame | None = None,
) -> list[Fit]:
    """Boosted trees of depth 4 on 80% row samples, tuned on the folds.

    Every fold fit stops early on the fold's rows. The leaf size with the lowest mean
    error there wins; its number of trees is the mean of its folds' numbers, cut to a
    whole number. Both phases use the same learning rate and this number.
    """
    rows = pooled_rows(frame, features, horizon) if rows is None else rows

    def one_step(h: int) -> list[Fit]:
        data = at_step(rows, h)

        def fold_fit(leaf: int, fold: int) -> tuple[float, int]:
            fitted = stopped_early(data, fold, FOLD_ROLES[fold], leaf, trees, step_size, tolerance, seed)
            return rmse(fitted.transform(scored(data, FOLD_ROLES[fold]))), fitted.getNumTrees

        points = [(g, f) for g in range(len(min_rows)) for f in range(len(FOLD_ROLES))]
        found = dict(zip(points, run_fits(frame.sparkSession, [lambda g=g, f=f: fold_fit(min_rows[g], f) for g, f in points])))
        best = best_of(min_rows, {p: error for p, (error, _) in found.items()})
        count = max(1, sum(found[best, f][1] for f in range(len(FOLD_ROLES))) // len(FOLD_ROLES))

        def phase(role: str, segment: int) -> Fit:
            fitted = boosted(min_rows[best], count, step_size, seed).fit(training(data, segment))
            return Fit(h, role, [fitted], 0.0, 1.0, count)

        return run_fits(frame.sparkSession, [lambda r=r, s=s: phase(r, s) for r, s in PHASES.items()])

    steps = run_fits(frame.sparkSession, [lambda h=h: one_step(h) for h in range(1, horizon + 1)])
    return [fit for step in steps for fit in step]


def gbt_forecast(frame: DataFrame, features: list[str], horizon: int, **settings) -> DataFrame:
    """Forecasts of both phases by the boosted trees of ``gbt_fits``."""
    rows = pooled_rows(frame, features, horizon)
    fits = gbt_fits(frame, features, horizon, rows=rows, **settings)
    return reduce(DataFrame.unionByName, [as_forecast(apply_fit(rows, fit)) for fit in fits])


def prefix_predictions(fitted: RandomForestRegressionModel, rows: DataFrame, name: str = "prediction") -> DataFrame:
    """``rows`` once per number of trees, with the mean of so many first trees.

    Every tree predicts once; the means are windows over the number of the tree.
    """
    single = rows
    names = [f"_tree{i}" for i in range(len(fitted.trees))]
    for tree, column in zip(fitted.trees, names, strict=True):
        single = tree.setPredictionCol(column).transform(single)
    spread = single.select(*rows.columns, F.posexplode(F.array(*names)).alias("trees", "one"))
    prefix = Window.partitionBy("ticker", "date").orderBy("trees").rowsBetween(Window.unboundedPreceding, 0)
    return spread.select(*rows.columns, (F.col("trees") + 1).alias("trees"), F.avg("one").over(prefix).alias(name))


def first_best(errors: list[float], patience: int) -> int:
    """Position of the lowest error before ``patience`` ones in a row bring no gain."""
    best = 0
    for i, error in enumerate(errors):
        if error < errors[best]:
            best = i
        if i - best >= patience:
            break
    return best


def errors_by_count(fitted: RandomForestRegressionModel, rows: DataFrame) -> list[float]:
    """Root mean squared error on ``rows`` of the first 1, 2, ... trees: a number each."""
    gap = F.col("label") - F.col("prediction")
    by_count = prefix_predictions(fitted, rows).groupBy("trees").agg(F.sqrt(F.avg(gap * gap)).alias("error"))
    return [r["error"] for r in by_count.orderBy("trees").collect()]


def apply_forest_fit(rows: DataFrame, fit: Fit) -> DataFrame:
    asked = scored(at_step(rows, fit.horizon), fit.phase)
    return prefix_predictions(fit.models[0], asked).where(F.col("trees") == fit.count).drop("trees")


def forest_fits(
    frame: DataFrame,
    features: list[str],
    horizon: int,
    trees: int = 100,
    depths: list[int] = DEPTHS,
    patience: int = PATIENCE,
    seed: int = 321,
    rows: DataFrame | None = None,
) -> list[Fit]:
    """Random forests on 80% row samples.

    The depth is chosen on the folds by RMSE. Of the forest fitted on the training rows
    as many trees count as do best on the validation row, looked for until ``patience``
    further trees bring no gain; that forest scores, and the final one has as many.
    """
    rows = pooled_rows(frame, features, horizon) if rows is None else rows

    def model(depth: int, count: int) -> RandomForestRegressor:
        return RandomForestRegressor(
            numTrees=count, maxDepth=depth, subsamplingRate=0.8, featureSubsetStrategy="all", seed=seed
        )

    def one_step(h: int) -> list[Fit]:
        data = at_step(rows, h)

        def fold_error(depth: int, fold: int) -> float:
            fitted = model(depth, trees).fit(training(data, fold))
            return rmse(fitted.transform(scored(data, FOLD_ROLES[fold])))

        points = [(g, f) for g in range(len(depths)) for f in range(len(FOLD_ROLES))]
        best = 0
        if len(depths) > 1:
            errors = run_fits(frame.sparkSession, [lambda g=g, f=f: fold_error(depths[g], f) for g, f in points])
            best = best_of(depths, dict(zip(points, errors)))
        first = model(depths[best], trees).fit(training(data, TRAIN_SEGMENT))
        count = first_best(errors_by_count(first, scored(data, "validation")), patience) + 1
        final = model(depths[best], count).fit(training(data, PHASES["test"]))
        return [Fit(h, "validation", [first], 0.0, 1.0, count), Fit(h, "test", [final], 0.0, 1.0, count)]

    steps = run_fits(frame.sparkSession, [lambda h=h: one_step(h) for h in range(1, horizon + 1)])
    return [fit for step in steps for fit in step]


def forest_forecast(frame: DataFrame, features: list[str], horizon: int, **settings) -> DataFrame:
    """Forecasts of both phases by the forests of ``forest_fits``."""
    rows = pooled_rows(frame, features, horizon)
    fits = forest_fits(frame, features, horizon, rows=rows, **settings)
    return reduce(DataFrame.unionByName, [as_forecast(apply_forest_fit(rows, fit)) for fit in fits])
