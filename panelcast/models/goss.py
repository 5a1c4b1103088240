"""Boosting with gradient-based one-side sampling on the pooled panel.

A boosting run has a state: the residuals after the last round, the trees so far and
the error of every round on the rows to be predicted. With a state folder this is
stored after each round, so a run that was cut goes on from its last whole round and
ends with the same trees as one that was not.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import product

from pyspark.ml.regression import DecisionTreeRegressionModel, DecisionTreeRegressor
from pyspark.sql import Column, DataFrame, functions as F

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
from panelcast.models.trees import Fit, first_best
from panelcast.session import delete_path, materialize, path_exists

# Grid of the reference model (fixed values): 15 and 63 leaves are depths 4 and
# 6; minimum rows of a leaf. Shares kept by one-side sampling.
DEPTHS = [4, 6]
MIN_ROWS = [5, 10, 20]
TOP_SHARE = 0.2
OTHER_SHARE = 0.1
# The tree columns of this many rounds are kept as a plan before it is cut.
ROUNDS_PER_CHECKPOINT = 10
# Relative accuracy of the sketches that look for the cut; it changes the speed only.
SKETCH_ACCURACY = 10_000


def uniform(keys: list[str], seed: int, turn: int) -> Column:
    """A number in [0, 1) that only the row's key, the seed and the round decide."""
    text = F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.lit(f"{seed}|{turn}"))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(2.0**32)


def tie_order(keys: list[str], seed: int, turn: int) -> Column:
    """A whole number of 52 bits, exact as a double, that only the row's key, the seed and the round decide."""
    text = F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.lit(f"{seed}|{turn}|ties"))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")


def kth_largest(rows: DataFrame, value: str, k: int) -> tuple[float, int, int]:
    """The k-th largest known value, its rank among its equals, and their number.

    The value is exact, without a sort; values are compared as doubles.

    A sketch puts two bounds around it, counts say on which side of them or between
    them it lies, and the search goes on in that range. The bounds leave the range
    each time, so it ends however many ties there are; the driver sees counts only.
    """
    rows = rows.select(F.col(value).cast("double").alias(value))
    v = F.col(value)
    inside, low, high = rows.agg(F.count(v), F.min(v), F.max(v)).first()
    if not 1 <= k <= inside:
        raise ValueError(f"there is no value of rank {k} among {inside}")
    while low < high:
        span = rows.where(v.between(F.lit(low), F.lit(high)))
        at, margin = 1 - k / inside, 2 / SKETCH_ACCURACY
        shares = [max(at - margin, 0.0), min(at + margin, 1.0)]
        a, b = span.agg(F.percentile_approx(v, shares, SKETCH_ACCURACY)).first()[0]
        ranges = [v > F.lit(b), v == F.lit(b), (v > F.lit(a)) & (v < F.lit(b)), (v == F.lit(a)) & (v < F.lit(b)), v < F.lit(a)]
        part = F.when(ranges[0], 0)
        for i, held in enumerate(ranges[1:], 1):
            part = part.when(held, i)
        counts = span.groupBy(part.alias("part")).agg(F.count(F.lit(1)), F.min(v), F.max(v))
        for _, inside, low, high in sorted(counts.collect()):
            if k <= inside:
                break
            k -= inside
    return low, k, inside


def top_rows(rows: DataFrame, size: Column, order: Column, k: int) -> Column:
    """A condition that holds for exactly the k largest rows; ties go by ``order``, lowest first."""
    ranked = rows.select(size.alias("size"), order.alias("order"))
    cut, wanted, equals = kth_largest(ranked, "size", k)
    if wanted == equals:
        return size >= F.lit(cut)
    tied = ranked.where(F.col("size") == F.lit(cut)).select((-F.col("order")).alias("order"))
    last = -int(kth_largest(tied, "order", wanted)[0])
    return (size > F.lit(cut)) | ((size == F.lit(cut)) & (order <= F.lit(last)))


def goss_sample(
    rows: DataFrame,
    residual: str,
    keys: list[str],
    top: float = TOP_SHARE,
    other: float = OTHER_SHARE,
    seed: int = 321,
    turn: int = 0,
) -> DataFrame:
    """Keep the rows with the largest residuals and a weighted sample of the rest.

    The top share is exact at every size, at least one row: ties at the cut go by
    a hash of the row's key. Sampled rows weigh ``(1 - top) / other`` so that sums
    stay unbiased. A row's fate depends on its key only, not on its partition.
    Rows without a residual are left out.
    """
    rows = rows.where(F.col(residual).isNotNull())
    size = F.abs(F.col(residual))
    total = rows.count()
    if total == 0:
        return rows.withColumn("weight", F.lit(1.0))
    large = top_rows(rows, size, tie_order(keys, seed, turn), max(1, int(total * top)))
    lucky = uniform(keys, seed, turn) < other / (1 - top)
    weight = F.when(large, 1.0).when(lucky, (1 - top) / other)
    return rows.withColumn("weight", weight).where(F.col("weight").isNotNull())


@dataclass
class Boosted:
    """The trees of a run, the value it starts from, and the error after each round."""

    models: list
    start: float
    errors: list[float]

    def best(self, patience: int) -> int:
        """Number of rounds with the lowest error."""
        return first_best(self.errors, patience) + 1


class State:
    """The rounds of a run below a folder: rows with residuals, trees, and a log.

    A round counts once its line is in the log, which is written last; the rows of the
    round before are removed then.
    """

    def __init__(self, train: DataFrame, path: str) -> None:
        self.spark, self.path = train.sparkSession, path.rstrip("/")

    def resume(self) -> tuple[list, float | None, list[float], DataFrame | None]:
        """Trees, start, errors and rows after the last whole round."""
        if not path_exists(self.spark, f"{self.path}/log"):
            return [], None, [], None
        log = self.spark.read.parquet(f"{self.path}/log").orderBy("turn").collect()
        models = [DecisionTreeRegressionModel.load(f"{self.path}/tree-{r['turn']}") for r in log]
        rows = self.spark.read.parquet(f"{self.path}/rows-{log[-1]['turn']}")
        return models, log[0]["start"], [r["error"] for r in log], rows

    def keep(self, turn: int, model, start: float, error: float | None, rows: DataFrame) -> DataFrame:
        model.write().overwrite().save(f"{self.path}/tree-{turn}")
        rows.write.mode("overwrite").parquet(f"{self.path}/rows-{turn}")
        line = self.spark.createDataFrame([(turn, start, error)], "turn int, start double, error double")
        line.coalesce(1).write.mode("append").parquet(f"{self.path}/log")
        if turn:
            delete_path(self.spark, f"{self.path}/rows-{turn - 1}")
        return self.spark.read.parquet(f"{self.path}/rows-{turn}")


def boost(
    train: DataFrame,
    targets: DataFrame | None,
    rounds: int,
    depth: int,
    min_rows: int,
    step_size: float,
    seed: int,
    patience: int | None = None,
    state: str | None = None,
) -> Boosted:
    """Rounds of one weighted tree each, fitted to the residuals of a fresh sample.

    With ``targets`` their error is measured after every round, and ``patience`` rounds
    without gain end the run. The residuals are kept after each round, in the folder
    ``state`` if there is one; a run found there is continued.
    """
    store = State(train, state) if state else None
    models, start, errors, rows = store.resume() if store else ([], None, [], None)
    if start is None:
        start = train.agg(F.avg("label")).first()[0]
    if rows is None:
        rows = train.withColumn("fit", F.lit(start))
    if targets is not None:
        targets = targets.withColumn("prediction", F.lit(start))
        for model in models:
            targets = added(model, targets, "prediction", step_size)
    for turn in range(len(models), rounds):
        if patience is not None and errors and turn - 1 - first_best(errors, patience) >= patience:
            break
        left = rows.withColumn("residual", F.col("label") - F.col("fit"))
        sample = goss_sample(left, "residual", ["ticker", "date"], seed=seed, turn=turn)
        model = DecisionTreeRegressor(
            labelCol="residual",
            weightCol="weight",
            predictionCol="step",
            maxDepth=depth,
            minInstancesPerNode=min_rows,
            seed=seed,
        ).fit(sample)
        rows = added(model, rows, "fit", step_size)
        error = None
        if targets is not None:
            targets = added(model, targets, "prediction", step_size)
            if (turn + 1) % ROUNDS_PER_CHECKPOINT == 0:
                targets = materialize(targets)
            error = rmse(targets)
        rows = store.keep(turn, model, start, error, rows) if store else materialize(rows)
        models.append(model)
        errors.append(error)
    return Boosted(models, start, errors)


def added(model: DecisionTreeRegressionModel, rows: DataFrame, name: str, step_size: float) -> DataFrame:
    """One more tree's share of the prediction."""
    stepped = model.setPredictionCol("step").transform(rows)
    return stepped.withColumn(name, F.col(name) + step_size * F.col("step")).drop("step")


def apply_fit(rows: DataFrame, fit: Fit) -> DataFrame:
    """Predictions of the rows of the fit's step and phase by its first trees."""
    asked = scored(at_step(rows, fit.horizon), fit.phase).withColumn("prediction", F.lit(fit.start))
    for model in fit.models[: fit.count]:
        asked = added(model, asked, "prediction", fit.step)
    return asked


def goss_fits(
    frame: DataFrame,
    features: list[str],
    horizon: int,
    rounds: int = 20,
    step_size: float = 0.1,
    depths: list[int] = DEPTHS,
    min_rows: list[int] = MIN_ROWS,
    patience: int = 5,
    seed: int = 321,
    state: str | None = None,
    rows: DataFrame | None = None,
) -> list[Fit]:
    """Tune depth and leaf size on the folds, stop early on the validation row, refit.

    A run on a fold ends after ``patience`` rounds without gain and counts with its best
    error. The number of rounds is the one with the lowest validation error; the final
    model has as many, with the same learning rate. ``state`` is a folder in which every
    run of every grid point keeps its rounds; a job that was cut continues there.
    """
    rows = pooled_rows(frame, features, horizon) if rows is None else rows
    grid = list(product(depths, min_rows))

    def place(*names) -> str | None:
        return "/".join([state, "-".join(map(str, names))]) if state else None

    def one_step(h: int) -> list[Fit]:
        data = at_step(rows, h)

        def fold_error(g: int, fold: int) -> float:
            targets = scored(data, FOLD_ROLES[fold])
            run = boost(training(data, fold), targets, rounds, *grid[g], step_size, seed, patience, place(h, "fold", g, fold))
            return min(run.errors)

        best = 0
        if len(grid) > 1:
            points = [(g, f) for g in range(len(grid)) for f in range(len(FOLD_ROLES))]
            errors = run_fits(frame.sparkSession, [lambda g=g, f=f: fold_error(g, f) for g, f in points])
            best = best_of(grid, dict(zip(points, errors)))
        point = [*grid[best], step_size, seed]
        first = boost(training(data, TRAIN_SEGMENT), scored(data, "validation"), rounds, *point, patience, place(h, "validation"))
        count = first.best(patience)
        final = boost(training(data, PHASES["test"]), None, count, *point, state=place(h, "test"))
        return [
            Fit(h, "validation", first.models, first.start, step_size, count),
            Fit(h, "test", final.models, final.start, step_size, count),
        ]

    steps = run_fits(frame.sparkSession, [lambda h=h: one_step(h) for h in range(1, horizon + 1)])
    return [fit for step in steps for fit in step]


def goss_forecast(frame: DataFrame, features: list[str], horizon: int, **settings) -> DataFrame:
    """Forecasts of both phases by the trees of ``goss_fits``."""
    rows = pooled_rows(frame, features, horizon)
    fits = goss_fits(frame, features, horizon, rows=rows, **settings)
    return reduce(DataFrame.unionByName, [as_forecast(apply_fit(rows, fit)) for fit in fits])
