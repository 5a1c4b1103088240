"""Model store, early stops, resumable boosting, and the regression of all tickers."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F
from series import random_bars
from test_panel import market_of

from panelcast.models import arima, elasticnet, goss, knn, linear, pooled, pooled_linear, store, trees
from panelcast.models.roles import FOLD_ROLES, TRAIN_SEGMENT
from panelcast.operators import features as feat
from panelcast.plans import forecast
from panelcast.session import materialize

HORIZON = 2


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(11)
    frames = []
    for ticker in ("A", "B"):
        pdf = random_bars(rng, 70, ticker)
        pdf["close"] = 100 + np.cumsum(rng.normal(0, 1, 70)).round(2)
        pdf["high"], pdf["low"] = pdf["close"] + 1, pdf["close"] - 1
        frames.append(pdf)
    return forecast.load_frame(market_of(spark, pd.concat(frames, ignore_index=True)))


@pytest.fixture(scope="module")
def names(frame):
    return feat.feature_columns(frame)


def values(df):
    return {(r["ticker"], r["horizon"], r["role"]): (r["y"], r["y_hat"]) for r in df.collect()}


def same(got, want):
    assert got.keys() == want.keys() and got
    for key, (y, y_hat) in want.items():
        assert got[key][0] == pytest.approx(y, nan_ok=True) if y is not None else got[key][0] is None
        assert got[key][1] == pytest.approx(y_hat, rel=1e-8)


NET = {"alphas": [0.01, 1.0], "ratios": [0.5], "tolerance": 1e-10}
PAIRS = {
    "Linear": (lambda m, f, c: m.fit_linear(f, c, HORIZON), lambda f, c: linear.linear_forecast(f, c, HORIZON)),
    "ElasticNet": (
        lambda m, f, c: m.fit_elasticnet(f, c, HORIZON, **NET),
        lambda f, c: elasticnet.elasticnet_forecast(f, c, HORIZON, **NET),
    ),
    "KNN": (lambda m, f, c: m.fit_knn(f, c, HORIZON), lambda f, c: knn.knn_tuned(f, c, HORIZON)),
    "ARIMA": (lambda m, f, c: m.fit_arima(f, c, HORIZON), lambda f, c: arima.arima_forecast(f, HORIZON)),
}


@pytest.mark.parametrize("model", PAIRS)
def test_a_stored_model_predicts_what_the_fit_does(spark, frame, names, tmp_path, monkeypatch, model):
    fit, direct = PAIRS[model]
    fit(store.ModelStore(spark, str(tmp_path)), frame, names)
    want = values(direct(frame, names))
    for module, name in ((store, "moment_rows"), (store, "problems"), (elasticnet, "moment_rows"), (knn, "staged")):
        monkeypatch.setattr(module, name, None)  # nothing is fitted from here on
    other = store.ModelStore(spark.newSession(), str(tmp_path))
    same(values(other.predict(model, frame, HORIZON)), want)


def test_coefficients_serve_any_rows(spark, frame, names, tmp_path):
    models = store.ModelStore(spark, str(tmp_path))
    models.fit_linear(frame, names, 1)
    asked = store.rows_asked(frame, names, 1).where("phase = 'test'")
    more = asked.withColumn("x", F.transform("x", lambda v: v + 1.0)).unionAll(asked)
    rows = store.apply_coefficients(more, models.get("Linear")).collect()
    by_hand = {}
    for r in models.get("Linear").where("phase = 'test'").collect():
        by_hand[r["ticker"]] = r["intercept"], np.array(r["centres"]), np.array(r["scales"]), np.array(r["weights"])
    want = []
    for r in more.collect():
        level, centre, scale, weight = by_hand[r["ticker"]]
        want.append(level + weight @ ((np.array(r["x"]) - centre) / scale))
    assert sorted(r["y_hat"] for r in rows) == pytest.approx(sorted(want), rel=1e-9)
    with pytest.raises(ValueError):
        models.predict("Prophet", frame, 1)


TREES = {
    "XGB_GBT": ("fit_gbt", trees.gbt_forecast, {"trees": 4, "step_size": 0.2, "min_rows": [3]}),
    "LGB_RandomForest": ("fit_forest", trees.forest_forecast, {"trees": 4, "depths": [3], "patience": 2}),
    "LGB_GOSS": ("fit_goss", goss.goss_forecast, {"rounds": 3, "depths": [3], "min_rows": [5], "patience": 2}),
}


@pytest.mark.parametrize("model", TREES)
def test_stored_trees_predict_what_the_fit_does(spark, frame, names, tmp_path, model):
    fit, direct, settings = TREES[model]
    models = store.ModelStore(spark, str(tmp_path))
    getattr(models, fit)(frame, names, 1, **settings)
    same(values(store.ModelStore(spark, str(tmp_path)).predict(model, frame, 1)), values(direct(frame, names, 1, **settings)))


def planted_rows(spark, n=240, turn=0.0, seed=1):
    """Rows whose label is a step of the first feature, plus noise that only training rows have."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        x = rng.uniform(-1, 1, 2)
        held = i % 4 == 0
        label = float(x[0] > 0) + (0.0 if held else turn * rng.normal())
        day = pd.Timestamp("2020-01-01") + pd.Timedelta(days=i)
        role = FOLD_ROLES[0] if held else None
        rows.append(("A", day.date(), 1, 0.0, label, label, None if held else 0, role, Vectors.dense(x)))
    schema = "ticker string, date date, horizon int, price double, y double, label double, segment int, role string"
    frame = spark.createDataFrame([r[:8] for r in rows], schema)
    vectors = spark.createDataFrame([(r[1], r[8]) for r in rows], ["date", "features"])
    return materialize(frame.join(vectors, "date"))


def test_boosting_stops_at_the_best_tree(spark):
    """Trees beyond the best one on the held-out rows are not grown."""
    data = planted_rows(spark, turn=0.6)
    held = pooled.scored(data, FOLD_ROLES[0])
    long = trees.boosted(1, 40, 0.3, 5).fit(pooled.training(data, 0))
    losses = long.evaluateEachIteration(held, "squared")
    fitted = trees.stopped_early(data, 0, FOLD_ROLES[0], 1, 40, 0.3, 0.0, 5)
    first_rise = next((i for i in range(1, 40) if losses[i] >= losses[i - 1]), 40)
    assert fitted.getNumTrees == first_rise < 40
    assert np.argmin(losses[: first_rise + 1]) + 1 == fitted.getNumTrees
    assert pooled.rmse(fitted.transform(held)) ** 2 == pytest.approx(losses[first_rise - 1], rel=1e-6)


def test_forest_prefixes_are_the_truncated_forests(spark):
    data = planted_rows(spark, turn=0.8, seed=2)
    held = pooled.scored(data, FOLD_ROLES[0])
    forest = trees.RandomForestRegressor(numTrees=12, maxDepth=3, subsamplingRate=0.8, featureSubsetStrategy="all", seed=3)
    fitted = forest.fit(pooled.training(data, 0))
    plain = held
    for i, tree in enumerate(fitted.trees):
        plain = tree.setPredictionCol(f"t{i}").transform(plain)
    table = plain.toPandas()
    single = table[[f"t{i}" for i in range(12)]].to_numpy()
    want = [float(np.sqrt(np.mean((single[:, :k].mean(axis=1) - table["label"]) ** 2))) for k in range(1, 13)]
    errors = trees.errors_by_count(fitted, held)
    assert errors == pytest.approx(want, rel=1e-9)
    assert pooled.rmse(fitted.transform(held)) == pytest.approx(errors[-1], rel=1e-9)
    assert trees.first_best(errors, 100) == int(np.argmin(want))


def test_first_best_waits_for_its_patience():
    assert trees.first_best([3, 2, 2, 1, 5, 5, 0], 2) == 3
    assert trees.first_best([3, 2, 2, 1, 5, 5, 0], 3) == 6
    assert trees.first_best([3, 4, 1], 1) == 0 and trees.first_best([2.0], 5) == 0


def test_a_cut_boosting_run_goes_on_from_its_last_round(spark, frame, names, tmp_path, monkeypatch):
    data = pooled.at_step(pooled.pooled_rows(frame, names, 1), 1)
    train, held = pooled.training(data, TRAIN_SEGMENT), pooled.scored(data, "validation")

    def run(rounds, state, **more):
        return goss.boost(train, held, rounds, 3, 5, 0.3, 7, state=state, **more)

    whole = run(4, str(tmp_path / "whole"))
    run(2, str(tmp_path / "cut"))
    fitted = []
    plain = goss.DecisionTreeRegressor.fit
    monkeypatch.setattr(goss.DecisionTreeRegressor, "fit", lambda *a: fitted.append(1) or plain(*a))
    resumed = run(4, str(tmp_path / "cut"))
    assert len(fitted) == 2
    assert resumed.errors == pytest.approx(whole.errors, rel=1e-12) and resumed.start == whole.start
    assert [m.toDebugString.split("\n", 1)[1] for m in resumed.models] == [m.toDebugString.split("\n", 1)[1] for m in whole.models]
    assert len(list((tmp_path / "cut").glob("rows-*"))) == 1  # the rows of earlier rounds are gone
    again = run(4, str(tmp_path / "cut"))
    assert len(fitted) == 2 and again.errors == resumed.errors
    patient = run(6, str(tmp_path / "patient"), patience=1)
    stops = next((i + 1 for i in range(1, 6) if patient.errors[i : i + 1] and patient.errors[i] >= min(patient.errors[:i])), 6)
    assert len(patient.errors) == min(stops, 6)


def test_pooled_regression_is_least_squares(spark):
    rng = np.random.default_rng(3)
    x, noise = rng.normal(size=(200, 3)) * [1, 10, 0.1], rng.normal(size=200)
    y = x @ [2.0, -0.3, 5.0] + 4 + noise
    rows = spark.createDataFrame([(float(t), Vectors.dense(v)) for t, v in zip(y, x)], ["label", "features"])
    fitted = pooled_linear.fit_pooled(rows)
    want = np.linalg.lstsq(np.column_stack([np.ones(200), x]), y, rcond=None)[0]
    np.testing.assert_allclose([fitted.intercept, *fitted.coefficients], want, rtol=1e-7)


@pytest.mark.parametrize(("alpha", "ratio"), [(0.3, 0.0), (0.3, 0.5), (0.2, 1.0)])
@pytest.mark.parametrize("size", [1.0, 25.0])
def test_pooled_penalty_means_the_same_at_every_label_scale(spark, alpha, ratio, size):
    """Weights minimise half the mean squared error and the penalty on standardised columns."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(150, 3)) * [1, 10, 0.1]
    y = size * (x @ [1.0, 0.2, -9.0] + rng.normal(size=150))
    rows = spark.createDataFrame([(float(t), Vectors.dense(v)) for t, v in zip(y, x)], ["label", "features"])
    fitted = pooled_linear.fit_pooled(rows, alpha, ratio)
    scale = x.std(axis=0)
    z, t = (x - x.mean(axis=0)) / scale, y - y.mean()
    w = np.zeros(3)
    for _ in range(2000):
        for j in range(3):
            partial = z[:, j] @ (t - z @ w + z[:, j] * w[j]) / 150
            w[j] = np.sign(partial) * max(abs(partial) - alpha * ratio, 0) / (z[:, j] @ z[:, j] / 150 + alpha * (1 - ratio))
    np.testing.assert_allclose(np.array(fitted.coefficients) * scale, w, rtol=2e-4, atol=1e-6)
