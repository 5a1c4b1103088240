import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from series import by_ticker, random_bars, spark_frame
from test_panel import market_of

from panelcast.functions.errors import EPSILON
from panelcast.models import arima, elasticnet, goss, knn, linear, trees
from panelcast.operators import evaluate
from panelcast.operators import features as feat
from panelcast.operators import panel
from panelcast.plans import forecast
from panelcast.sources import market

HORIZON = 3


@pytest.fixture(scope="module")
def data():
    """Two tickers with a drifting price each."""
    rng = np.random.default_rng(11)
    frames = []
    for ticker in ("A", "B"):
        pdf = random_bars(rng, 90, ticker)
        pdf["close"] = 100 + np.cumsum(rng.normal(0, 1, 90)).round(2)
        pdf["high"], pdf["low"] = pdf["close"] + 1, pdf["close"] - 1
        frames.append(pdf)
    return pd.concat(frames, ignore_index=True)


@pytest.fixture(scope="module")
def frame(spark, data):
    return forecast.load_frame(market_of(spark, data))


@pytest.fixture(scope="module")
def names(frame):
    return feat.feature_columns(frame)


def slices(frame, names):
    """Training and prediction rows of every ticker, step and phase."""
    for ticker, g in by_ticker(frame).items():
        x, price = g[names].to_numpy(), g["price"].to_numpy()
        n = len(g)
        for h in range(1, HORIZON + 1):
            y = np.append(price[h:], [np.nan] * h)
            yield ticker, h, "validation", x[: n - 2 * h], y[: n - 2 * h], x[n - h - 1], y[n - h - 1]
            yield ticker, h, "test", x[: n - h], y[: n - h], x[n - 1], np.nan


def predicted(df):
    return {(r["ticker"], r["horizon"], r["role"]): r for r in df.collect()}


def standardised(x, row):
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale = np.where(scale < 1e-12, 1.0, scale)
    return (x - mean) / scale, (row - mean) / scale


def test_linear_matches_least_squares(frame, names):
    got = predicted(linear.linear_forecast(frame, names, HORIZON))
    for ticker, h, role, x, y, row, actual in slices(frame, names):
        xs, rs = standardised(x, row)
        weights = np.linalg.lstsq(xs - xs.mean(axis=0), y - y.mean(), rcond=1e-9)[0]
        r = got[ticker, h, role]
        assert r["y_hat"] == pytest.approx(y.mean() + rs @ weights, rel=1e-8)
        assert r["y"] is None if role == "test" else r["y"] == actual
    assert len(got) == 2 * HORIZON * 2


def test_linear_single_feature(frame, names):
    got = predicted(linear.single_feature_forecast(frame, "close", HORIZON))
    j = names.index("close")
    for ticker, h, role, x, y, row, _ in slices(frame, names):
        slope, intercept = np.polyfit(x[:, j], y, 1)
        assert got[ticker, h, role]["y_hat"] == pytest.approx(slope * row[j] + intercept, rel=1e-8)


def objective(x, y, w, alpha, ratio):
    residual = y - x @ w
    return 0.5 * np.mean(residual**2) + alpha * ratio * np.abs(w).sum() + 0.5 * alpha * (1 - ratio) * w @ w


def test_descent_reaches_the_minimum():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 4))
    x -= x.mean(axis=0)
    y = x @ np.array([2.0, 0.0, -1.0, 0.5]) + rng.normal(size=200)
    y -= y.mean()
    alpha, ratio = np.array([0.01, 0.3, 5.0, 0.3]), np.array([0.5, 0.9, 0.5, 0.1])
    many = lambda a: np.repeat(a[None], 4, axis=0)
    cov, cross = x.T @ x / 200, x.T @ y / 200
    weights = elasticnet.coordinate_descent(many(cov), many(cross), np.full(4, y @ y / 200), alpha, ratio)
    for w, a, l in zip(weights, alpha, ratio):
        best = objective(x, y, w, a, l)
        nudges = rng.normal(scale=0.02, size=(500, 4))
        assert all(objective(x, y, w + d, a, l) >= best - 1e-4 * np.mean(y**2) for d in nudges)
    assert np.all(weights[2] == 0)


def test_elastic_net_matches_row_by_row_descent(frame, names):
    """Same grid, folds and scaling, but descending on the rows themselves."""
    alphas, ratios = np.array([0.001, 0.5, 5.0]), np.array([0.1, 0.9])
    got = predicted(elasticnet.elasticnet_forecast(frame, names, HORIZON, alphas, ratios))

    def fit(x, y, alpha, ratio):
        xc, yc = x - x.mean(axis=0), y - y.mean()
        w, residual = np.zeros(x.shape[1]), yc.copy()
        n = len(y)
        for _ in range(1000):
            for j in range(len(w)):
                norm = xc[:, j] @ xc[:, j] / n
                if norm < 1e-12:
                    continue
                rho = xc[:, j] @ residual / n + norm * w[j]
                new = np.sign(rho) * max(abs(rho) - alpha * ratio, 0) / (norm + alpha * (1 - ratio))
                residual += xc[:, j] * (w[j] - new)
                w[j] = new
        return lambda row: y.mean() + (row - x.mean(axis=0)) @ w

    for ticker, h, role, x, y, row, _ in slices(frame, names):
        r = got[ticker, h, role]
        if role == "validation":
            xs, _ = standardised(x, row)
            n = len(y)
            scores = {}
            for a in alphas:
                for l in ratios:
                    errors = [
                        abs(fit(xs[: n - 6 + f], y[: n - 6 + f], a, l)(xs[n - 5 + f]) - y[n - 5 + f])
                        for f in range(5)
                    ]
                    scores[a, l] = np.mean(errors)
            assert scores[r["alpha"], r["l1_ratio"]] <= min(scores.values()) * (1 + 1e-2)
        xs, rs = standardised(x, row)
        assert r["y_hat"] == pytest.approx(fit(xs, y, r["alpha"], r["l1_ratio"])(rs), rel=1e-3)


def test_knn_matches_brute_force(frame, names):
    got = predicted(knn.knn_tuned(frame, names, HORIZON))
    fixed = predicted(knn.knn_forecast(frame, names, HORIZON, k=5))

    def predict(x, y, row, k):
        distance = ((x - row) ** 2).sum(axis=1)
        return y[np.argsort(distance, kind="stable")[:k]].mean()

    chosen = {}
    for ticker, h, role, x, y, row, _ in slices(frame, names):
        low, spread = x.min(axis=0), x.max(axis=0) - x.min(axis=0)
        spread = np.where(spread == 0, 1.0, spread)
        xs, rs, n = (x - low) / spread, (row - low) / spread, len(y)
        if role == "validation":
            scores = {
                k: np.mean(
                    [
                        abs(predict(xs[: n - 6 + f], y[: n - 6 + f], xs[n - 5 + f], k) - y[n - 5 + f])
                        for f in range(5)
                    ]
                )
                for k in (3, 5, 7)
            }
            chosen[ticker, h] = min(scores, key=lambda k: (scores[k], k))
        r = got[ticker, h, role]
        assert r["k"] == chosen[ticker, h]
        assert r["y_hat"] == pytest.approx(predict(xs, y, rs, r["k"]), rel=1e-9)
        assert fixed[ticker, h, role]["y_hat"] == pytest.approx(predict(xs, y, rs, 5), rel=1e-9)


def test_grid_choice_equals_the_tuned_k(frame, names):
    predictions = knn.knn_predictions(frame, names, HORIZON, [3, 5, 7])
    best = knn.choose_k(knn.fold_scores(predictions, [3, 5, 7]))
    tuned = knn.knn_tuned(frame, names, HORIZON).where("role = 'test'")
    key = ["ticker", "horizon", "k"]
    assert sorted(map(tuple, best.select(*key).collect())) == sorted(map(tuple, tuned.select(*key).collect()))


def test_arima_matches_recursion(frame):
    got = predicted(arima.arima_forecast(frame, HORIZON))
    for ticker, g in by_ticker(frame).items():
        price = g["price"].to_numpy()

        def path(y, steps):
            w = np.diff(y, 2)
            phi = 2 * (w[1:] @ w[:-1]) / (w[1:] @ w[1:] + w[:-1] @ w[:-1])
            last, move, bend, out = y[-1], y[-1] - y[-2], w[-1], []
            for _ in range(steps):
                bend *= phi
                move += bend
                last += move
                out.append(last)
            return out

        for h in range(1, HORIZON + 1):
            assert got[ticker, h, "test"]["y_hat"] == pytest.approx(path(price, h)[-1], rel=1e-9)
            r = got[ticker, h, "validation"]
            assert r["y_hat"] == pytest.approx(path(price[:-h], h)[-1], rel=1e-9)
            assert r["y"] == price[-1]


def test_validation_does_not_see_its_label(spark, data):
    """Changing closes after the validation row leaves its predictions alone."""
    horizon = 2
    changed = data.copy()
    late = changed.groupby("ticker").cumcount(ascending=False) < horizon
    changed.loc[late, ["close", "high", "low"]] += 500
    tables = []
    for pdf in (data, changed):
        frame = forecast.load_frame(market_of(spark, pdf))
        done = forecast.predict(frame, ["Linear", "ElasticNet", "KNN"], horizon)
        done = done.where((F.col("role") == "validation") & (F.col("horizon") == horizon))
        tables.append({(r["ticker"], r["model"]): r["y_hat"] for r in done.collect()})
    assert tables[0].keys() == tables[1].keys() and len(tables[0]) == 6
    for key, value in tables[0].items():
        assert tables[1][key] == pytest.approx(value, rel=1e-9)


def net_weights(x, y, alphas, ratios):
    """Coordinate descent on the rows' own products, for all penalties at once."""
    n, p = x.shape
    gram, cross = x.T @ x / n, x.T @ y / n
    w = np.zeros((len(alphas), p))
    for _ in range(3000):
        before = w.copy()
        for j in range(p):
            partial = cross[j] - w @ gram[:, j] + w[:, j] * gram[j, j]
            shrunk = np.sign(partial) * np.maximum(np.abs(partial) - alphas * ratios, 0)
            w[:, j] = shrunk / (gram[j, j] + alphas * (1 - ratios)) if gram[j, j] > 1e-12 else 0.0
        if np.abs(w - before).max() <= 1e-9 * max(np.abs(w).max(), 1e-12):
            break
    return w


def test_tuned_elastic_net_on_the_given_tables(spark):
    """The whole grid and all folds of the registered query, from the rows, at sf0.01."""
    loaded = forecast.load_frame(market.load_market(spark, "/root/testdata/sf0.01"))
    columns = feat.feature_columns(loaded)
    got = predicted(elasticnet.elasticnet_forecast(loaded, columns, 3))
    alphas = np.repeat(elasticnet.ALPHAS, len(elasticnet.RATIOS))
    ratios = np.tile(elasticnet.RATIOS, len(elasticnet.ALPHAS))
    for ticker, g in list(by_ticker(loaded).items())[:2]:
        x, price = g[columns].to_numpy(), g["price"].to_numpy()
        for h in (1, 3):
            n = len(g) - 2 * h
            y = np.append(price[h:], [np.nan] * h)
            scale = x[:n].std(axis=0)
            scale = np.where(scale < 1e-12, 1.0, scale)
            z = x / scale
            errors = np.zeros(len(alphas))
            for fold in range(5):
                rows, at = slice(0, n - 6 + fold), n - 5 + fold
                centre, level = z[rows].mean(axis=0), y[rows].mean()
                w = net_weights(z[rows] - centre, y[rows] - level, alphas, ratios)
                errors += np.abs(y[at] - level - w @ (z[at] - centre)) / 5
            for role, last, asked in (("validation", n, len(g) - h - 1), ("test", len(g) - h, len(g) - 1)):
                row = got[ticker, h, role]
                point = int(np.argmin(np.abs(alphas - row["alpha"]) + np.abs(ratios - row["l1_ratio"])))
                assert errors[point] <= errors.min() * (1 + 1e-3)
                own = x[:last].std(axis=0)
                own = np.where(own < 1e-12, 1.0, own)
                centre, level = x[:last].mean(axis=0), y[:last].mean()
                w = net_weights((x[:last] - centre) / own, y[:last] - level, alphas[[point]], ratios[[point]])[0]
                assert row["y_hat"] == pytest.approx(level + w @ ((x[asked] - centre) / own), rel=1e-4)


def test_error_measures(spark):
    rng = np.random.default_rng(5)
    y, p = rng.normal(10, 3, 50), rng.normal(10, 3, 50)
    y[0] = 0.0
    df = spark.createDataFrame([("m", float(a), float(b)) for a, b in zip(y, p)] + [("one", 2.0, 3.0)], "k string, y double, y_hat double")
    rows = {r["k"]: r for r in evaluate.forecast_metrics(df, ["k"]).collect()}
    error, m = y - p, rows["m"]
    assert m["mae"] == pytest.approx(np.abs(error).mean())
    assert m["mape"] == pytest.approx((np.abs(error) / np.maximum(np.abs(y), EPSILON)).mean())
    assert m["nmae"] == pytest.approx(np.abs(error).mean() / np.abs(y).mean())
    assert m["rmse"] == pytest.approx(np.sqrt((error**2).mean()))
    assert m["nrmse"] == pytest.approx(np.sqrt((error**2).mean()) / np.abs(y).mean())
    assert m["r2"] == pytest.approx(1 - (error**2).sum() / ((y - y.mean()) ** 2).sum())
    assert rows["one"]["r2"] is None and rows["one"]["mae"] == 1.0


def test_leaderboard(spark):
    rows = [("A", m, h, v, t) for m, t, vs in (("x", 2.0, (0.1, 0.4)), ("y", 4.0, (0.3, 0.2))) for h, v in enumerate(vs, 1)]
    perf = spark.createDataFrame(rows, "ticker string, model string, horizon int, nmae double, running_time double")
    board = {r["model"]: r for r in evaluate.leaderboard(perf, 2).collect()}
    assert (board["best_model"]["time_gap_1"], board["best_model"]["time_gap_2"]) == (10.0, 20.0)
    assert board["best_model"]["running_time"] == -1
    assert board["x"]["avg"] == pytest.approx(25.0)
    assert board["x"]["std"] == pytest.approx(np.std([10, 40], ddof=1))
    assert board["y"]["running_time"] == 4.0
    single = {r["model"]: r for r in evaluate.leaderboard(perf.where("horizon = 1"), 1).collect()}
    assert single["x"]["std"] is None
    best = {r["horizon"]: r["model"] for r in evaluate.best_models(perf).collect()}
    assert best == {1: "x", 2: "y"}


def test_grid_ties_go_to_the_first(spark):
    rows = [("A", g, f, s) for g, s in ((2, 1.0), (1, 1.0), (0, 3.0)) for f in range(5)]
    scores = spark.createDataFrame(rows, "ticker string, grid_ord int, fold int, rmse double")
    assert evaluate.best_grid_point(scores, ["ticker"], "grid_ord", "rmse").first()["grid_ord"] == 1


def test_linspace_grid(spark):
    rows = evaluate.linspace_grid(spark.range(1), 1e-3, 1e3, 100, [0.1, 0.5, 0.9]).orderBy("grid_ord").collect()
    assert [r["grid_ord"] for r in rows] == list(range(300))
    np.testing.assert_allclose([r["alpha"] for r in rows][::3], np.linspace(1e-3, 1e3, 100))
    assert [r["l1_ratio"] for r in rows[:3]] == [0.1, 0.5, 0.9]


def test_job_rejects_bad_requests(frame):
    with pytest.raises(ValueError):
        forecast.predict(frame, ["Prophet"], 3)
    with pytest.raises(ValueError):
        forecast.predict(frame, ["Linear"], 0)


def test_job_dates_and_rounding(spark, data):
    market = market_of(spark, data)
    end = panel.request_date(market)
    rows = forecast.forecast_job(market, ["ARIMA"], HORIZON).collect()
    days = [d.date() for d in pd.bdate_range(end, periods=HORIZON + 1)[1:]]
    for r in rows:
        assert r["date"] == days[r["horizon"] - 1]
        assert r["forecast"] == round(r["forecast"]) and r["r2"] is None


def test_short_histories_do_not_break_the_job(spark, data):
    short = random_bars(np.random.default_rng(1), 15, "S")
    tiny = random_bars(np.random.default_rng(2), 5, "T")
    market = market_of(spark, pd.concat([data, short, tiny], ignore_index=True))
    models = ["Linear", "ElasticNet", "KNN", "ARIMA"]
    rows = forecast.forecast_job(market, models, HORIZON).collect()
    assert {r["ticker"] for r in rows if r["forecast"] is not None} >= {"A", "B"}
    long = [r for r in rows if r["ticker"] in "AB"]
    assert len(long) == 2 * HORIZON * len(models) and all(r["nmae"] is not None for r in long)


def test_goss_keeps_the_top_and_stays_unbiased(spark):
    rng = np.random.default_rng(8)
    n = 20_000
    pdf = pd.DataFrame({"id": np.arange(n), "residual": rng.normal(size=n)})
    rows = spark.createDataFrame(pdf)
    got = goss.goss_sample(rows, "residual", ["id"]).toPandas()
    top = set(pdf.loc[pdf["residual"].abs().nlargest(n // 5).index, "id"])
    assert set(got[got["weight"] == 1.0]["id"]) == top
    rest = got[got["weight"] > 1]
    assert len(rest) == pytest.approx(0.1 * n, rel=0.1)
    assert rest["weight"].unique() == pytest.approx([8.0])
    again = goss.goss_sample(rows.repartition(7), "residual", ["id"]).toPandas()
    assert set(again["id"]) == set(got["id"])


def test_goss_takes_no_more_than_the_top_share_of_ties(spark):
    rows = spark.range(1000).withColumn("residual", F.when(F.col("id") < 100, 1.0).otherwise(0.0))
    got = goss.goss_sample(rows, "residual", ["id"]).toPandas()
    whole = got[got["weight"] == 1.0]
    assert len(whole) == 200 and set(range(100)) <= set(whole["id"])
    assert 50 <= len(got) - 200 <= 150
    empty = goss.goss_sample(rows.where("id < 0"), "residual", ["id"])
    assert empty.collect() == [] and "weight" in empty.columns


def test_kth_largest_is_exact(spark):
    rng = np.random.default_rng(3)
    for values in (rng.normal(size=30_000), rng.integers(0, 3, 5000).astype(float), np.zeros(100)):
        rows = spark.createDataFrame(pd.DataFrame({"v": values})).repartition(5)
        ordered = np.sort(values)[::-1]
        for k in (1, len(values) // 5, len(values) // 2, len(values)):
            value, rank, equals = goss.kth_largest(rows, "v", k)
            assert value == ordered[k - 1] and equals == (values == value).sum()
            assert rank == k - (values > value).sum()


def test_arima_stays_bounded_on_an_accelerating_series(spark):
    pdf = pd.DataFrame({"ticker": "A", "date": pd.bdate_range("2020-01-01", periods=30).date, "rn": range(30), "n": 30})
    pdf["price"] = 1.3 ** np.arange(30)
    rows = arima.arima_forecast(spark.createDataFrame(pdf), HORIZON).collect()
    assert rows and all(-1 <= r["phi"] <= 1 for r in rows)


def planted(spark):
    """Prices that grow by 1% a day; the last close is always too low."""
    frames = []
    for i, ticker in enumerate("ABC"):
        pdf = random_bars(np.random.default_rng(i), 80, ticker)
        pdf["close"] = 100.0 * (i + 1) * 1.01 ** np.arange(80)
        pdf["high"], pdf["low"] = pdf["close"] * 1.01, pdf["close"] * 0.99
        frames.append(pdf)
    return forecast.load_frame(market_of(spark, pd.concat(frames, ignore_index=True)))


@pytest.mark.parametrize(
    "fit",
    [
        lambda f, c: trees.gbt_forecast(f, c, 1, trees=3),
        lambda f, c: trees.forest_forecast(f, c, 1, trees=5),
        lambda f, c: goss.goss_forecast(f, c, 1, rounds=12, depths=[2, 4], min_rows=[5]),
    ],
    ids=["gbt", "forest", "goss"],
)
def test_trees_beat_the_last_value_on_a_trend(spark, fit):
    frame = planted(spark)
    last = {t: g["price"].iloc[-2] for t, g in by_ticker(frame).items()}
    rows = [r for r in fit(frame, feat.feature_columns(frame)).collect() if r["role"] == "validation"]
    assert len(rows) == 3
    for r in rows:
        assert abs(r["y_hat"] - r["y"]) < abs(last[r["ticker"]] - r["y"])
