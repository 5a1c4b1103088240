"""Every registered query: ``(spark, folder) -> DataFrame`` over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from panelcast.functions import calendar
from panelcast.models import arima, elasticnet, goss, knn, linear, pooled_linear, store, trees
from panelcast.operators import encoders, evaluate, features as feat, impute, indicators, panel, reshape, splits
from panelcast.plans import company, forecast, report
from panelcast.session import materialize, scratch_path
from panelcast.sources import listing, market, statements
from panelcast.sources.tables import read_table

HORIZON = 5
# The request of the queries that read part of the history: training days and steps.
TRAIN_PERIOD = 250
REQUEST_HORIZON = 20
# The company of the queries for one, and a history in which it trades often enough.
COMPANY = "Customer#000000003"
COMPANY_PERIOD = 2000
RUNNING_TIMES = {"Linear": 1.5, "KNN": 2.25, "ARIMA": 0.5}
EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]
# The models whose forecasts SQL gives as well.
CHECKED_MODELS = ["Linear", "KNN", "ARIMA"]
# Fewer trees than the functions' defaults: every tree is several small jobs (README).
TREE_SETTINGS = {
    "XGB_GBT": {"trees": 100, "step_size": 0.1},
    "LGB_RandomForest": {"trees": 20},
    "LGB_GOSS": {"rounds": 2, "patience": 1, "depths": [4], "min_rows": [5, 20], "step_size": 0.3},
}
# In the job of all models each of them has one grid point, so no fits on folds but the
# boosted trees' own, which give their number.
JOB_SETTINGS = {
    "XGB_GBT": {"trees": 10, "step_size": 0.3, "min_rows": [3]},
    "LGB_RandomForest": {"trees": 10, "depths": [4]},
    "LGB_GOSS": {"rounds": 2, "patience": 1, "depths": [4], "min_rows": [5], "step_size": 0.3},
}

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round floats for comparison; adding zero turns -0.0 into 0.0."""
    floats = [c for c, t in df.dtypes if t == "double"]
    return df.withColumns({c: F.round(c, digits) + F.lit(0.0) for c in floats})


def as_long(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("long") for c in names})


def filled_panel(spark: SparkSession, folder: str) -> DataFrame:
    return panel.build_panel(market.load_market(spark, folder))


def dense(spark: SparkSession, folder: str) -> DataFrame:
    return feat.dense_frame(filled_panel(spark, folder))


def frame_of(spark: SparkSession, folder: str) -> DataFrame:
    return forecast.load_frame(market.load_market(spark, folder))


# --- sources ---------------------------------------------------------------


@query
def scan_listing(spark, folder):
    """The listing written as CSV and scanned back, two markets kept."""
    path = scratch_path(spark, "listing")
    listing.write_listing_csv(listing.customer_listing(spark, folder), path)
    return listing.in_markets(listing.read_listing_csv(spark, path), ["BUILDING", "MACHINERY"])


@query
def listing_union(spark, folder):
    return listing.union_listings(
        listing.customer_listing(spark, folder), listing.supplier_listing(spark, folder)
    )


@query
def listing_lookup(spark, folder):
    """Names of all codes that trade."""
    codes = read_table(spark, folder, "orders").select(
        listing.padded_code(F.col("o_custkey")).alias("code")
    )
    return listing.names_for_codes(codes, listing.customer_listing(spark, folder))


@query
def listing_named(spark, folder):
    """The rows of some names."""
    return listing.codes_for_names(listing.customer_listing(spark, folder), [COMPANY, "Customer#000000007"])


@query
def listing_sorted(spark, folder):
    both = listing.union_listings(
        listing.customer_listing(spark, folder), listing.supplier_listing(spark, folder)
    )
    return listing.sorted_listing(panel.require_no_nulls(both, "listing"))


@query
def bars_daily(spark, folder):
    return market.daily_bars(spark, folder)


@query
def bars_roundtrip(spark, folder):
    """Bars stored by year and read back."""
    path = scratch_path(spark, "bars")
    market.write_bars(market.daily_bars(spark, folder), path)
    return market.read_bars(spark, path)


@query
def bars_fine(spark, folder):
    return market.daily_bars(spark, folder, by="nation")


@query
def flows_daily(spark, folder):
    return market.daily_flows(spark, folder)


@query
def index_daily(spark, folder):
    return market.daily_index(spark, folder)


# --- calendar --------------------------------------------------------------


@query
def business_days(spark, folder):
    """All business days between a ticker's first and last trade."""
    bars = market.daily_bars(spark, folder)
    ranges = bars.groupBy("ticker").agg(F.min("date").alias("first"), F.max("date").alias("last"))
    return calendar.explode_business_days(ranges, "first", "last")


@query
def bday_shift(spark, folder):
    """Every order date moved by 1, 5, 20 and 250 business days both ways."""
    day = calendar.parse_compact_date(F.date_format("o_orderdate", "yyyy-MM-dd"))
    orders = read_table(spark, folder, "orders").select("o_orderkey", day.alias("date"))
    shifts = {}
    for n in (1, 5, 20, 250):
        shifts[f"plus_{n}"] = calendar.add_business_days(F.col("date"), n)
        shifts[f"minus_{n}"] = calendar.subtract_business_days(F.col("date"), n)
    return orders.withColumns(shifts).withColumn("compact", calendar.format_compact_date(F.col("plus_1")))


@query
def week_of_month(spark, folder):
    return read_table(spark, folder, "orders").select(
        "o_orderkey",
        calendar.week_of_month(F.col("o_orderdate").cast("date")).cast("long").alias("week"),
    )


# --- panel -----------------------------------------------------------------


@query
def spine_join(spark, folder):
    return panel.spine_join(market.load_market(spark, folder))


@query
def ffill(spark, folder):
    return filled_panel(spark, folder)


@query
def null_audit(spark, folder):
    """Null cells of the joined panel before the fill."""
    return panel.null_audit(panel.spine_join(market.load_market(spark, folder)))


@query
def min_history(spark, folder):
    """Whether the days of a request are enough for its steps."""
    loaded, end = forecast.load_request(spark, folder, TRAIN_PERIOD)
    days = panel.build_panel(loaded, forecast.training_start(end, TRAIN_PERIOD), end)
    return panel.min_history(days, REQUEST_HORIZON)


@query
def stride_sample(spark, folder):
    closes = filled_panel(spark, folder).select("ticker", "date", "close")
    return panel.stride_from_end(closes, 20, 5)


# --- indicators ------------------------------------------------------------


@query
def obv(spark, folder):
    return indicators.add_obv(filled_panel(spark, folder)).select("ticker", "date", "close", "volume", "obv")


@query
def mfi(spark, folder):
    shown = indicators.add_mfi(filled_panel(spark, folder))
    return rounded(shown.select("ticker", "date", "mf", "p_n", "mfr", "mfi"))


@query
def mfi_signal(spark, folder):
    """Signal of every ticker and day on which the index is defined."""
    shown = indicators.add_mfi(filled_panel(spark, folder))
    return rounded(shown.where(F.col("mfi").isNotNull()).select("ticker", "date", "mfi", "mfi_signal"))


@query
def stochastic(spark, folder):
    shown = indicators.add_stochastic(filled_panel(spark, folder))
    return rounded(shown.select("ticker", "date", "fast_k", "fast_d", "slow_k", "slow_d"))


@query
def ewm_mean(spark, folder):
    """Over the unfilled closes, so that nulls inside the series count."""
    joined = panel.spine_join(market.load_market(spark, folder))
    averaged = indicators.ewm_mean(joined, "close", 5, "ewm")
    return rounded(averaged.select("ticker", "date", "close", "ewm"), 4)


@query
def moving_avg(spark, folder):
    close = F.col("close")
    return rounded(
        filled_panel(spark, folder).select(
            "ticker",
            "date",
            indicators.moving_average(close, 20).alias("ma20"),
            indicators.moving_average(close, 5).alias("ma5"),
        )
    )


@query
def breakthrough(spark, folder):
    """On-balance volume crossing its 20-day mean, confirmed by the two closes after it."""
    volume = indicators.add_obv(filled_panel(spark, folder))
    averaged = volume.withColumn("obv_ma", indicators.moving_average(F.col("obv"), 20))
    found = indicators.crossover_signal(averaged, "obv", "obv_ma", patience=2)
    return found.select("ticker", "date", "close", "signal")


# --- features, splits, encoders --------------------------------------------


@query
def features(spark, folder):
    return rounded(as_long(feat.feature_frame(dense(spark, folder)), "mfi_signal_buy", "mfi_signal_sell"))


@query
def features_ohlcv_only(spark, folder):
    """Bars alone: without flows and index the feature list shrinks."""
    bars_only = market.Market(bars=market.load_market(spark, folder).bars)
    shown = feat.feature_frame(feat.dense_frame(panel.build_panel(bars_only)))
    return rounded(as_long(shown, "mfi_signal_buy", "mfi_signal_sell"))


@query
def targets(spark, folder):
    return as_long(feat.lead_targets(dense(spark, folder), HORIZON), "horizon")


@query
def sequence_windows(spark, folder):
    """One row per step of every five-row window, with the label of its last row."""
    frame = feat.model_frame(filled_panel(spark, folder))
    names = feat.feature_columns(frame)
    windows = feat.sequence_windows(feat.with_horizons(frame, 1), names).where(F.col("y").isNotNull())
    steps = windows.select("ticker", "date", "y", F.posexplode("sequence").alias("step", "x"))
    return rounded(
        steps.select(
            "ticker",
            "date",
            F.col("step").cast("long").alias("step"),
            *[F.col("x")[i].alias(c) for i, c in enumerate(names)],
            "y",
        )
    )


def _split(spark, folder):
    frame = feat.model_frame(filled_panel(spark, folder))
    return splits.walk_forward(frame, HORIZON), feat.feature_columns(frame)


@query
def split_walkforward(spark, folder):
    split, _ = _split(spark, folder)
    return as_long(split.select("ticker", "date", "rn", "horizon", "role", "y"), "horizon")


@query
def ts_folds(spark, folder):
    split, _ = _split(spark, folder)
    train = split.where(F.col("role") == "train").select("ticker", "horizon", "date", "rn")
    return as_long(splits.time_series_folds(train, ["ticker", "horizon"]), "horizon", "fold")


@query
def kfold_hash(spark, folder):
    return as_long(splits.shuffled_folds(dense(spark, folder)).select("ticker", "date", "fold"), "fold")


@query
def standard_scale(spark, folder):
    split, names = _split(spark, folder)
    return rounded(as_long(feat.scale_split(split, names, "standard"), "horizon"))


@query
def minmax_scale(spark, folder):
    split, names = _split(spark, folder)
    return rounded(as_long(feat.scale_split(split, names, "minmax"), "horizon"))


@query
def corr_matrix(spark, folder):
    """Every numeric column of the panel with every other and the next close."""
    others = ["volume", "inst", "fore", "mfi"]
    frame = feat.model_frame(filled_panel(spark, folder), others)
    names = [*feat.feature_columns(frame), *others, "y"]
    labelled = feat.with_horizons(frame, 1).where(F.col("y").isNotNull())
    return feat.correlation_pairs(labelled, names).withColumn("corr", F.col("corr") + F.lit(0.0))


@query
def label_encode(spark, folder):
    """Two text columns and a number whose values differ in length."""
    orders = read_table(spark, folder, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus", "o_custkey")
    columns = ["o_orderpriority", "o_orderstatus", "o_custkey"]
    dictionary = encoders.fit_label_encoder(orders, columns)
    return encoders.apply_label_encoder(orders, dictionary, columns)


@query
def one_hot(spark, folder):
    events = read_table(spark, folder, "events").select("event_id", "event_type", "user_id")
    encoded = encoders.one_hot(events, {"event_type": EVENT_TYPES})
    return as_long(encoded, *[c for c in encoded.columns if c.startswith("event_type_")])


@query
def one_hot_long(spark, folder):
    """The entries of 1 of a wide column with as many categories as there are users."""
    events = read_table(spark, folder, "events").select("event_id", "event_type", "user_id")
    dictionary = encoders.fit_label_encoder(events, ["event_type", "user_id"])
    return as_long(encoders.one_hot_long(events, ["event_id"], dictionary), "code")


@query
def knn_impute(spark, folder):
    """Days without a bar filled from the days with the most similar index level and weekday."""
    joined = panel.spine_join(market.load_market(spark, folder))
    known = joined.withColumn("weekday", F.weekday("date").cast("double"))
    columns = ["open", "high", "low", "close", "volume", "inst", "fore", "kospi", "weekday"]
    return rounded(impute.knn_impute(known, columns, categorical=["volume", "weekday"]))


@query
def impute_customers(spark, folder):
    """Open balances of customers from the five nearest of their segment."""
    customer = read_table(spark, folder, "customer")
    balance = F.when(F.col("c_custkey") % 7 != 0, F.col("c_acctbal")).alias("c_acctbal")
    rows = customer.select("c_custkey", "c_mktsegment", balance, F.col("c_nationkey").cast("double").alias("c_nationkey"))
    filled = impute.knn_impute(rows, ["c_acctbal", "c_nationkey"], keys=["c_custkey"], block=["c_mktsegment"])
    return rounded(filled)


@query
def impute_parts(spark, folder):
    """Open sizes of parts, which are whole numbers, from the five nearest of all parts."""
    part = read_table(spark, folder, "part")
    size = F.when(F.col("p_partkey") % 11 != 0, F.col("p_size")).cast("double").alias("p_size")
    rows = part.select("p_partkey", size, F.col("p_retailprice").cast("double").alias("p_retailprice"))
    return rounded(impute.knn_impute(rows, ["p_size", "p_retailprice"], ["p_size"], keys=["p_partkey"], block=[]))


# --- models ----------------------------------------------------------------


def _forecast_rows(predictions: DataFrame, *extra: str, digits: int = 3) -> DataFrame:
    shown = predictions.select("ticker", "horizon", "role", "y", "y_hat", *extra)
    return rounded(as_long(shown, "horizon"), digits)


@query
def linear_1f(spark, folder):
    return _forecast_rows(linear.single_feature_forecast(frame_of(spark, folder), "close", HORIZON))


@query
def linear_forecast(spark, folder):
    frame = frame_of(spark, folder)
    return _forecast_rows(linear.linear_forecast(frame, feat.feature_columns(frame), HORIZON))


def _stored(spark, name) -> store.ModelStore:
    return store.ModelStore(spark, scratch_path(spark, name))


@query
def linear_pretrained(spark, folder):
    """Coefficients stored, read back, and joined with the rows to be predicted."""
    frame = frame_of(spark, folder)
    models = _stored(spark, "linear")
    models.fit_linear(frame, feat.feature_columns(frame), HORIZON)
    return _forecast_rows(models.predict("Linear", frame, HORIZON))


@query
def elasticnet_pretrained(spark, folder):
    """The same for a given penalty and mixing ratio."""
    frame = frame_of(spark, folder)
    models = _stored(spark, "net")
    models.fit_elasticnet(frame, feat.feature_columns(frame), HORIZON, alphas=[1.0], ratios=[0.5], tolerance=1e-13)
    return _forecast_rows(models.predict("ElasticNet", frame, HORIZON), "alpha", "l1_ratio")


@query
def knn_pretrained(spark, folder):
    """Stored rows, ranges and the tuned k, joined with the rows to be predicted."""
    frame = frame_of(spark, folder)
    models = _stored(spark, "knn")
    models.fit_knn(frame, feat.feature_columns(frame), HORIZON)
    return as_long(_forecast_rows(models.predict("KNN", frame, HORIZON), "k"), "k")


@query
def arima_pretrained(spark, folder):
    """Stored coefficients of ARIMA, applied to the last rows."""
    frame = frame_of(spark, folder)
    models = _stored(spark, "arima")
    models.fit_arima(frame, feat.feature_columns(frame), HORIZON)
    return _forecast_rows(models.predict("ARIMA", frame, HORIZON))


@query
def elasticnet_forecast(spark, folder):
    frame = frame_of(spark, folder)
    fitted = elasticnet.elasticnet_forecast(frame, feat.feature_columns(frame), HORIZON)
    return _forecast_rows(fitted, "alpha", "l1_ratio")


@query
def elasticnet_fixed(spark, folder):
    """The untuned path: a given penalty and mixing ratio, solved to the last digits."""
    frame = frame_of(spark, folder)
    fitted = elasticnet.elasticnet_forecast(
        frame, feat.feature_columns(frame), HORIZON, alphas=[1.0], ratios=[0.5], tolerance=1e-13
    )
    return _forecast_rows(fitted, "alpha", "l1_ratio")


@query
def linear_pooled(spark, folder):
    """One regression per step on the rows of all tickers."""
    frame = frame_of(spark, folder)
    return _forecast_rows(pooled_linear.pooled_linear_forecast(frame, feat.feature_columns(frame), HORIZON), digits=2)


@query
def grid_linspace(spark, folder):
    """The grid that the elastic net tries for every ticker."""
    tickers = market.daily_bars(spark, folder).select("ticker").distinct()
    return rounded(evaluate.linspace_grid(tickers, 1e-3, 1e3, 100, list(map(float, elasticnet.RATIOS))), 9)


@query
def knn_forecast(spark, folder):
    frame = frame_of(spark, folder)
    fitted = knn.knn_forecast(frame, feat.feature_columns(frame), HORIZON, k=5)
    return as_long(_forecast_rows(fitted, "k"), "k")


@query
def knn_tuned(spark, folder):
    frame = frame_of(spark, folder)
    fitted = knn.knn_tuned(frame, feat.feature_columns(frame), HORIZON)
    return as_long(_forecast_rows(fitted, "k"), "k")


@query
def grid_best(spark, folder):
    """Mean fold score of the winning k per ticker and step."""
    frame = frame_of(spark, folder)
    predictions = knn.knn_predictions(frame, feat.feature_columns(frame), HORIZON, [3, 5, 7])
    best = knn.choose_k(knn.fold_scores(predictions, [3, 5, 7]))
    return rounded(as_long(best, "horizon", "k"), 3)


@query
def arima_forecast(spark, folder):
    return _forecast_rows(arima.arima_forecast(frame_of(spark, folder), HORIZON))


@query
def gbt_forecast(spark, folder):
    frame = frame_of(spark, folder)
    fitted = trees.gbt_forecast(frame, feat.feature_columns(frame), HORIZON, **TREE_SETTINGS["XGB_GBT"])
    return _forecast_rows(fitted)


@query
def rf_forecast(spark, folder):
    frame = frame_of(spark, folder)
    fitted = trees.forest_forecast(frame, feat.feature_columns(frame), HORIZON, **TREE_SETTINGS["LGB_RandomForest"])
    return _forecast_rows(fitted)


@query
def goss_sample(spark, folder):
    """One-side sample of all labelled rows by the size of their next change."""
    stepped = feat.with_horizons(dense(spark, folder), 1).where(F.col("y").isNotNull())
    changes = stepped.select("ticker", "date", (F.log1p("y") - F.log1p("price")).alias("residual"))
    changes = materialize(changes)
    return rounded(goss.goss_sample(changes, "residual", ["ticker", "date"]))


@query
def goss_forecast(spark, folder):
    frame = frame_of(spark, folder)
    fitted = goss.goss_forecast(frame, feat.feature_columns(frame), HORIZON, **TREE_SETTINGS["LGB_GOSS"])
    return _forecast_rows(fitted)


# --- evaluation and reports ------------------------------------------------


@query
def forecast_metrics(spark, folder):
    """Errors of the last known close as the forecast of every later step."""
    stepped = feat.with_horizons(dense(spark, folder), HORIZON).where(F.col("y").isNotNull())
    persisted = stepped.withColumn("y_hat", F.col("price"))
    return rounded(as_long(evaluate.forecast_metrics(persisted, ["ticker", "horizon"]), "horizon"), 4)


def _predictions(spark, folder, models=None):
    return forecast.predict(frame_of(spark, folder), models or CHECKED_MODELS, HORIZON)


@query
def leaderboard(spark, folder):
    scores = forecast.performance(_predictions(spark, folder))
    return rounded(evaluate.leaderboard(scores, HORIZON))


@query
def leaderboard_times(spark, folder):
    """Mean running times of the models, as the caller measured them."""
    scores = forecast.performance(_predictions(spark, folder), RUNNING_TIMES)
    return rounded(evaluate.leaderboard(scores, HORIZON).select("ticker", "model", "avg", "running_time"))


@query
def leaderboard_score(spark, folder):
    """The rows of one model: its score per step, mean and deviation."""
    scores = forecast.performance(_predictions(spark, folder))
    return rounded(evaluate.score_of(evaluate.leaderboard(scores, HORIZON), "KNN").drop("running_time"))


@query
def best_models(spark, folder):
    scores = forecast.performance(_predictions(spark, folder))
    return rounded(as_long(evaluate.best_models(scores), "horizon"))


@query
def perf_union(spark, folder):
    frame = frame_of(spark, folder)
    tables = [forecast.performance(forecast.predict(frame, [m], HORIZON)) for m in ("ARIMA", "KNN")]
    shown = evaluate.union_performance(*tables).select("ticker", "model", "horizon", "mae", "mape", "nmae", "r2")
    return rounded(as_long(shown, "horizon"), 5)


@query
def row_concat(spark, folder):
    customer = read_table(spark, folder, "customer").select(
        F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment")
    )
    supplier = read_table(spark, folder, "supplier").select(
        F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"), F.col("s_nationkey").cast("string").alias("nation")
    )
    return reshape.concat_rows(customer, supplier)


def _forecast_dates(spark, folder, model):
    loaded = market.load_market(spark, folder)
    end = panel.request_date(loaded)
    frame = forecast.load_frame(loaded, end)
    predictions = forecast.predict(frame, [model], HORIZON)
    closes = frame.select("ticker", "date", F.col("price").alias("close"))
    return closes, forecast.forecast_table(predictions, end)


@query
def forecast_round(spark, folder):
    _, table = _forecast_dates(spark, folder, "KNN")
    return as_long(table.select("ticker", "horizon", "date", "forecast"), "horizon")


@query
def chart_series(spark, folder):
    closes, table = _forecast_dates(spark, folder, "ARIMA")
    return rounded(report.whole_chart(closes, table))


@query
def chart_series_tail(spark, folder):
    closes, table = _forecast_dates(spark, folder, "ARIMA")
    return rounded(report.recent_chart(closes, table, HORIZON))


@query
def forecast_job(spark, folder):
    """Flagship: all tickers, three models, the whole history."""
    job = forecast.forecast_job(market.load_market(spark, folder), CHECKED_MODELS, HORIZON)
    return rounded(as_long(job, "horizon"), 5)


def _all_predictions(spark, folder):
    """Forecasts of all seven models for every ticker and step."""
    return materialize(forecast.predict(frame_of(spark, folder), list(forecast.MODELS), HORIZON, JOB_SETTINGS))


@query
def forecast_job_all(spark, folder):
    """All seven models: which row each predicted, its label, and whether the forecast is a number."""
    rows = _all_predictions(spark, folder)
    known = (F.col("y_hat").isNotNull() & ~F.isnan("y_hat") & (F.abs("y_hat") < 1e9)).alias("has_forecast")
    return rounded(as_long(rows.select("ticker", "model", "horizon", "role", "y", known), "horizon"), 3)


@query
def leaderboard_all(spark, folder):
    """The board of all seven models, with the best of them at every step."""
    return rounded(evaluate.leaderboard(forecast.performance(_all_predictions(spark, folder)), HORIZON))


@query
def forecast_request(spark, folder):
    """The same job as a request: 250 training days and 20 steps ahead."""
    loaded, end = forecast.load_request(spark, folder, TRAIN_PERIOD)
    job = forecast.forecast_job(loaded, CHECKED_MODELS, REQUEST_HORIZON, end, TRAIN_PERIOD)
    return rounded(as_long(job, "horizon"), 5)


@query
def forecast_job_fine(spark, folder):
    """A request for all tickers of the finer grain."""
    loaded, end = forecast.load_request(spark, folder, TRAIN_PERIOD, by="nation")
    job = forecast.forecast_job(loaded, CHECKED_MODELS, HORIZON, end, TRAIN_PERIOD)
    return rounded(as_long(job, "horizon"), 5)


@query
def forecast_company(spark, folder):
    """A request for one company by name: its code limits what is read."""
    named = listing.codes_for_names(listing.customer_listing(spark, folder), [COMPANY])
    codes = [r["code"] for r in named.select("code").collect()]
    loaded, end = forecast.load_request(spark, folder, COMPANY_PERIOD, by="customer", tickers=codes)
    job = forecast.forecast_job(loaded, ["KNN", "ARIMA"], HORIZON, end, COMPANY_PERIOD)
    return rounded(as_long(job, "horizon"), 5)


# --- statements ------------------------------------------------------------


@query
def stmt_long(spark, folder):
    """Yearly statements spread to one column per year and folded back."""
    wide = statements.wide_statements(materialize(statements.order_statements(spark, folder)))
    return rounded(statements.long_statements(wide), 2)


@query
def stmt_roundtrip(spark, folder):
    path = scratch_path(spark, "statements")
    statements.write_statements(statements.order_statements(spark, folder), path)
    return rounded(statements.read_statements(spark, path), 2)


@query
def stmt_first_sector(spark, folder):
    """A brand's sales come from the first part type, by name, that has the brand."""
    table = materialize(statements.part_statements(spark, folder))
    return rounded(statements.first_sector_statements(table, _sector_order(table)), 2)


def _sector_order(table):
    """Sectors in order of their names."""
    ranks = encoders.ordinal_codes(table.select(F.lit("sector").alias("col"), F.col("sector").alias("value")))
    return ranks.select(F.col("value").alias("sector"), F.col("code").alias("sector_ord"))


@query
def stmt_nested(spark, folder):
    """The first sector's statements of every brand, from maps of maps that were stored."""
    table = materialize(statements.part_statements(spark, folder))
    path = scratch_path(spark, "nested")
    statements.nest_statements(table, _sector_order(table)).write.parquet(path)
    long = materialize(statements.unnest_statements(spark.read.parquet(path)))
    sectors = long.select("sector", "sector_ord").distinct()
    return rounded(statements.first_sector_statements(long.drop("sector_ord"), sectors), 2)


@query
def stmt_published(spark, folder):
    """Two companies published in turn; both are there, from their first sectors."""
    table = materialize(statements.part_statements(spark, folder))
    order, path = materialize(_sector_order(table)), scratch_path(spark, "published")
    first, last = table.agg(F.min("company"), F.max("company")).first()
    for name in (first, last, first):
        company.publish_company(table, order, path, name)
    return rounded(statements.read_statements(spark, path), 2)


@query
def metrics_transpose(spark, folder):
    return rounded(statements.transpose_metrics(statements.order_metrics(spark, folder), "company"), 4)


@query
def company_page(spark, folder):
    """Statements and metrics of one company, from the published store."""
    table = materialize(statements.order_statements(spark, folder))
    path = scratch_path(spark, "pages")
    company.publish_statements(table, _sector_order(table), path)
    name = table.agg(F.min("company")).first()[0]
    return rounded(company.company_page(spark, path, statements.order_metrics(spark, folder), name), 4)


def registry() -> dict[str, Query]:
    return dict(QUERIES)
