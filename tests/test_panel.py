import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from series import bars, by_ticker, random_bars, spark_frame

from panelcast.operators import features as feat
from panelcast.operators import panel, splits
from panelcast.session import materialize
from panelcast.sources.market import Market


def market_of(spark, pdf, with_extra=True, seed=0):
    rng = np.random.default_rng(seed)
    if not with_extra:
        return Market(bars=spark_frame(spark, pdf))
    flows = pdf[["ticker", "date"]].assign(
        inst=rng.integers(0, 9, len(pdf)).astype(float), fore=rng.integers(0, 9, len(pdf)).astype(float)
    )
    days = sorted(pdf["date"].unique())
    index = pd.DataFrame({"date": days, "kospi": rng.normal(2000, 50, len(days))})
    return Market(spark_frame(spark, pdf), spark_frame(spark, flows), spark_frame(spark, index))


def test_spine_fills_a_holiday_week(spark):
    pdf = bars(range(1, 16)).drop(index=range(5, 10)).reset_index(drop=True)
    market = market_of(spark, pdf, with_extra=False)
    joined = by_ticker(panel.spine_join(market))["A"]
    assert len(joined) == 15 and joined["close"].isna().sum() == 5
    filled = by_ticker(panel.build_panel(market))["A"]
    assert filled["close"].tolist() == [1, 2, 3, 4, 5, 5, 5, 5, 5, 5, 11, 12, 13, 14, 15]


def test_weekend_bars_vanish_and_spine_starts_on_a_weekday(spark):
    pdf = bars([1.0, 2.0, 3.0])
    pdf["date"] = [dt.date(2021, 1, 3), dt.date(2021, 1, 5), dt.date(2021, 1, 9)]
    market = market_of(spark, pdf, with_extra=False)
    assert panel.request_date(market) == dt.date(2021, 1, 8)
    filled = by_ticker(panel.build_panel(market))["A"]
    assert filled["date"].tolist() == [dt.date(2021, 1, d) for d in (5, 6, 7, 8)]
    assert filled["close"].tolist() == [2.0] * 4


def test_range_is_inclusive(spark):
    market = market_of(spark, bars(range(1, 21)), with_extra=False)
    start, end = dt.date(2021, 1, 6), dt.date(2021, 1, 13)
    dates = by_ticker(panel.build_panel(market, start, end))["A"]["date"].tolist()
    assert dates[0] == start and dates[-1] == end


def test_nan_input_is_filled_like_null(spark):
    pdf = bars([1.0, 2.0, 3.0])
    df = spark_frame(spark, pdf).withColumn(
        "close", F.when(F.col("close") == 2.0, float("nan")).otherwise(F.col("close"))
    )
    filled = by_ticker(panel.build_panel(Market(df)))["A"]
    assert filled["close"].tolist() == [1.0, 1.0, 3.0]


def test_null_audit_and_guard(spark):
    df = spark.createDataFrame([(1, None), (None, None), (3, "x")], "a int, b string")
    row = panel.null_audit(df).first()
    assert (row["a_nulls"], row["b_nulls"], row["total_nulls"]) == (1, 2, 3)
    with pytest.raises(Exception, match="listing has null values in a, b"):
        panel.require_no_nulls(df.where("a IS NULL"), "listing").collect()
    whole = spark.createDataFrame([(1, "x")], "a int, b string")
    assert panel.require_no_nulls(whole, "listing").collect() == [(1, "x")]


def test_the_guard_and_the_audit_run_in_the_job_itself(spark):
    df = spark.range(5).select(F.col("id").alias("a"), F.when(F.col("id") > 1, "x").alias("b"))
    started = spark.sparkContext.statusTracker().getJobIdsForGroup
    spark.sparkContext.setJobGroup("guard", "guard")
    guarded = panel.require_no_nulls(df, "listing")
    watched, found = panel.observed_nulls(df, "audit")
    assert not started("guard")  # planning starts no job
    with pytest.raises(Exception, match="listing has null values in b"):
        guarded.collect()
    assert watched.count() == 5 and len(watched.collect()) == 5
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert found.get == {"a_nulls": 0, "b_nulls": 2, "total_nulls": 2}


def test_the_panel_shuffles_once_and_joins_the_index_only(spark):
    rng = np.random.default_rng(9)
    pdf = pd.concat([random_bars(rng, 50, t) for t in "ABC"], ignore_index=True)
    market = market_of(spark, pdf)
    one_pass = materialize(market.bars.join(market.flows, ["ticker", "date"]))
    for found in (Market(market.bars), market, Market(one_pass, None, None, one_pass)):
        bare = Market(found.bars, found.flows, None, found.daily)
        plan = panel.build_panel(bare, end=pdf["date"].max())._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning(ticker") == 1 and plan.count("Exchange") == 1
        assert "Join" not in plan
        indexed = panel.build_panel(Market(found.bars, found.flows, market.index, found.daily), end=pdf["date"].max())
        plan = indexed._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning(ticker") == 1 and plan.count("Join") == 1


def by_joins(market, start, end):
    """The panel by the plain definition: a spine, three left joins, and a fill."""
    frames = [df.toPandas() for df in (market.bars, market.flows, market.index)]
    bars_pdf, flows, index = frames
    bars_pdf = bars_pdf[(bars_pdf["date"] >= start) & (bars_pdf["date"] <= end)]
    out = []
    for ticker, g in bars_pdf.groupby("ticker"):
        weekdays = [d for d in g["date"] if d.weekday() < 5]
        if weekdays:
            days = pd.DataFrame({"ticker": ticker, "date": [d.date() for d in pd.bdate_range(min(weekdays), end)]})
            joined = days.merge(g, "left").merge(flows, "left").merge(index, "left")
            out.append((joined, joined.ffill()))
    return pd.concat([a for a, _ in out], ignore_index=True), pd.concat([b for _, b in out], ignore_index=True)


def test_the_panel_equals_the_plain_joins(spark):
    rng = np.random.default_rng(21)
    frames = []
    for ticker in "ABCD":
        pdf = random_bars(rng, 40, ticker)
        pdf["date"] = [dt.date(2021, 1, 2) + dt.timedelta(days=int(d)) for d in sorted(rng.choice(70, 40, replace=False))]
        pdf.loc[rng.random(40) < 0.2, ["close", "volume"]] = np.nan
        frames.append(pdf)
    whole = pd.concat(frames, ignore_index=True)
    market = market_of(spark, whole)
    # days with flows alone, before the first bar, and of a ticker without bars
    extra = [("A", dt.date(2021, 1, 1), 1.0, 2.0), ("E", dt.date(2021, 1, 4), 1.0, 2.0), ("B", dt.date(2021, 3, 17), 3.0, 4.0)]
    flows = market.flows.where("pmod(hash(ticker, date), 4) <> 0 AND date <> '2021-03-17'")
    flows = flows.unionByName(spark.createDataFrame(extra, market.flows.schema))
    index = market.index.where("dayofmonth(date) % 5 <> 0")
    market = Market(market.bars, flows, index)
    start, end = dt.date(2021, 1, 12), dt.date(2021, 3, 19)
    for got, want in zip((panel.spine_join(market, start, end), panel.build_panel(market, start, end)), by_joins(market, start, end)):
        out = got.toPandas().sort_values(["ticker", "date"], ignore_index=True)
        assert out.columns.tolist() == want.columns.tolist()
        pd.testing.assert_frame_equal(out, want.sort_values(["ticker", "date"], ignore_index=True), check_dtype=False)


def test_stride_with_several_steps_numbers_once(spark):
    df = spark_frame(spark, bars(range(12)))
    got = panel.stride_from_end(df, 5, 3)
    assert sorted((r["step"], r["close"]) for r in got.collect()) == [(3, 2), (3, 5), (3, 8), (3, 11), (5, 1), (5, 6), (5, 11)]
    assert got._jdf.queryExecution().executedPlan().toString().count("Window") <= 2


def test_dense_frame_drops_rows_with_any_null(spark):
    pdf = random_bars(np.random.default_rng(1), 60)
    market = market_of(spark, pdf)
    late_index = market.index.where(F.col("date") >= F.lit(pdf["date"][20]))
    dense = by_ticker(feat.dense_frame(panel.build_panel(Market(market.bars, market.flows, late_index))))["A"]
    assert dense["date"][0] == pdf["date"][20]
    assert dense["rn"].tolist() == list(range(40)) and set(dense["n"]) == {40}


def test_feature_columns_follow_the_sources(spark):
    pdf = random_bars(np.random.default_rng(2), 40)
    whole = feat.feature_frame(feat.dense_frame(panel.build_panel(market_of(spark, pdf))))
    assert whole.columns == [
        "ticker", "date", "close", "kospi", "mfi_signal_buy", "mfi_signal_sell", "obv", "trading_amount",
    ]
    alone = feat.feature_frame(feat.dense_frame(panel.build_panel(market_of(spark, pdf, False))))
    assert alone.columns == [c for c in whole.columns if c != "kospi"]


def test_lower_sorted(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], "Zeta int, ticker int, Date int, alpha int")
    assert panel.lower_sorted(df).columns == ["ticker", "date", "alpha", "zeta"]


def test_min_history(spark):
    df = spark_frame(spark, pd.concat([bars(range(15), "A"), bars(range(14), "B")]))
    rows = {r["ticker"]: r["enough"] for r in panel.min_history(df, 5).collect()}
    assert rows == {"A": True, "B": False}


def test_stride_counts_back_from_the_end(spark):
    got = by_ticker(panel.stride_from_end(spark_frame(spark, bars(range(12))), 5))["A"]
    assert got["close"].tolist() == [1, 6, 11]


def frame_of(spark, n, seed=3):
    pdf = random_bars(np.random.default_rng(seed), n)
    return feat.model_frame(panel.build_panel(market_of(spark, pdf)))


def test_targets_shift_the_raw_close(spark):
    dense = feat.dense_frame(panel.build_panel(market_of(spark, random_bars(np.random.default_rng(4), 40))))
    prices = by_ticker(dense)["A"]["price"]
    got = feat.lead_targets(dense, 3).toPandas().sort_values(["horizon", "date"])
    for h, g in got.groupby("horizon"):
        np.testing.assert_array_equal(g["y"].to_numpy(), prices.shift(-h).to_numpy())


@pytest.mark.parametrize("horizon", [1, 4])
def test_walk_forward_matches_slices(spark, horizon):
    frame = frame_of(spark, 60)
    n = frame.count()
    got = splits.walk_forward(frame, horizon).toPandas()
    for g in range(1, horizon + 1):
        rows = list(range(n))
        full = rows[:-g]
        want = {"test": rows[-1:], "full": full, "validation": full[-1:], "train": full[:-g]}
        at = got[got["horizon"] == g]
        for role, positions in want.items():
            assert sorted(at[at["role"] == role]["rn"]) == positions


def test_folds_match_expanding_windows(spark):
    frame = frame_of(spark, 60)
    train = splits.walk_forward(frame, 2).where("role = 'train'")
    got = splits.time_series_folds(train, ["ticker", "horizon"]).toPandas()
    for g, at in got.groupby("horizon"):
        n = train.where(F.col("horizon") == g).count()
        for fold in range(5):
            part = at[at["fold"] == fold]
            assert part[part["fold_role"] == "test"]["rn"].tolist() == [n - 5 + fold]
            assert sorted(part[part["fold_role"] == "train"]["rn"]) == list(range(n - 6 + fold))


def test_shuffled_folds_have_even_sizes(spark):
    frame = frame_of(spark, 60)
    folds = splits.shuffled_folds(frame).toPandas()
    sizes = folds.groupby("fold").size()
    assert len(sizes) == 10 and sizes.max() - sizes.min() <= 1
    again = splits.shuffled_folds(frame.repartition(5)).toPandas()
    key = ["ticker", "date", "fold"]
    assert sorted(map(tuple, folds[key].values)) == sorted(map(tuple, again[key].values))


@pytest.mark.parametrize("kind", ["standard", "minmax"])
def test_scaling_uses_the_fitted_rows(spark, kind):
    frame = frame_of(spark, 60)
    names = feat.feature_columns(frame)
    split = splits.walk_forward(frame, 2)
    raw = split.toPandas()
    got = feat.scale_split(split, names, kind).toPandas()
    for (g, role), part in got.groupby(["horizon", "role"]):
        fitted = "train" if role in ("train", "validation") else "full"
        base = raw[(raw["horizon"] == g) & (raw["role"] == fitted)][names]
        centre, scale = (
            (base.mean(), base.std(ddof=0)) if kind == "standard" else (base.min(), base.max() - base.min())
        )
        scale = scale.replace(0, 1)
        want = (raw[(raw["horizon"] == g) & (raw["role"] == role)].set_index("date")[names] - centre) / scale
        np.testing.assert_allclose(part.set_index("date").sort_index()[names], want.sort_index(), atol=1e-9)


def test_sequences_end_at_their_row(spark):
    frame = frame_of(spark, 40)
    closes = by_ticker(frame)["A"]["close"].tolist()
    rows = feat.sequence_windows(frame, ["close"], 5).orderBy("date").collect()
    assert len(rows) == len(closes) - 4
    for i, r in enumerate(rows):
        assert [s[0] for s in r["sequence"]] == closes[i : i + 5]


def test_partitioning_does_not_change_the_panel(spark):
    rng = np.random.default_rng(9)
    pdf = pd.concat([random_bars(rng, 50, t) for t in "ABC"], ignore_index=True)
    market = market_of(spark, pdf)
    one = Market(*(df.coalesce(1) for df in (market.bars, market.flows, market.index)))
    many = Market(*(df.orderBy(F.rand(5)).repartition(13) for df in (market.bars, market.flows, market.index)))
    tables = [feat.model_frame(panel.build_panel(m)).toPandas().sort_values(["ticker", "date"]) for m in (one, many)]
    pd.testing.assert_frame_equal(*(t.reset_index(drop=True) for t in tables))


def test_a_repeated_index_day_adds_no_rows(spark):
    pdf = random_bars(np.random.default_rng(4), 20, "A")
    found = market_of(spark, pdf)
    index = spark.createDataFrame([(d, v) for d in pdf["date"] for v in (1.0, 2.0)], "date date, kospi double")
    joined = panel.spine_join(Market(found.bars, None, index), end=pdf["date"].max())
    rows = joined.collect()
    assert len({r["date"] for r in rows}) == len(rows)
    assert {r["kospi"] for r in rows} == {2.0}
