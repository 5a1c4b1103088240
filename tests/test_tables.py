"""Encoders, imputation, listing, statements, charts and session helpers."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from series import bars, by_ticker, spark_frame

from panelcast import session
from panelcast.operators import encoders, features, impute, reshape
from panelcast.plans import company, report
from panelcast.sources import listing, market, statements

FOLDER = "/root/testdata/sf0.001"


def test_listing_csv_keeps_leading_zeros(spark, tmp_path):
    path = tmp_path / "list.csv"
    path.write_text("종목명,종목코드,상장시장\n가나전자,000123,KOSPI\n다라게임,456780,KOSDAQ\n", encoding="utf-8")
    rows = listing.read_listing_csv(spark, str(path)).collect()
    assert [tuple(r) for r in rows] == [("가나전자", "000123", "KOSPI"), ("다라게임", "456780", "KOSDAQ")]


def test_listing_lookup_and_sort(spark):
    df = spark.createDataFrame(
        [("나", "000002", "K"), ("가", "000001", "K"), ("가", "000003", "Q")], listing.LISTING_SCHEMA
    )
    assert [r["code"] for r in listing.codes_for_names(df, ["나"]).collect()] == ["000002"]
    assert [r["name"] for r in listing.sorted_listing(df).collect()] == ["가", "가", "나"]
    codes = spark.createDataFrame([("000001",), ("000003",), ("000003",)], "code string")
    assert [tuple(r) for r in listing.names_for_codes(codes, df).collect()] == [("가", "000001", "K")]
    assert listing.in_markets(df, ["Q"]).count() == 1


def test_codes_longer_than_six_digits_stay_whole(spark):
    rows = spark.range(1).select(*[listing.padded_code(F.lit(v)).alias(f"c{i}") for i, v in enumerate((7, 123456, 12345678))])
    assert tuple(rows.first()) == ("000007", "123456", "12345678")


def test_label_encoder(spark):
    train = spark.createDataFrame([("b",), ("a",), (None,), ("c",), ("a",)], "x string")
    dictionary = encoders.fit_label_encoder(train, ["x"])
    assert {r["value"]: r["code"] for r in dictionary.collect()} == {"a": 0.0, "b": 1.0, "c": 2.0}
    new = spark.createDataFrame([("c", 1), ("zz", 2), (None, 3)], "x string, k int")
    got = encoders.apply_label_encoder(new, dictionary, ["x"])
    assert got.columns == ["x", "k"]
    assert [r["x"] for r in got.orderBy("k").collect()] == [2.0, None, None]


def test_label_encoder_preset(spark):
    df = spark.createDataFrame([("hi", "p"), ("lo", "q")], "x string, y string")
    preset = spark.createDataFrame([("x", "lo", 0.0), ("x", "hi", 9.0)], "col string, value string, code double")
    dictionary = encoders.fit_label_encoder(df, ["x", "y"], preset)
    rows = encoders.apply_label_encoder(df, dictionary, ["x", "y"]).collect()
    assert sorted(map(tuple, rows)) == [(0.0, 1.0), (9.0, 0.0)]


def test_ordinal_codes_over_many_partitions(spark):
    values = [f"v{i:05d}" for i in range(3000)]
    df = spark.createDataFrame([("c", v) for v in values] * 2, "col string, value string").repartition(17)
    codes = {r["value"]: r["code"] for r in encoders.ordinal_codes(df).collect()}
    assert codes == {v: float(i) for i, v in enumerate(values)}


def test_one_hot(spark):
    df = spark.createDataFrame([(1, "sell", 5), (2, "buy", 6), (3, None, 7)], "a int, s string, b int")
    categories = {"s": ["buy", "sell"], "weekday": ["mon"]}
    got = encoders.one_hot(df, categories)
    assert got.columns == ["a", "s_buy", "s_sell", "b"]
    assert [tuple(r) for r in got.orderBy("a").collect()] == [(1, 0, 1, 5), (2, 1, 0, 6), (3, 0, 0, 7)]
    unseen = df.withColumn("s", F.lit("hold"))
    assert {(r["s_buy"], r["s_sell"]) for r in encoders.one_hot(unseen, categories).collect()} == {(0, 0)}
    renamed = encoders.one_hot(df, categories, {"s": {"buy": "long"}})
    assert "s_long" in renamed.columns
    long = encoders.one_hot_long(df, ["a"], encoders.fit_label_encoder(df, ["s", "b"]))
    entries = sorted((r["a"], r["col"], r["code"]) for r in long.collect())
    assert entries == [(1, "b", 0.0), (1, "s", 1.0), (2, "b", 1.0), (2, "s", 0.0), (3, "b", 2.0)]


def impute_by_hand(x, k):
    filled = x.copy()
    for i, j in zip(*np.where(np.isnan(x))):
        scored = []
        for d in range(len(x)):
            both = ~np.isnan(x[i]) & ~np.isnan(x[d])
            if not np.isnan(x[d, j]) and both.any():
                scored.append((np.sum((x[i] - x[d])[both] ** 2) * x.shape[1] / both.sum(), d))
        near = [x[d, j] for _, d in sorted(scored)[:k]]
        filled[i, j] = np.mean(near) if near else np.nanmean(x[:, j])
    return filled


def test_imputer(spark):
    rng = np.random.default_rng(2)
    frames, want = [], {}
    for ticker, n in (("A", 300), ("B", 40), ("C", 3)):
        pdf = bars(rng.integers(1, 9, n), ticker)[["ticker", "date"]]
        x = rng.integers(0, 6, (n, 3)).astype(float)
        x[rng.random((n, 3)) < 0.2] = np.nan
        x[0] = [1, 2, np.nan]
        x[1], x[2, 2] = np.nan, 3.0
        for j, c in enumerate("uvw"):
            pdf[c] = x[:, j]
        frames.append(pdf)
        want[ticker] = impute_by_hand(x, 4)
    data = pd.concat(frames, ignore_index=True)
    got = by_ticker(impute.knn_impute(spark_frame(spark, data), ["u", "v", "w"], k=4))
    for ticker, table in want.items():
        np.testing.assert_allclose(got[ticker][["u", "v", "w"]].to_numpy(), table)
    whole = by_ticker(impute.knn_impute(spark_frame(spark, data), ["u", "v", "w"], ["w"], k=4))
    for ticker, table in want.items():
        seen = data[data["ticker"] == ticker]["w"]
        np.testing.assert_allclose(whole[ticker]["w"], np.clip(np.rint(table[:, 2]), seen.min(), seen.max()))


def test_imputer_with_given_donors(spark):
    donors = bars([10, 20, 30])[["ticker", "date", "close", "volume"]]
    rows = bars([np.nan, 5], start="2022-01-03")[["ticker", "date", "close", "volume"]]
    rows["volume"] = [3.0, 9.0]
    got = by_ticker(
        impute.knn_impute(spark_frame(spark, rows), ["close", "volume"], k=1, donors=spark_frame(spark, donors))
    )["A"]
    assert got["close"].tolist() == [30.0, 5.0]


def impute_case(rng, n, share=0.2):
    x = rng.integers(0, 6, (n, 3)).astype(float)
    x[rng.random((n, 3)) < share] = np.nan
    return x


def impute_table(spark, x, segments):
    rows = [(i, s, *[None if np.isnan(v) else float(v) for v in line]) for i, (s, line) in enumerate(zip(segments, x))]
    return spark.createDataFrame(rows, "id long, seg string, u double, v double, w double")


def test_imputer_on_any_table_in_tiles(spark):
    """Small tiles deal a block over many tasks; the result is that of one tile."""
    rng = np.random.default_rng(4)
    x, segments = impute_case(rng, 260), ["hot" if i % 4 else None for i in range(260)]
    table = impute_table(spark, x, segments).repartition(5)
    for block in (["seg"], []):
        want = x.copy()
        for s in {*segments} if block else {0}:
            own = [i for i in range(260) if not block or segments[i] == s]
            want[own] = impute_by_hand(x[own], 3)
        for sizes in ({}, {"donor_rows": 16, "open_rows": 10}):
            got = impute.knn_impute(table, ["u", "v", "w"], k=3, keys=["id"], block=block, **sizes)
            out = got.toPandas().sort_values("id")
            np.testing.assert_allclose(out[["u", "v", "w"]].to_numpy(), want)


def test_imputer_deals_a_block_over_many_tasks(spark):
    """Of one block of 400 rows no task gets more than a tile of donors and one of open rows."""
    rng = np.random.default_rng(5)
    table = impute_table(spark, impute_case(rng, 400), ["one"] * 400)
    got = impute.knn_impute(table, ["u", "v", "w"], keys=["id"], block=["seg"], donor_rows=50, open_rows=40)
    assert got.where("u IS NULL OR v IS NULL OR w IS NULL").count() == 0 and got.count() == 400
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(group") and "row_tile" in plan.split("FlatMapCoGroupsInArrow")[1]


def test_imputer_compares_near_tiles_only(spark, monkeypatch):
    """Of twice as many rows and tiles, twice as many pairs of tiles are compared, not four
    times; equal open rows are one question."""
    met, plain = [], impute.meetings

    def kept(questions, donors, *rest):
        met.append((questions.count(), donors.count(), plain(questions, donors, *rest)))
        return met[-1][2]

    monkeypatch.setattr(impute, "meetings", kept)
    rng = np.random.default_rng(6)
    for n in (600, 1200):
        x = np.stack([rng.normal(0, 9, n), np.repeat(rng.permutation(n // 2), 2).astype(float)], axis=1)
        x[rng.permutation(n)[: n // 3], 0] = np.nan
        rows = [(i, *[None if np.isnan(v) else float(v) for v in line]) for i, line in enumerate(x)]
        table = spark.createDataFrame(rows, "id long, u double, v double")
        got = impute.knn_impute(table, ["u", "v"], k=3, keys=["id"], block=[], donor_rows=20, open_rows=10)
        np.testing.assert_allclose(got.toPandas().sort_values("id")[["u", "v"]].to_numpy(), impute_by_hand(x, 3))
        assert met[-1][0] == len({v for u, v in x if np.isnan(u)}) and met[-1][1] <= (~np.isnan(x[:, 0])).sum()
    small, large = (out.count() for _, _, out in met)
    assert large < 3 * small and large < 60 * 30 / 4


def test_imputer_infinite_values(spark):
    """Infinite values have no distance from each other and are far from all others."""
    inf = float("inf")
    rows = [(0, None, inf, 1.0), (1, 5.0, inf, 2.0), (2, 7.0, 0.0, 1.0), (3, None, 0.5, None), (4, 9.0, -inf, 1.0)]
    table = spark.createDataFrame(rows, "id long, u double, v double, w double")
    got = impute.knn_impute(table, ["u", "v", "w"], k=2, keys=["id"], block=[])
    filled = {r["id"]: (r["u"], r["w"]) for r in got.collect()}
    assert filled[0] == (5.0, 1.0) and filled[3] == (7.0, 1.0)


def test_imputer_odd_cases(spark):
    rows = [(1, "a", None, None, None), (2, "a", 1.0, float("nan"), 4.0), (3, "b", None, 2.0, None), (4, None, 7.0, 8.0, None)]
    table = spark.createDataFrame(rows, "id long, seg string, u double, v double, w double")
    got = {r["id"]: r for r in impute.knn_impute(table, ["u", "v", "w"], ["w"], keys=["id"], block=["seg"]).collect()}
    assert tuple(got[1])[2:] == (1.0, None, 4.0)  # no comparable donor: the mean of the block, if it has one
    assert tuple(got[2])[2:] == (1.0, None, 4.0) and tuple(got[3])[2:] == (None, 2.0, None)
    assert tuple(got[4])[2:] == (7.0, 8.0, None)
    assert impute.knn_impute(table.limit(0), ["u"], keys=["id"], block=[]).count() == 0


def test_concat_rows_aligns_columns(spark):
    a, b = spark.createDataFrame([(1, 2)], "x int, y int"), spark.createDataFrame([(3, 4)], "x int, z int")
    rows = sorted(map(tuple, reshape.concat_rows(a, b).select("x", "y", "z").collect()))
    assert rows == [(1, 2, None), (3, None, 4)]


def test_long_and_wide(spark):
    wide = spark.createDataFrame([("r", 1.0, 2.0)], "label string, a double, b double")
    long = reshape.wide_to_long(wide, ["label"], ["a", "b"], "period", "value")
    assert sorted(map(tuple, long.collect())) == [("r", "a", 1.0), ("r", "b", 2.0)]
    assert [tuple(r) for r in reshape.long_to_wide(long, ["label"], "period", ["a", "b"], "value").collect()] == [("r", 1.0, 2.0)]


def test_statements_round_trip_prunes_folders(spark, tmp_path):
    path = str(tmp_path / "store")
    table = statements.order_statements(spark, FOLDER)
    statements.write_statements(table, path)
    company = table.first()["company"]
    one = statements.read_statements(spark, path, company, "cis")
    assert one.count() == table.where((F.col("company") == company) & (F.col("statement") == "cis")).count() > 0
    plan = one._jdf.queryExecution().executedPlan().toString()
    pruned = plan.split("PartitionFilters: [")[1].split("], PushedFilters")[0]
    assert "bucket" in pruned and f"EqualTo(company,{company})" in plan
    assert statements.read_statements(spark, path, "nobody").count() == 0


def statement_rows(names, value=1.0, sector="s"):
    return [(sector, c, s, f"l{i}", dt.date(2020, 12, 31), value + i) for c in names for s in ("cis", "bs") for i in range(2)]


STATEMENT_SCHEMA = "sector string, company string, statement string, label string, period date, value double"


def stored_rows(spark, path):
    return sorted(map(tuple, statements.read_statements(spark, path).select("sector", "company", "statement", "label", "period", "value").collect()))


def parquet_files(path):
    return [str(f) for f in path.rglob("*.parquet")]


def test_publishing_replaces_one_company_only(spark, tmp_path):
    path = tmp_path / "store"
    names = [f"c{i}" for i in range(500)]
    everyone = spark.createDataFrame(statement_rows(names), STATEMENT_SCHEMA)
    statements.publish_statements(everyone, str(path), buckets=8)
    assert len(parquet_files(path)) <= 8
    assert stored_rows(spark, str(path)) == sorted(statement_rows(names))
    untouched = {f: open(f, "rb").read() for f in parquet_files(path)}
    for value in (50.0, 70.0):
        statements.publish_statements(spark.createDataFrame(statement_rows(["c3"], value), STATEMENT_SCHEMA), str(path))
    statements.publish_statements(spark.createDataFrame(statement_rows(["new"], 9.0), STATEMENT_SCHEMA), str(path))
    want = statement_rows([n for n in names if n != "c3"]) + statement_rows(["c3"], 70.0) + statement_rows(["new"], 9.0)
    assert stored_rows(spark, str(path)) == sorted(want)
    same = [f for f in parquet_files(path) if untouched.get(f) == open(f, "rb").read()]
    assert len(same) >= 6  # at most two folders were written anew
    assert statements.read_statements(spark, str(path), "c3", "bs").agg(F.sum("value")).first()[0] == 141.0


def test_nested_store_and_back(spark):
    rows = statement_rows(["a", "b"], 1.0, "s2") + statement_rows(["b", "c"], 5.0, "s1")
    table = spark.createDataFrame([*rows, ("s1", "c", "cf", "x", None, None)], STATEMENT_SCHEMA)
    sectors = spark.createDataFrame([("s1", 0), ("s2", 1)], "sector string, sector_ord int")
    metrics = spark.createDataFrame([("b", "roe", 0.5), ("b", "per", None)], "company string, metric string, value double")
    nested = statements.nest_statements(table, sectors, metrics, parts=2)
    assert nested.schema["store"].dataType.simpleString() == statements.NESTED.replace(": ", ":").replace(", ", ",")
    long = statements.unnest_statements(nested).select(*table.columns)
    assert sorted(map(str, long.collect())) == sorted(map(str, table.collect()))
    found = statements.unnest_metrics(nested).select("sector", "company", "metric", "value").collect()
    assert {tuple(r) for r in found} == {(s, "b", m, v) for s in ("s1", "s2") for m, v in (("roe", 0.5), ("per", None))}
    one = statements.company_of_nested(nested, "b").select(*table.columns).collect()
    assert sorted(map(tuple, one)) == sorted(r for r in rows if r[:2] == ("s1", "b"))
    assert {r["sector"] for r in statements.company_of_nested(nested, "a").collect()} == {"s2"}
    assert statements.company_of_nested(nested, "nobody").count() == 0
    assert statements.unnest_statements(nested.limit(0)).count() == 0


def test_wide_statements_put_the_newest_year_first(spark):
    wide = statements.wide_statements(statements.order_statements(spark, FOLDER))
    years = [c for c in wide.columns if c not in statements.STATEMENT_KEYS]
    assert years == sorted(years, reverse=True) and all(y.endswith("1231") for y in years)


def test_first_sector(spark):
    rows = [("s2", "x", "cis", "l", 1.0), ("s1", "x", "cis", "l", 2.0), ("s2", "y", "cis", "l", 3.0)]
    table = spark.createDataFrame(rows, "sector string, company string, statement string, label string, value double")
    sectors = spark.createDataFrame([("s1", 0), ("s2", 1)], "sector string, sector_ord int")
    got = {(r["company"], r["sector"]) for r in statements.first_sector_statements(table, sectors).collect()}
    assert got == {("x", "s1"), ("y", "s2")}


def test_transpose_keeps_nulls(spark):
    wide = spark.createDataFrame([("c", 1.5, None)], "company string, roe double, per double")
    got = sorted(map(tuple, statements.transpose_metrics(wide, "company").collect()))
    assert got == [("c", "per", None), ("c", "roe", 1.5)]


def test_company_pages(spark, tmp_path):
    store = statements.part_statements(spark, FOLDER)
    names = [r[0] for r in store.select("sector").distinct().orderBy("sector").collect()]
    sectors = spark.createDataFrame(list(enumerate(names)), "sector_ord int, sector string")
    path = str(tmp_path / "published")
    company.publish_statements(store, sectors, path)
    shown = company.company_statements(spark, path, "Brand#1")
    assert {k: v.count() > 0 for k, v in shown.items()} == {"cis": True, "bs": True, "cf": False}
    assert shown["cis"].select("sector").distinct().count() == 1
    assert all(t.count() == 0 for t in company.company_statements(spark, path, "nobody").values())
    metrics = company.company_metrics(statements.order_metrics(spark, FOLDER), "NATION_3").collect()
    assert {r["company"] for r in metrics} == {"NATION_3"} and len(metrics) == 18


@pytest.mark.parametrize("horizon", [1, 6])
def test_charts(spark, horizon):
    closes = spark_frame(spark, bars(range(1, 41))).select("ticker", "date", "close")
    days = [d.date() for d in pd.bdate_range(bars(range(1, 41))["date"].iloc[-1], periods=horizon + 1)[1:]]
    forecasts = spark.createDataFrame([("A", d, 100.0 + i) for i, d in enumerate(days)], "ticker string, date date, forecast double")
    whole = by_ticker(report.whole_chart(closes, forecasts))["A"]
    assert len(whole) == 40 + horizon
    np.testing.assert_allclose(whole["moving_average"], whole["close"].rolling(20, min_periods=20).mean())
    assert whole[whole["is_boundary"]]["date"].tolist() == days[:1]
    assert whole.index[whole["is_tick"]].tolist() == list(whole.index[::-1][::20][::-1])
    recent = by_ticker(report.recent_chart(closes, forecasts, horizon))["A"]
    assert recent["part"].tolist() == ["actual"] * horizon + ["predicted"] * horizon
    assert recent.index[recent["is_tick"]].tolist() == list(recent.index[::-1][::5][::-1])


def test_correlation_pairs(spark):
    rng = np.random.default_rng(1)
    pdf = bars(rng.normal(size=50))
    pdf["open"] = rng.normal(size=50)
    got = features.correlation_pairs(spark_frame(spark, pdf), ["close", "open", "volume"]).collect()
    want = pdf[["close", "open", "volume"]].corr().round(3)
    assert len(got) == 3
    assert all(r["corr"] == pytest.approx(want.loc[r["col_a"], r["col_b"]]) for r in got)


def test_one_pass_market_equals_the_single_sources(spark):
    loaded = market.load_market(spark, FOLDER)
    for a, b in (
        (loaded.bars, market.daily_bars(spark, FOLDER)),
        (loaded.flows, market.daily_flows(spark, FOLDER)),
        (loaded.index, market.daily_index(spark, FOLDER)),
    ):
        assert a.exceptAll(b.select(*a.columns)).count() == 0 and a.count() == b.count()


def test_unknown_ticker_grain(spark):
    with pytest.raises(ValueError):
        market.daily_bars(spark, FOLDER, by="planet")


def test_bar_scan_is_pruned_and_filters_reach_it(spark, tmp_path):
    path = str(tmp_path / "bars")
    table = market.daily_bars(spark, FOLDER)
    market.write_bars(table, path)
    start, end = dt.date(1996, 5, 1), dt.date(1997, 6, 30)
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    kept = market.read_bars(spark, path, start, end, ["BUILDING"])
    plan = kept.select("close")._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "GreaterThanOrEqual(date" in plan and "EqualTo(ticker,BUILDING)" in plan
    assert "PartitionFilters: [isnotnull(year" in plan
    assert "open" not in plan.split("ReadSchema")[1]
    want = table.where(F.col("date").between(start, end) & (F.col("ticker") == "BUILDING"))
    assert kept.count() == want.count() > 0 and kept.exceptAll(want).count() == 0


def test_bar_store_is_dealt_by_ranges_and_skips_what_others_hold(spark, tmp_path):
    path = tmp_path / "bars"
    table = spark.range(60_000).select(
        F.concat(F.lit("T"), F.lpad(F.pmod("id", F.lit(200)).cast("string"), 3, "0")).alias("ticker"),
        F.date_add(F.lit(dt.date(2019, 12, 1)), F.expr("CAST(id DIV 200 AS INT)")).alias("date"),
        F.col("id").cast("double").alias("close"),
    )
    market.write_bars(table.orderBy(F.rand(3)), str(path), rows_per_file=5000)
    files = parquet_files(path)
    assert len(files) >= 12 and max(spark.read.parquet(f).count() for f in files) < 12_000
    for f in files:
        own = [(r["ticker"], r["date"]) for r in spark.read.parquet(f).collect()]
        assert own == sorted(own)
    assert market.stored_years(spark, str(path)) == [2019, 2020]
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    kept = market.read_bars(spark, str(path), dt.date(2020, 2, 1), dt.date(2020, 3, 1), ["T007"])
    plan = kept._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "EqualTo(ticker,T007)" in plan and "GreaterThanOrEqual(date" in plan and "PartitionFilters: [isnotnull(year" in plan
    assert kept.count() == 30
    holding = [f for f in files if spark.read.parquet(f).where("ticker = 'T007'").count()]
    assert len(holding) <= 3


def test_the_latest_stored_day_reads_one_year(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "bars")
    rows = [("A", dt.date(2018, 5, 2)), ("A", dt.date(2020, 5, 4)), ("B", dt.date(2019, 1, 7)), ("B", None)]
    market.write_bars(spark.createDataFrame(rows, "ticker string, date date"), path)
    read = []
    plain = market.bars_between
    monkeypatch.setattr(market, "bars_between", lambda df, *a: read.append(df.inputFiles()) or plain(df, *a))
    assert market.latest_stored_day(spark, path) == dt.date(2020, 5, 4)
    assert len(read) == 1
    plan = spark.read.parquet(path).where(F.col("year") == 2020)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan
    assert market.latest_stored_day(spark, path, ["B"]) == dt.date(2019, 1, 7)
    assert market.latest_stored_day(spark, path, ["C"]) is None


@pytest.fixture
def shuffled_joins(spark):
    """No broadcasts, and thresholds small enough for the skew rule to act."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100KB",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_one_customer_with_half_of_all_trades(spark, tmp_path, shuffled_joins):
    """The hot customer's join partition is split, and the bars stay whole."""
    rng = np.random.default_rng(6)
    n = 200_000
    orders = pd.DataFrame(
        {
            "o_orderkey": np.arange(n),
            "o_custkey": np.where(rng.random(n) < 0.5, 7, rng.integers(0, 500, n)),
            "o_totalprice": rng.integers(100, 9999, n) / 100,
            "o_orderdate": pd.Timestamp("2000-01-03") + pd.to_timedelta(rng.integers(0, 60, n), "D"),
            "o_orderpriority": rng.choice(["1-URGENT", "5-LOW"], n),
        }
    )
    customer = pd.DataFrame(
        {"c_custkey": np.arange(500), "c_mktsegment": [f"S{i % 5}" for i in range(500)], "c_nationkey": 0}
    )
    spark.createDataFrame(orders).repartition(8).write.parquet(str(tmp_path / "orders.parquet"))
    spark.createDataFrame(customer).write.parquet(str(tmp_path / "customer.parquet"))
    bars_df = market.daily_bars(spark, str(tmp_path))
    got = bars_df.toPandas().set_index(["ticker", "date"]).sort_index()
    assert "skew=true" in bars_df._jdf.queryExecution().executedPlan().toString()
    joined = orders.merge(customer, left_on="o_custkey", right_on="c_custkey").sort_values("o_orderkey")
    groups = joined.groupby([joined["c_mktsegment"], joined["o_orderdate"].dt.date])["o_totalprice"]
    want = groups.agg(["first", "max", "min", "last", "count"])
    np.testing.assert_array_equal(got.to_numpy(), want.to_numpy().astype(float))


def test_shared_dir_follows_the_session(spark):
    assert session.shared_dir(spark)
    assert session.scratch_path(spark, "x") != session.scratch_path(spark, "x")
    kept = session.materialize(spark.range(5).withColumn("v", F.col("id") * 2))
    assert kept.agg(F.sum("v")).first()[0] == 20


def test_numeric_categories_are_in_order_of_size(spark):
    df = spark.createDataFrame([(2.0, 2), (10.0, 10), (float("nan"), 10), (None, None)], "x double, k int")
    codes = {(r["col"], r["value"]): r["code"] for r in encoders.fit_label_encoder(df, ["x", "k"]).collect()}
    assert codes == {("x", "2.0"): 0, ("x", "10.0"): 1, ("k", "2"): 0, ("k", "10"): 1}


def test_a_request_reads_its_days_only(spark):
    start, end = dt.date(2000, 1, 3), dt.date(2000, 6, 30)
    trades = market._trades(spark, FOLDER, "customer", start, end, ["000003"])
    plan = trades._jdf.queryExecution().toString()
    pushed = [line for line in plan.splitlines() if "FileScan" in line and "o_orderdate" in line]
    assert pushed and all("GreaterThanOrEqual(o_orderdate" in line and "LessThan(o_orderdate" in line for line in pushed)
    rows = trades.select("date", "ticker").collect()
    assert rows and all(start <= r["date"] <= end and r["ticker"] == "000003" for r in rows)


def test_the_index_counts_orders_without_a_customer(spark, tmp_path):
    day = dt.datetime(2020, 1, 6)
    orders = [(1, 1, 10.0, "2-HIGH", day), (2, 99, 30.0, "2-HIGH", day)]
    names = "o_orderkey long, o_custkey long, o_totalprice double, o_orderpriority string, o_orderdate timestamp"
    spark.createDataFrame(orders, names).write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(1, "X")], "c_custkey long, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    loaded = market.load_market(spark, str(tmp_path))
    assert [r["kospi"] for r in loaded.index.collect()] == [20.0]
    assert [r["kospi"] for r in market.daily_index(spark, str(tmp_path)).collect()] == [20.0]


def test_a_stored_null_comes_back(spark):
    schema = "sector string, company string, statement string, label string, period date, value double"
    rows = [("s", "c", "cis", "x", dt.date(2020, 12, 31), None), ("s", "c", "cis", "x", dt.date(2021, 12, 31), 5.0)]
    stored = spark.createDataFrame(rows, schema)
    back = statements.long_statements(statements.wide_statements(stored))
    assert sorted((r["period"], r["value"]) for r in back.select("period", "value").collect()) == [(r[4], r[5]) for r in rows]
