"""Every registered query against its SQL on DuckDB, at the smallest scale."""

import datetime as dt

import pytest
from compare import duck, duck_rows, spark_rows

import __spark_entry__ as entry_module
from panelcast.catalog.oracles import ORACLES
from panelcast.catalog.queries import registry

FOLDER = "/root/testdata/sf0.001"
# At the smallest scale a nation trades on few of the 250 days: its regressions are
# singular there, and the SQL solver, which drops columns, picks other weights.
FOLDERS = {"forecast_job_fine": "/root/testdata/sf0.01"}
# Forecasts of tuned models that SQL does not solve, and the board of all models.
ROWS_ONLY = sorted(set(registry()) - set(ORACLES) - {"leaderboard_all"})


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(registry()) <= set(entry_module.queries())
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, con, name):
    folder = FOLDERS.get(name, FOLDER)
    got, columns = spark_rows(registry()[name](spark, folder))
    want, expected = duck_rows(con if folder == FOLDER else duck(folder), ORACLES[name])
    assert columns == expected
    assert len(got) == len(want)
    assert got == want


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_model_rows(spark, name):
    rows = registry()[name](spark, FOLDER).collect()
    assert rows
    for row in rows:
        assert row["y_hat"] is not None and abs(row["y_hat"]) < 1e8
        assert (row["y"] is None) == (row["role"] == "test")


def test_the_board_of_all_models(spark):
    rows = registry()["leaderboard_all"](spark, FOLDER).collect()
    by_ticker = {}
    for r in rows:
        by_ticker.setdefault(r["ticker"], {})[r["model"]] = r
    assert len(by_ticker) == 5
    for board in by_ticker.values():
        best = board.pop("best_model")
        assert set(board) == {"Linear", "ElasticNet", "KNN", "XGB_GBT", "LGB_RandomForest", "LGB_GOSS", "ARIMA"}
        for h in range(1, 6):
            assert best[f"time_gap_{h}"] == min(r[f"time_gap_{h}"] for r in board.values())
        assert all(r["avg"] > 0 and r["std"] is not None for r in board.values())


def test_entry(spark):
    df = entry_module.entry(spark)
    assert {"ticker", "model", "horizon", "date", "forecast", "nmae"} <= set(df.columns)
    assert all(isinstance(r["date"], dt.date) for r in df.collect())
