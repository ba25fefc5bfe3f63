"""Null keys in lookups and short series in forecasts."""

import datetime as dt

import pytest

from lumenframe.operators.ranks import rank
from lumenframe.operators.timeseries import backtest, forecast
from lumenframe.operators.windows import top_k_per_group


@pytest.fixture(scope="module")
def groups(spark):
    rows = [(1, None, 5.0), (2, None, 7.0), (3, None, None), (4, "a", 1.0), (5, "a", 1.0), (6, "a", 3.0), (7, "b", None), (8, None, 7.0)]
    return spark.createDataFrame(rows, "id long, g string, v double")


@pytest.mark.parametrize("hot_rows", [0, 1, 1_000_000])
def test_rank_with_null_group(groups, hot_rows):
    got = {r.id: r.v_rank for r in rank(groups, "v", by=["g"], hot_rows=hot_rows).collect()}
    assert got == {1: 2, 2: 1, 3: None, 4: 2, 5: 2, 6: 1, 7: None, 8: 1}


def test_top_k_keeps_the_null_group(groups):
    got = sorted((r.id, r["rank"]) for r in top_k_per_group(groups, ["g"], "v", 1).collect())
    assert got == [(2, 1), (6, 1), (8, 1)]


def test_short_series(spark):
    rows = [(n, dt.datetime(2020 + i // 12, i % 12 + 1, 1), 100.0 + i) for n in (1, 5, 8, 15, 23, 24, 30) for i in range(n)]
    series = spark.createDataFrame(rows, "g long, period timestamp_ntz, value double")
    got = {}
    for r in forecast(series, 3, "M", "holt_winters", ["g"]).collect():
        got.setdefault(r.g, []).append(r)
    assert {g: len(rs) for g, rs in got.items()} == dict.fromkeys((1, 5, 8, 15, 23, 24, 30), 3)
    for g, rs in got.items():
        assert all((r.forecast is not None) == (g >= 24) for r in rs)
        assert all((r.lower_80 is not None) == (r.upper_95 is not None) == (g >= 30) for r in rs)
    errors = {r.g: r.rmse for r in backtest(series, "holt_winters", ["g"]).collect()}
    assert {g for g, e in errors.items() if e is not None} == {30}
    smooth = {r.g: r.forecast for r in forecast(series, 1, "M", "moving_average", ["g"]).collect()}
    assert {g for g, f in smooth.items() if f is None} == {1, 5} and smooth[8] == 105.5
