"""Ordered scans against pandas, with short ranges and blocks so that every carry is used."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lumenframe.operators.ordered import fill, interpolate, over_rows, running
from lumenframe.operators.quantiles import column_quantiles, group_quantiles
from lumenframe.operators.ranks import rank
from lumenframe.operators.windows import pct_change, top_k_per_group


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(1)
    n = 1200
    p = pd.DataFrame({"id": np.arange(n), "g": np.where(rng.random(n) < .4, "hot", rng.integers(0, 20, n).astype(str)),
                      "v": rng.integers(0, 90, n).astype(float)})
    p.loc[rng.random(n) < .2, "v"] = np.nan
    return p


@pytest.fixture(scope="module")
def table(spark, frame):
    out = spark.createDataFrame(frame.sample(frac=1, random_state=2)).repartition(5).cache()
    out.count()
    return out


def apply(frame, part, fn):
    v = frame.set_index("id")
    return v.groupby("g").v.transform(fn) if part else fn(v.v)


def same(df, column, expected):
    got = df.toPandas().set_index("id").sort_index()[column].astype(float)
    np.testing.assert_allclose(got, expected.astype(float), equal_nan=True)


@pytest.mark.parametrize("ranges,part", [(4, []), (40, ["g"])])
def test_running(table, frame, ranges, part):
    out = running(table, {"s": ("sum", "v"), "c": ("count", "v"), "m": ("mean", "v"), "hi": ("max", "v")}, "id", part, "rn", ranges)
    same(out, "s", apply(frame, part, lambda x: x.fillna(0).cumsum()))
    same(out, "c", apply(frame, part, lambda x: x.notna().cumsum()))
    same(out, "hi", apply(frame, part, lambda x: x.expanding(1).max()))
    same(out, "m", apply(frame, part, lambda x: x.expanding(1).mean()))
    same(out, "rn", apply(frame, part, lambda x: pd.Series(np.arange(1, len(x) + 1), x.index)))


@pytest.mark.parametrize("part", [[], ["g"]])
def test_fill_and_interpolate(table, frame, part):
    out = fill(table, {"f": ("v", "forward"), "b": ("v", "backward")}, "id", part, block_rows=37, ranges=6)
    same(out, "f", apply(frame, part, lambda x: x.ffill()))
    same(out, "b", apply(frame, part, lambda x: x.bfill()))
    same(interpolate(table, ["v"], "id", part, block_rows=37, ranges=6), "v", apply(frame, part, lambda x: x.interpolate()))


@pytest.mark.parametrize("part", [[], ["g"]])
def test_rolling_and_shifts_cross_blocks(table, frame, part):
    out = over_rows(table, {"r": F.sum("v")}, 4, 2, "id", part, block_rows=20, ranges=6, shifts={"l": ("v", 3), "n": ("v", -2)})
    same(out, "l", apply(frame, part, lambda x: x.shift(3)))
    same(out, "n", apply(frame, part, lambda x: x.shift(-2)))
    same(out, "r", apply(frame, part, lambda x: pd.Series(
        [x.iloc[max(0, k - 4):k + 3].sum(min_count=1) for k in range(len(x))], x.index)))


def test_pct_change(table, frame):
    got = pct_change(table, "v", 1, "id", name="p", ranges=5)
    with np.errstate(divide="ignore", invalid="ignore"):
        expected = apply(frame, [], lambda x: (x.ffill() / x.ffill().shift(1).replace(0, np.nan) - 1))
    same(got, "p", expected)


@pytest.mark.parametrize("method", ["dense", "min", "max", "average"])
def test_rank_with_hot_values(table, frame, method):
    out = rank(table, "v", method, by=["g"], ranges=8, hot_rows=5)
    same(out, "v_rank", apply(frame, ["g"], lambda x: np.floor(x.rank(method=method, ascending=False))))


def test_descending_order(table, frame):
    out = running(table, {}, [("v", False), "id"], row_number="rn", ranges=9).where("v is not null")
    expected = frame.dropna().sort_values(["v", "id"], ascending=[False, True])
    got = out.toPandas().sort_values("rn")
    assert got.id.tolist() == expected.id.tolist() and got.rn.tolist() == list(range(1, len(expected) + 1))


def test_quantiles_small_and_bracketed(table, frame):
    probs = [0, .1, .25, .5, .9, 1]
    expected = {c: frame[c].quantile(probs).tolist() for c in ("v", "id")}
    for small in (10_000, 50):
        got = column_quantiles(table, ["v", "id"], probs, small=small, accuracy=100)
        for c in expected:
            np.testing.assert_allclose(got[c], expected[c])
    assert column_quantiles(table.where("false"), ["v"], [.5]) == {"v": [None]}


def test_group_quantiles_with_large_groups(table, frame):
    got = {r.g: r.q for r in group_quantiles(table, ["g"], "v", [.1, .5, .97], small=60).collect()}
    for g, e in frame.groupby("g").v.quantile([.1, .5, .97]).unstack().iterrows():
        np.testing.assert_allclose(got[g], e.values)


def test_top_k_keeps_ties(table, frame):
    got = top_k_per_group(table, ["g"], "v", 2).toPandas()
    dense = frame.groupby("g").v.rank(method="dense", ascending=False)
    assert sorted(got.id) == sorted(frame.id[dense <= 2])


def test_empty_and_constant_tables(spark):
    empty = spark.createDataFrame([], "id long, g string, v double")
    assert running(empty, {"s": ("sum", "v")}, "id", row_number="n").count() == 0
    assert rank(empty, "v").count() == 0
    one = spark.createDataFrame([(1, "a", None)], "id long, g string, v double")
    assert [tuple(r) for r in fill(one, {"f": ("v", "forward")}, "id").select("f").collect()] == [(None,)]


@pytest.mark.parametrize("build", [
    lambda t: running(t, {"s": ("sum", "v")}, "id"),
    lambda t: over_rows(t, {"m": F.avg("v")}, 3, 0, "id"),
    lambda t: rank(t, "v"),
])
def test_rows_never_go_to_one_task(table, build):
    """The only single-partition exchange allowed is the one over range totals, which has one row per range."""
    plan = build(table)._jdf.queryExecution().executedPlan().toString()
    for part in plan.split("Exchange SinglePartition")[1:]:
        below = part[:600]
        assert "__n" in below and "count" in below, below


def test_large_groups_are_counted_and_folded_once(spark):
    t = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    out = group_quantiles(t, ["l_returnflag"], "l_extendedprice", [.5], small=60)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 1
