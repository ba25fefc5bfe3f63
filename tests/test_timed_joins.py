"""As-of, interval and overlap joins against loops over all pairs."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__  # noqa: F401, registers the queries
from lumenframe.operators import ordered, timed_joins
from lumenframe.operators.timed_joins import asof_join, interval_join, overlap_join
from lumenframe.plans.registry import QUERIES

NOON = dt.datetime(2024, 5, 1, 12)


def tables(spark, seed, n=120):
    rng = random.Random(seed)

    def some(count, first):
        return [(first + i, rng.choice([1, 1, 1, 1, 2, 3, None]), rng.choice([None] + [NOON + dt.timedelta(minutes=m) for m in range(60)])) for i in range(count)]
    left, right = some(n, 0), some(n, 1_000)
    kinds = "{0} long, k int, {1} timestamp"
    return left, right, spark.createDataFrame(left, kinds.format("a", "ts")).repartition(3), spark.createDataFrame(right, kinds.format("b", "at")).repartition(3)


def nearest(row, right, direction, exact, limit, nulls):
    key, t = row[1], row[2]
    if t is None or (key is None and not nulls):
        return None
    sides = {"backward": [], "forward": []}
    for b, k, at in right:
        if k == key and at is not None and (exact or at != t) and (limit is None or abs(at - t) <= limit):
            if at <= t:
                sides["backward"].append(((at, b), b, t - at))
            if at >= t:
                sides["forward"].append(((at, b), b, at - t))
    back, on = max(sides["backward"], default=None), min(sides["forward"], default=None)
    if direction == "nearest":
        return (back if on is None or (back is not None and back[2] <= on[2]) else on or (None, None))[1] if back or on else None
    found = back if direction == "backward" else on
    return found and found[1]


@pytest.mark.parametrize("direction,exact,limit,nulls", [
    ("backward", True, None, True), ("backward", False, None, False), ("forward", True, None, True), ("forward", False, 3, False),
    ("nearest", True, None, True), ("nearest", True, 2, False)])
def test_asof(spark, direction, exact, limit, nulls):
    left, right, a, b = tables(spark, 7)
    out = asof_join(a, b, "ts", "at", "k", direction=direction, exact=exact, tie="b", tolerance=limit and f"{limit} minutes", null_keys_match=nulls)
    assert out.columns == ["a", "k", "ts", "b", "at"]
    got = {r.a: r.b for r in out.collect()}
    span = limit and dt.timedelta(minutes=limit)
    assert got == {row[0]: nearest(row, right, direction, exact, span, nulls) for row in left}
    inner = asof_join(a, b, "ts", "at", "k", direction=direction, exact=exact, tie="b", tolerance=limit and f"{limit} minutes", null_keys_match=nulls, how="inner")
    assert {r.a for r in inner.collect()} == {k for k, v in got.items() if v is not None}


def test_asof_of_a_hot_key_is_cut_into_ranges(spark, monkeypatch):
    """One key holds all rows; small blocks and ranges must not change the result."""
    left = spark.range(4_000).select(F.col("id").alias("a"), F.lit(1).alias("k"), (F.col("id") * 3).alias("ts"))
    right = spark.range(200).select(F.col("id").alias("b"), F.lit(1).alias("k"), (F.col("id") * 60 + 1).alias("ts"))
    monkeypatch.setattr(ordered.fill, "__defaults__", ((), 97, 16, False, None))
    got = asof_join(left, right, "ts", by="k", tie="b")
    assert got.columns == ["a", "k", "ts_x", "b", "ts_y"]
    assert all(r.b == (None if r.ts_x < 1 else min((r.ts_x - 1) // 60, 199)) for r in got.collect())


def test_asof_numbers_and_empty_tables(spark):
    a, b = spark.createDataFrame([(1, 2.5), (2, float("nan")), (3, -1.0)], "a int, x double"), spark.createDataFrame([(7, 2.0), (8, 4.0)], "b int, x double")
    assert {r.a: r.b for r in asof_join(a, b, "x", direction="nearest", tolerance=1.0).collect()} == {1: 7, 2: None, 3: None}
    assert {r.a: r.b for r in asof_join(a, b.limit(0), "x").collect()} == {1: None, 2: None, 3: None}
    assert asof_join(a.limit(0), b, "x").count() == 0
    with pytest.raises(ValueError):
        asof_join(a, b, "x", direction="sideways")
    with pytest.raises(ValueError):
        asof_join(a, b, "x", direction="nearest", exact=False)


def spans(rng, n, first, places):
    out = []
    for i in range(n):
        s, length = rng.choice(places), rng.choice([0, 0, 1, 2, 7, 500, 10 ** 6, -3])
        out.append((first + i, rng.choice([1, 1, 1, 2, None]), None if i % 17 == 0 else float(s), None if i % 23 == 0 else float(s + length)))
    return out


@pytest.mark.parametrize("keyed", [True, False])
def test_intervals(spark, keyed):
    rng = random.Random(3)
    places = [0, 1, 2, 3, 5, 8, 0.5, -1, -7.25, 1e-9, 499, 501, 10 ** 6, 1e15, -1e15]
    points = [(i, rng.choice([1, 1, 2, None]), rng.choice([*places, None, 4, 4])) for i in range(150)]
    one, two = spans(rng, 90, 0, places), spans(rng, 90, 500, places)
    p = spark.createDataFrame([(a, k, x if x is None else float(x)) for a, k, x in points], "a int, k int, x double")
    left, right = spark.createDataFrame(one, "i int, k int, s double, e double"), spark.createDataFrame(two, "j int, k int, s double, e double")
    on = ["k"] if keyed else []

    def same(k, q):
        return k == q or not keyed
    want = sorted((a, i) for a, k, x in points for i, q, s, e in one if same(k, q) and None not in (x, s, e) and s <= x <= e)
    assert want and sorted((r.a, r.i) for r in interval_join(p, left, "x", "s", "e", on).collect()) == want
    assert sorted(r.a for r in interval_join(p, left, "x", "s", "e", on, how="semi", key="a").collect()) == sorted({a for a, _ in want})
    assert sorted(r.a for r in interval_join(p, left, "x", "s", "e", on, how="anti", key="a").collect()) == sorted({r[0] for r in points} - {a for a, _ in want})
    kept = interval_join(p, left, "x", "s", "e", on, how="left", key="a")
    assert kept.count() == len(want) + len({r[0] for r in points} - {a for a, _ in want})
    proper = [[r for r in t if None not in r[2:] and r[2] <= r[3]] for t in (one, two)]
    pairs = sorted((i, j) for i, k, s, e in proper[0] for j, q, c, d in proper[1] if same(k, q) and s <= d and c <= e)
    assert pairs and sorted((r.i, r.j) for r in overlap_join(left, right, ("s", "e"), ("s", "e"), on).collect()) == pairs
    assert interval_join(p, left.limit(0), "x", "s", "e", on).count() == 0


def test_no_plan_pairs_all_rows(spark):
    for name in ("D6_asof_last_view", "D6_interval_join_orders_placed_meanwhile", "D6_overlap_join_open_orders", "D6_band_join_balances"):
        plan = QUERIES[name].run(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan, name


def test_ranges_follow_the_rows(spark, monkeypatch):
    monkeypatch.setattr(ordered, "RANGE_ROWS", 500)
    o = ordered.cut(spark.range(20_000).select((F.col("id") * 7919 % 20_011).alias("v")), "v")
    assert max(r["count"] for r in o.df.groupBy(ordered.RANGE).count().collect()) <= 1_000


def test_points_are_not_copied_to_all_widths_nor_broadcast(spark):
    """Few intervals for each key: a point has one row in the join, whatever the widths in use."""
    points = spark.range(2_000).select(F.col("id").alias("a"), (F.col("id") % 50).alias("k"), (F.col("id") * 1.0).alias("x"))
    spans = spark.range(500).select(F.col("id").alias("b"), (F.col("id") % 50).alias("k"), (F.col("id") * 2.0).alias("s"), (F.col("id") * 2.0 + F.pow(F.lit(2.0), F.col("id") % 20)).alias("e"))
    out = interval_join(points, spans, "x", "s", "e", "k")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and plan.count("BroadcastHashJoin") == plan.count("LeftOuter, BuildRight")
    assert str(timed_joins.FLAT) in plan
    want = sum(1 for i in range(2_000) for j in range(500) if i % 50 == j % 50 and 2 * j <= i <= 2 * j + 2 ** (j % 20))
    assert out.count() == want


@pytest.mark.parametrize("crowd", [1, 1_000])
def test_crowded_cells_are_cut_into_slices(spark, monkeypatch, crowd):
    """All points and intervals of a key meet in one cell, copies among them; slices must neither lose nor repeat a pair."""
    for name, value in (("CROWD", crowd), ("SLICE_POINTS", 40), ("SLICE_INTERVALS", 25)):
        monkeypatch.setattr(timed_joins, name, value)
    points = spark.range(600).select(F.col("id").alias("a"), F.when(F.col("id") % 9 != 0, F.lit(1)).alias("k"), (F.col("id") % 4 / 4.0).alias("x"))
    spans = spark.range(300).select(F.col("id").alias("b"), F.when(F.col("id") % 9 != 0, F.lit(1)).alias("k"), (F.col("id") % 3 / 4.0).alias("s"), (F.col("id") % 3 / 4.0 + 0.25).alias("e"))
    got = sorted((r.a, r.b) for r in interval_join(points, spans, "x", "s", "e", "k").collect())
    want = sorted((i, j) for i in range(600) for j in range(300) if (i % 9 == 0) == (j % 9 == 0) and j % 3 <= i % 4 <= j % 3 + 1)
    assert got == want
    bare = interval_join(points.drop("k"), spans.drop("k"), "x", "s", "e")
    assert bare.count() == sum(1 for i in range(600) for j in range(300) if j % 3 <= i % 4 <= j % 3 + 1)
    assert "i1" in bare._jdf.queryExecution().optimizedPlan().toString()


def test_overlaps_of_keys_with_few_intervals_need_no_grid(spark):
    spans = spark.range(900).select(F.col("id").alias("b"), (F.col("id") % 90).alias("k"), (F.col("id") * 2.0).alias("s"), (F.col("id") * 2.0 + F.pow(F.lit(2.0), F.col("id") % 9)).alias("e"))
    out = overlap_join(spans, spans, ("s", "e"), ("s", "e"), "k")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 2 and str(timed_joins.FLAT) in plan
    rows = [(i, i % 90, 2.0 * i, 2.0 * i + 2.0 ** (i % 9)) for i in range(900)]
    assert out.count() == sum(1 for _, k, a, b in rows for _, q, c, d in rows if k == q and a <= d and c <= b)


def test_tasks_grow_with_the_pairs_of_a_band_join(spark, monkeypatch):
    points = spark.range(3_000).select(F.col("id").alias("a"), (F.col("id") % 100 * 1.0).alias("x"))
    spans = spark.range(1_000).select(F.col("id").alias("b"), (F.col("id") % 100 * 1.0).alias("s"), (F.col("id") % 100 + 5.0).alias("e"))
    monkeypatch.setattr(timed_joins, "CROWD", 100)
    few = interval_join(points, spans, "x", "s", "e")
    assert "REPARTITION_BY_NUM" not in few._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(timed_joins, "COMPARED", 10_000)
    out = interval_join(points, spans, "x", "s", "e")
    assert out._jdf.queryExecution().executedPlan().toString().count("REPARTITION_BY_NUM") == 2
    assert out.count() == few.count() == sum(1 for i in range(3_000) for j in range(1_000) if 0 <= i % 100 - j % 100 <= 5)


def test_overlaps_without_crowded_keys_are_not_cut_and_read_one_table_once(spark, monkeypatch):
    """Key 1 is crowded on one side only."""
    rng, stored, cut = random.Random(3), [], []
    put, sliced = timed_joins._stored, timed_joins._sliced
    monkeypatch.setattr(timed_joins, "_stored", lambda df: stored.append(1) or put(df))
    monkeypatch.setattr(timed_joins, "_sliced", lambda *a: cut.append(1) or sliced(*a))

    def some(ones):
        return [(i, k, lo, rng.choice([None, lo - 2, lo, lo + rng.randrange(40)]) if lo is not None else 9)
                for i, k in enumerate([1] * ones + [2, 2, 2, 3, 3, None, None] * 4) for lo in [rng.choice([None, *range(100)])]]
    left, right = some(40), some(9)
    a, b = spark.createDataFrame(left, "i long, k int, a int, b int"), spark.createDataFrame(right, "j long, k int, a int, b int")

    def wanted(left, right, nulls):
        return sorted((x[0], y[0]) for x in left for y in right if x[1] == y[1] and (nulls or x[1] is not None) and None not in (*x[2:], *y[2:])
                      and x[2] <= x[3] and y[2] <= y[3] and x[2] <= y[3] and y[2] <= x[3])
    for crowd, cuts in ((20, 2), (1_000, 0)):
        monkeypatch.setattr(timed_joins, "CROWD", crowd)
        for nulls in (True, False):
            cut.clear()
            got = overlap_join(a, b, ("a", "b"), ("a", "b"), "k", null_keys_match=nulls)
            assert got.columns == ["i", "k", "a_x", "b_x", "j", "a_y", "b_y"] and len(cut) == cuts
            assert sorted((r.i, r.j) for r in got.collect()) == wanted(left, right, nulls)
    stored.clear()
    same = overlap_join(a, a, ("a", "b"), ("a", "b"), "k")
    assert len(stored) == 1 and sorted((r.i_x, r.i_y) for r in same.collect()) == wanted(left, left, True)
