"""Mergeable summaries against whole columns, and exact rank tests against enumeration."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__  # noqa: F401, registers the queries
from lumenframe.operators import hypothesis as hy, summaries as sm

DAYS = 12


@pytest.fixture(scope="module")
def events(spark):
    rng = random.Random(5)
    rows = [(i, i % DAYS if i % 50 else None, rng.choice([None, float("nan"), 0.0, -0.0, rng.gauss(3, 40), float(i)]), f"u{rng.randint(1, 3_000)}" if i % 9 else None) for i in range(30_000)]
    df = spark.createDataFrame(rows, "i long, d int, v double, u string")
    return df.withColumn("day", F.timestamp_seconds(F.col("d") * 86_400 + 3_600)).drop("d").cache()


def check(events, merged):
    got = {r["column"]: r for r in sm.read_out(merged, [0.1, 0.5, 0.9]).collect()}
    frame = events.toPandas()
    v = frame["v"].dropna()
    assert got["v"].rows == len(frame) and got["v"].missing == frame["v"].isna().sum() and got["u"].missing == frame["u"].isna().sum()
    assert abs(got["v"].mean - v.mean()) < 1e-6 and abs(got["v"]["std"] - v.std()) < 1e-6 and (got["v"].min, got["v"].max) == (v.min(), v.max())
    assert abs(got["u"].distinct - frame["u"].nunique()) <= sm.DISTINCT_ERROR * frame["u"].nunique()
    assert abs(got["i"].distinct - len(frame)) <= sm.DISTINCT_ERROR * len(frame)
    for q, name in ((0.1, "q10"), (0.5, "q50"), (0.9, "q90")):
        assert (v < got["v"][name]).mean() <= q + sm.RANK_ERROR and (v <= got["v"][name]).mean() >= q - sm.RANK_ERROR
    assert got["u"].q50 is None and got["u"].mean is None and got["u"]["std"] is None


def test_merged_days_are_the_whole(spark, events, tmp_path):
    days = sm.summarise(events, ["i", "v", "u"], "day")
    assert days.count() == 3 * (DAYS + 1)
    check(events, sm.merge(days))
    check(events, sm.summarise(events, ["i", "v", "u"]))
    # Kept, with one day written again and one that comes later: nothing is counted twice.
    path = str(tmp_path / "kept")
    first = events.where("day is null or day < timestamp '1970-01-09'")
    sm.keep(sm.summarise(first, ["i", "v", "u"], "day"), path, "yyyyMMdd")
    sm.keep(sm.summarise(events.where("day >= timestamp '1970-01-08'"), ["i", "v", "u"], "day"), path, "yyyyMMdd")
    assert sm.kept(spark, path).count() == 3 * (DAYS + 1)
    check(events, sm.merge(sm.kept(spark, path)))


def test_no_value_is_shuffled(events):
    plan = sm.merge(sm.summarise(events, ["i", "v", "u"], "day"))._jdf.queryExecution().executedPlan().toString()
    keys = [line.split("hashpartitioning(")[1] for line in plan.splitlines() if "hashpartitioning(" in line]
    assert sorted(k.split("#")[0] for k in keys) == ["__period", "column"]


def test_empty_columns_and_tables(spark):
    empty = spark.createDataFrame([(None, None), (None, None)], "v double, u string")
    got = {r["column"]: r for r in sm.read_out(sm.merge(sm.summarise(empty))).collect()}
    assert got["v"].missing == 2 and got["v"].distinct == 0 and got["v"].q50 is None and got["v"].mean is None
    assert sm.read_out(sm.merge(sm.summarise(empty.limit(0), time=None))).where("rows > 0").count() == 0


def u_enumerated(a, b):
    """Two-sided p of U over all ways to deal the ranks."""
    both = sorted(a + b)
    u = sum(both.index(x) + 1 for x in a) - len(a) * (len(a) + 1) / 2
    low = min(u, len(a) * len(b) - u)
    sums = [sum(c) - len(a) * (len(a) + 1) / 2 for c in itertools.combinations(range(1, len(both) + 1), len(a))]
    return min(1.0, 2 * sum(s <= low for s in sums) / len(sums))


def test_rank_sums_are_exact_in_small_samples(spark):
    rng = random.Random(2)
    groups = {(n1, n2): (rng.sample(range(1_000), n1), rng.sample(range(1_000, 2_000), n2)) for n1 in range(3, 9) for n2 in (3, 5, 8)}
    groups = {k: ([x + 500 for x in a], [x - 300 for x in b]) for k, (a, b) in groups.items()}
    groups = {k: (a, b) for k, (a, b) in groups.items() if len(set(a + b)) == len(a + b)}
    rows = [(f"{k}", side, float(x)) for k, (a, b) in groups.items() for side, part in (("a", a), ("b", b)) for x in part] + [("tied", "a", 1.0), ("tied", "b", 1.0), ("alone", "a", 1.0), (None, "a", 1.0), (None, "b", 2.0)]
    df = spark.createDataFrame(rows, "g string, side string, v double")
    got = {r.g: r for r in hy.mann_whitney_per(df, "v", "side", ["a", "b"], ["g"]).collect()}
    for k, (a, b) in groups.items():
        assert got[f"{k}"].exact and abs(got[f"{k}"].p_value - u_enumerated(a, b)) < 1e-12, k
    assert not got["tied"].exact and got["alone"].p_value is None and got[None].p_value == 1.0
    one = hy.mann_whitney(df.where(F.col("g") == "(3, 5)"), "v", "side", ["a", "b"]).first()
    assert abs(one.p_value - got["(3, 5)"].p_value) < 1e-12
    # Nine and more on both sides: the normal form.
    large = spark.createDataFrame([("g", s, float(i * 2 + (s == "b"))) for s in "ab" for i in range(9)], "g string, side string, v double")
    assert not hy.mann_whitney_per(large, "v", "side", ["a", "b"], ["g"]).first().exact


def test_signed_ranks_are_exact_in_small_samples(spark):
    rng = random.Random(4)
    groups = {n: [x * rng.choice([-1, 1]) for x in rng.sample(range(1, 100), n)] for n in range(1, 13)}
    df = spark.createDataFrame([(n, float(x), 0.0) for n, xs in groups.items() for x in xs] + [(99, 0.0, 0.0), (98, 2.0, 0.0), (98, -2.0, 0.0)], "g int, a double, b double")
    got = {r.g: r for r in hy.wilcoxon_per(df, "a", "b", ["g"]).collect()}
    for n, xs in groups.items():
        order = sorted(abs(x) for x in xs)
        plus = sum(order.index(abs(x)) + 1 for x in xs if x > 0)
        low = min(plus, n * (n + 1) / 2 - plus)
        sums = [sum(i + 1 for i in range(n) if m >> i & 1) for m in range(1 << n)]
        assert got[n].exact and abs(got[n].p_value - min(1.0, 2 * sum(s <= low for s in sums) / len(sums))) < 1e-12
    assert 99 not in got and not got[98].exact
    assert abs(hy.wilcoxon(df.where("g = 7"), "a", "b").first().p_value - got[7].p_value) < 1e-12


def test_exact_figures_do_not_copy_rows_for_each_column(spark):
    from lumenframe.plans.registry import QUERIES
    plan = QUERIES["K1_E6_E7_merged_daily_summaries"].run(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Expand" not in plan
