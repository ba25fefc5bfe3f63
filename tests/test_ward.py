"""Ward's tree against a plain search over all pairs, its totals beyond the leaves, and edges."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.operators import ward as wd


def plain(points):
    """Merges of the cheapest pair, all pairs compared at every step: costs, and the groups at every k."""
    groups = {i: [i] for i in range(len(points))}
    costs, at = [], {len(points): sorted(map(tuple, groups.values()))}
    while len(groups) > 1:
        best = None
        for a in groups:
            for b in groups:
                if a < b:
                    x, y = points[groups[a]], points[groups[b]]
                    c = len(x) * len(y) / (len(x) + len(y)) * ((x.mean(axis=0) - y.mean(axis=0)) ** 2).sum()
                    if best is None or c < best[0]:
                        best = (c, a, b)
        costs.append(best[0])
        groups[best[1]] += groups.pop(best[2])
        at[len(groups)] = sorted(tuple(sorted(g)) for g in groups.values())
    return costs, at


def table(spark, points, parts=5):
    return spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(points)], "id int, " + ", ".join(f"c{j} double" for j in range(points.shape[1]))).repartition(parts)


@pytest.mark.parametrize("dims", [1, 3, 7])
def test_equals_all_pairs(spark, dims):
    rng = np.random.default_rng(dims)
    points = np.concatenate([rng.normal(c, 1 + c / 9, (15, dims)) for c in (0, 4, 11)])
    df, names = table(spark, points), [f"c{j}" for j in range(dims)]
    costs, at = plain(points)
    tree = wd.ward_tree(df, names, fan_in=2)
    assert np.allclose([r.cost for r in tree.merges.orderBy("step").collect()], costs)
    for k in (1, 2, 3, 8, len(points)):
        got = {}
        for r in wd.ward(df, names, k, fan_in=2).collect():
            got.setdefault(r.cluster, []).append(r.id)
        assert sorted(tuple(sorted(g)) for g in got.values()) == at[k]


def test_copies_count_as_often_as_they_occur(spark):
    rng = np.random.default_rng(8)
    points = rng.normal(0, 3, (12, 2))[rng.integers(0, 12, 60)]
    costs, _ = plain(points)
    tree = wd.ward_tree(table(spark, points), ["c0", "c1"])
    assert tree.leaves.agg(F.sum("n")).first()[0] == 60
    assert np.allclose([r.cost for r in tree.merges.orderBy("step").collect()], [c for c in costs if c > 1e-12])


def test_more_points_than_leaves(spark):
    rng = np.random.default_rng(4)
    centres = np.array([[0, 0, 0], [40, 0, 0], [0, 60, 0], [0, 0, 90]])
    side = rng.integers(0, 4, 20_000)
    points = centres[side] + rng.normal(0, 2, (20_000, 3))
    df, names = table(spark, points, 7), ["c0", "c1", "c2"]
    tree = wd.ward_tree(df, names, leaves=50, fan_in=3)
    held, made = tree.leaves.agg(F.count("*"), F.sum("n"), F.sum("ss")).first(), tree.merges.agg(F.sum("cost")).first()[0]
    assert held[0] <= 50 and held[1] == 20_000
    assert abs(held[2] + made - ((points - points.mean(axis=0)) ** 2).sum()) < 1e-6 * held[2]
    got = wd.ward(df, names, 4, leaves=50, fan_in=3).toPandas().sort_values("id")
    assert len(got) == 20_000 and len(set(zip(got["cluster"], side))) == 4


def test_gaps_equal_points_and_empty_tables(spark):
    df = spark.createDataFrame([(1, 2.0, 3.0), (2, None, 3.0), (3, float("nan"), 1.0), (4, float("inf"), 1.0), (5, 2.0, 3.0), (6, -0.0, 0.0), (7, 0.0, -0.0)], "id int, a double, b double")
    assert sorted((r.id, r.cluster) for r in wd.ward(df, ["a", "b"], 5).collect()) == [(1, 1), (5, 1), (6, 0), (7, 0)]
    assert wd.ward(df.limit(0), ["a", "b"], 2).count() == 0
    assert wd.ward_tree(df.where("id = 1"), ["a"]).merges.count() == 0
    for bad in ({"k": 0}, {"k": 1, "leaves": 0}, {"k": 1, "fan_in": 1}):
        with pytest.raises(ValueError):
            wd.ward(df, ["a"], **bad)


def test_products_that_cannot_tell_are_settled_by_differences():
    centres = 1e8 + np.array([[0.0], [1e-7], [2.0]])
    assert list(wd.nearest(centres.copy(), centres)) == [0, 1, 2]


def test_a_task_folds_all_its_points_before_it_halves_groups(spark):
    """5,000 different points over many batches of one task: the leaves are those of all points at once."""
    df = spark.range(60_000, numPartitions=1).select((F.col("id") * 7 % 50).cast("double").alias("a"), (F.col("id") * 13 % 100 * 3).cast("double").alias("b"))
    got = wd.features(df, ["a", "b"], leaves=40).toPandas()
    counts = df.groupBy("a", "b").count().toPandas()
    n, mean, ss = wd._fold(counts["count"].to_numpy(dtype=float), counts[["a", "b"]].to_numpy(), np.zeros(len(counts)), 40)
    assert sorted(got["n"]) == sorted(n)
    assert got["ss"].sum() == pytest.approx(ss.sum())
