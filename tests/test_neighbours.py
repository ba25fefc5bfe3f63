"""Neighbour joins, outlier factors, imputation and density clusters against brute force."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lumenframe.operators import isolation, neighbours
from lumenframe.operators.components import connected_components
from lumenframe.operators.dbscan import dbscan
from lumenframe.operators.isolation import isolation_scores, model_outliers
from lumenframe.operators.neighbours import knn_impute, knn_join, knn_predict, local_outlier_factor


@pytest.fixture(scope="module")
def cloud():
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(0, .3, (100, 2)), rng.normal(3, .5, (100, 2)), np.repeat([[1.0, 1.0]], 90, 0),
                        rng.uniform(-2, 6, (60, 2))])
    return pd.DataFrame({"id": np.arange(len(x)), "a": x[:, 0], "b": x[:, 1]})


def distances(p):
    x = p[["a", "b"]].to_numpy()
    return np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))


def test_knn_join_is_exact_with_copies(spark, cloud):
    points = spark.createDataFrame(cloud).select("id", F.array("a", "b").alias("x"))
    got = knn_join(points, points, 5, pivots=12, chunk_rows=40, exclude_self=True).toPandas()
    dist = distances(cloud)
    np.fill_diagonal(dist, np.inf)
    order = np.lexsort((np.broadcast_to(np.arange(len(cloud)), dist.shape), dist), axis=1)[:, :5]
    near = got.sort_values(["query", "distance", "neighbour"]).groupby("query").neighbour.apply(list).sort_index()
    assert (np.array(near.tolist()) == order).all()


def test_local_outlier_factor(spark, cloud):
    got = local_outlier_factor(spark.createDataFrame(cloud), "id", ["a", "b"], 8, pivots=10, chunk_rows=60).toPandas().sort_values("id")
    dist = distances(cloud)
    np.fill_diagonal(dist, np.inf)
    near = np.lexsort((np.broadcast_to(np.arange(len(cloud)), dist.shape), dist), axis=1)[:, :8]
    own = np.take_along_axis(dist, near, 1)
    reach = np.maximum(own[:, -1][near], own)
    lrd = 1 / (reach.mean(1) + 1e-10)
    np.testing.assert_allclose(got.lof, (lrd[near] / lrd[:, None]).mean(1), rtol=1e-9)


def test_knn_impute_matches_nan_euclidean(spark, cloud):
    rng = np.random.default_rng(5)
    p = cloud.assign(c=rng.normal(size=len(cloud)))
    for c in ("a", "c"):
        p.loc[rng.random(len(p)) < .1, c] = np.nan
    got = knn_impute(spark.createDataFrame(p), "id", k=3, pivots=8, chunk_rows=100).toPandas().sort_values("id")
    v = p[["a", "b", "c"]].to_numpy()
    known = ~np.isnan(v)
    both = known[:, None] & known[None]
    z = np.where(known, v, 0)
    shared = both.sum(2)
    dist = np.sqrt(3 / np.maximum(shared, 1) * (((z[:, None] - z[None]) ** 2) * both).sum(2))
    expected = v.copy()
    for i, j in zip(*np.nonzero(~known)):
        givers = np.flatnonzero(known[:, j] & (shared[i] > 0))
        expected[i, j] = v[givers[np.lexsort((givers, dist[i][givers]))[:3]], j].mean()
    np.testing.assert_allclose(got[["a", "b", "c"]], expected)


def test_knn_impute_shares_cells_between_rare_patterns(spark, cloud, monkeypatch):
    """Repeated rows, all-gap rows, untouched columns and patterns beyond the ones with cells of their own."""
    rng = np.random.default_rng(8)
    p = cloud.assign(c=rng.normal(size=len(cloud)), e=rng.normal(size=len(cloud)).round(1))
    for c in "abce":
        p.loc[rng.random(len(p)) < .2, c] = np.nan
    p.loc[5, list("abce")] = np.nan
    df = spark.createDataFrame(p).withColumn("row", F.when(F.col("id") % 3 == 0, float("nan")).otherwise(1.0))
    fill = lambda **k: knn_impute(df, "id", list("abce"), k=3, chunk_rows=50, **k).orderBy("id")
    whole = fill(pivots=20)
    assert whole.where(F.isnan("row")).count() == df.where("id % 3 = 0").count() and whole.columns == df.columns
    monkeypatch.setattr("lumenframe.operators.neighbours.MAX_PATTERNS", 2)
    got, shared = whole.toPandas(), fill(pivots=3).toPandas()
    v = p[list("abce")].to_numpy()
    known, z = ~np.isnan(v), np.nan_to_num(v)
    both = known[:, None] & known[None]
    count = both.sum(2)
    dist = np.sqrt((((z[:, None] - z[None]) ** 2) * both).sum(2)) * np.sqrt(4 / np.maximum(count, 1))
    want = v.copy()
    for i, j in zip(*np.nonzero(~known)):
        givers = np.flatnonzero(known[:, j] & (count[i] > 0))
        want[i, j] = v[givers[np.lexsort((givers, dist[i][givers]))[:3]], j].mean() if len(givers) else np.nanmedian(v[:, j])
    np.testing.assert_allclose(got[list("abce")], want)
    np.testing.assert_allclose(shared[list("abce")], want)
    assert knn_impute(df.limit(0), "id").count() == 0


def test_knn_predict_classes(spark):
    train = spark.createDataFrame([(i, float(i), "low" if i < 10 else "high") for i in range(20)], "id long, v double, y string")
    asked = spark.createDataFrame([(100, 2.2), (101, 17.0), (102, None)], "id long, v double")
    got = {r.id: r.prediction for r in knn_predict(train, asked, "id", ["v"], "y", 3).collect()}
    assert got == {100: "low", 101: "high", 102: None}


@pytest.mark.parametrize("eps,least", [(.3, 5), (.6, 12)])
def test_dbscan(spark, cloud, eps, least):
    got = dbscan(spark.createDataFrame(cloud), "id", ["a", "b"], eps, least, chunk_rows=25).toPandas().sort_values("id").cluster.to_numpy()
    close = distances(cloud) <= eps
    core = close.sum(1) >= least
    expected, count = np.full(len(cloud), -1), 0
    for i in np.flatnonzero(core):
        if expected[i] < 0:
            stack = [i]
            expected[i] = count
            while stack:
                for j in np.flatnonzero(close[stack.pop()] & core):
                    if expected[j] < 0:
                        expected[j] = count
                        stack.append(j)
            count += 1
    labels = expected.copy()
    for i in np.flatnonzero(~core):
        near = np.flatnonzero(close[i] & core)
        labels[i] = expected[near.min()] if len(near) else -1
    assert (got == labels).all()


def test_components_of_a_long_chain(spark):
    nodes = spark.range(40).select(F.col("id").alias("node"))
    edges = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(30, 35), (35, 33)], "a long, b long")
    got = {r.node: r.component for r in connected_components(nodes, edges).collect()}
    assert all(got[i] == 0 for i in range(21)) and got[25] == 25 and got[35] == got[33] == got[30] == 30


def test_isolation_forest_finds_planted_outliers(spark, cloud):
    planted = pd.concat([cloud, pd.DataFrame({"id": [900, 901], "a": [40., -30.], "b": [50., 60.]})])
    df = spark.createDataFrame(planted)
    scores = isolation_scores(df, "id", ["a", "b"], trees=40).toPandas().sort_values("score")
    assert set(scores.id.tail(2)) == {900, 901} and scores.score.between(0, 1).all()
    again = isolation_scores(df.repartition(3), "id", ["a", "b"], trees=40).toPandas().sort_values("score")
    np.testing.assert_allclose(scores.score, again.score)
    kept = model_outliers(df, "id", ["a", "b"], action="remove", contamination=.01, trees=40)
    assert kept.where("id >= 900").count() == 0


def test_forest_scores_are_dealt_and_equal_a_walk_of_each_tree(spark, cloud, monkeypatch):
    monkeypatch.setattr(isolation, "SCORED_ROWS", 50)
    one = spark.createDataFrame(cloud).coalesce(1)
    assert isolation_scores(one, "id", ["a", "b"], trees=5).rdd.getNumPartitions() == 7
    x = cloud[["a", "b"]].to_numpy()
    trees = [isolation._grow(x[i::7], 5, np.random.default_rng(i)) for i in range(4)]

    def walk(tree, row, depth=0):
        return depth + float(isolation._average_path(tree[0])) if len(tree) == 1 else walk(tree[2 if row[tree[0]] < tree[1] else 3], row, depth + 1)

    np.testing.assert_allclose(isolation._mean_path(isolation._flat(trees), x), [sum(walk(t, row) for t in trees) / 4 for row in x], rtol=1e-14)

def test_ties_at_the_last_distance_leave_a_chunk_k_times_only():
    rng = np.random.default_rng(2)
    dist = rng.integers(0, 4, (50, 400)).astype(float)
    dist[7], dist[8, :398] = 1.0, np.nan
    for k in (1, 3, 60):
        rows, hits = neighbours._nearest_hits(dist, k)
        for i in range(50):
            got = sorted((dist[i, j], j) for j in hits[rows == i])
            assert got[:k] == sorted((d, j) for j, d in enumerate(dist[i]) if d == d)[:k] or (i == 8 and k > 2)
            assert len(got) < 2 * k


def test_many_ties_go_to_the_smallest_keys(spark):
    """Places that differ only in the wanted column are all as near: 300 at each distance."""
    df = spark.range(900).select("id", (F.col("id") % 3).cast("double").alias("a"), F.when(F.col("id") % 50 != 0, 899.0 - F.col("id")).alias("v"))
    got = {r.id: r.v for r in knn_impute(df, "id", k=4, chunk_rows=60).collect()}
    want = {i: np.mean([899 - j for j in [j for j in range(900) if j % 50 and j % 3 == i % 3][:4]]) for i in range(0, 900, 50)}
    assert {i: got[i] for i in want} == pytest.approx(want)
