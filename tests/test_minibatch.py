"""Mini-batch k-means: cost against full k-means, rates, a hot point, and edges."""

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from lumenframe.operators import clusters as cl, minibatch as mb


def blobs(spark, n=30_000, k=5, seed=3):
    rng = np.random.default_rng(seed)
    centres, side = rng.normal(0, 20, (k, 3)), rng.integers(0, k, n)
    x = centres[side] + rng.normal(0, 3, (n, 3))
    return spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "id int, a double, b double, c double"), centres


def test_cost_and_labels(spark):
    df, _ = blobs(spark)
    got = mb.minibatch_kmeans(df, ["id"], ["a", "b", "c"], 5, rounds=10, batch_rows=2_000).cache()
    full = KMeans(k=5, seed=1, initSteps=5).fit(VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(df)).summary.trainingCost
    assert got.count() == 30_000 and got.agg(F.sum("distance")).first()[0] <= 1.1 * full
    means = mb.minibatch_centres(df.repartition(9), ["id"], ["a", "b", "c"], 5, rounds=10, batch_rows=2_000).means
    rows = got.toPandas()
    x = rows[["a", "b", "c"]].to_numpy()
    far = ((x[:, None] - means) ** 2).sum(-1)
    # The same centres whatever the partitions, up to the order in which a sum is added up.
    assert np.allclose(far.min(axis=1), rows["distance"], atol=1e-6) and (far.argmin(axis=1) == rows["cluster"]).mean() > 0.9999


def test_batches_are_bounded_and_differ(spark):
    df, _ = blobs(spark)
    drawn = mb._batches(mb._points(df, ["a", "b", "c"]), ["id"], 8, 1_000, 7)
    sizes = [r[0] for r in drawn.groupBy("round").agg(F.sum("w")).select("sum(w)").collect()]
    assert len(sizes) == 8 and all(850 <= s <= 1_150 for s in sizes)
    assert drawn.select("x").distinct().count() > 6_500


def test_hot_point_gaps_and_few_points(spark):
    df = spark.range(20_000).selectExpr("id", "case when id % 3 = 0 then 7.0d when id % 3 = 1 then -5.0d when id % 1000 = 2 then null else 1.0d end as a")
    got = mb.minibatch_kmeans(df, ["id"], ["a"], 4)
    found = sorted((r.a, r.cluster, r.distance) for r in got.select("a", "cluster", "distance").distinct().collect())
    assert found == [(-5.0, 0, 0.0), (1.0, 1, 0.0), (7.0, 2, 0.0)]
    assert got.count() == df.where("a is not null").count()
    assert mb.minibatch_kmeans(df.where("a is null"), ["id"], ["a"], 2).count() == 0


def test_learners_by_name(spark):
    df, _ = blobs(spark, 600, 3)
    for name in ("hierarchical", "minibatch_kmeans", "bisecting"):
        out = cl.cluster(df, ["a", "b", "c"], 3, name, key="id")
        assert out.rows.count() == 600 and out.sizes.count() == 3 and out.silhouette > 0.5
