"""Density clusters in many columns against brute force."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lumenframe.operators.balls import Cells, _bridges, _forest, ball_labels
from lumenframe.operators.dbscan import dbscan

D = 6
NAMES = [f"c{i}" for i in range(D)]


def frame(x):
    return pd.DataFrame(x, columns=NAMES).assign(id=np.arange(len(x)))


def expected(x, eps, least):
    close = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)) <= eps
    core = close.sum(1) >= least
    label, count = np.full(len(x), -1), 0
    for i in np.flatnonzero(core):
        if label[i] < 0:
            stack, label[i] = [i], count
            while stack:
                more = np.flatnonzero(close[stack.pop()] & core & (label < 0))
                label[more] = count
                stack += list(more)
            count += 1
    for i in np.flatnonzero(~core):
        near = np.flatnonzero(close[i] & core)
        label[i] = label[near.min()] if len(near) else -1
    return label


@pytest.fixture(scope="module")
def mixed():
    rng = np.random.default_rng(11)
    blob = rng.normal(0, .2, (120, D))
    line = np.zeros((60, D))
    line[:, 0] = np.arange(60) * .25 + 3
    copies = np.repeat(rng.normal(-3, .1, (3, D)), 40, 0)
    return rng.permutation(np.concatenate([blob, line, copies, rng.uniform(-4, 4, (60, D)), blob[:30] + np.eye(D)[0] * 1.4]))


@pytest.mark.parametrize("eps,least", [(.5, 4), (.3, 2), (1.6, 5)])
def test_many_columns_match_brute_force(spark, mixed, eps, least):
    got = dbscan(spark.createDataFrame(frame(mixed)), "id", NAMES, eps, least, chunk_rows=30).toPandas().sort_values("id")
    assert (got.cluster.to_numpy() == expected(mixed, eps, least)).all()


def test_clusters_that_touch_away_from_first_points(spark):
    """Two wide balls whose first points are farther than eps apart, with one close pair of edge points."""
    x = np.zeros((12, D))
    x[:6, 0] = [0, .1, .2, .3, .4, .5]
    x[6:, 0] = [1.9, 1.8, 1.7, 1.6, 1.5, 1.45]
    for eps, clusters in ((1.0, 1), (.94, 2)):
        got = dbscan(spark.createDataFrame(frame(x)), "id", NAMES, eps, 6, chunk_rows=5).toPandas().sort_values("id")
        assert (got.cluster.to_numpy() == expected(x, eps, 6)).all() and got.cluster.nunique() == clusters


def test_bounds_of_links():
    """A task hands on fewer links than it has balls, however many are close."""
    rng = np.random.default_rng(2)
    x = list(rng.normal(0, .1, (200, D)))
    q = pd.DataFrame({"node": np.arange(200), "x": x, "label": np.arange(200)})
    assert len(_forest(5.0)(q, q)) <= 400
    assert len(_bridges(5.0)(q, q)) == 199


def test_gaps_text_keys_and_no_rows(spark, mixed):
    data = frame(mixed[:150]).assign(id=[f"k{i:03d}" for i in range(150)])
    df = spark.createDataFrame(data).withColumn("c2", F.when(F.col("id") != "k007", F.col("c2")))
    got = dbscan(df, "id", NAMES, .6, 4, chunk_rows=40).toPandas().sort_values("id")
    assert "k007" not in set(got.id)
    assert (got.cluster.to_numpy() == expected(np.delete(mixed[:150], 7, 0), .6, 4)).all()
    assert dbscan(df.limit(0), "id", NAMES, .6, 4).count() == 0
    with pytest.raises(ValueError):
        dbscan(df, "id", [], .6)


def test_pivots_do_not_change_labels(spark, mixed):
    places = spark.createDataFrame(frame(mixed)).groupBy(F.array(*NAMES).alias("x")).agg(F.count("*").alias("w"), F.min("id").alias("id"))
    one, many = (sorted(map(tuple, ball_labels(places, .5, 4, 25, pivots=n).collect())) for n in (1, 40))
    assert one == many


def test_visits_grow_as_the_points(spark, monkeypatch):
    """Points of a dense table find their neighbours in their chunk, and balls of its largest cluster visit a few cells only."""
    seen, visits = [], Cells._visits

    def counted(*args, **more):
        out = visits(*args, **more)
        seen.append(out.count())
        return out
    monkeypatch.setattr(Cells, "_visits", counted)
    x = np.random.default_rng(5).normal(0, .12, (3_000, D))
    places = spark.createDataFrame(frame(x)).select("id", F.lit(1).cast("long").alias("w"), F.array(*NAMES).alias("x"))
    got = ball_labels(places, .22, 4, 20_000).toPandas().set_index("id").label
    want = expected(x, .22, 4)
    assert sorted(got.index) == list(np.flatnonzero(want >= 0))
    assert (np.searchsorted(np.unique(got), got.sort_index()) == want[want >= 0]).all()
    assert len(got) > 2_500 and sum(seen) < 6 * len(x)      # of 54 cells
