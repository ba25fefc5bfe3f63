"""Centroid clustering against whole-number arithmetic without planes."""

import hashlib
import math

import numpy as np
import pytest

from lumenframe.llm.centroids import assign, centroid_clusters, components_of, planes_of, products

VECTORS = "vec_id long, embedding array<float>, label int, cluster string, v string, planes string"


def brute(rows, k=40, rounds=5, seed=2):
    kept = [(i, tuple(math.floor(256 * float(x)) for x in v)) for i, v in rows
            if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [list(v) for _, v in order[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        for j, members in groups.items():
            centroids[j] = [sum(c) // len(members) for c in zip(*members)]
    out = [(i, *near(v)[::-1]) for i, v in kept]
    per = {}
    for _, j, d in out:
        per[j] = per.get(j, 0) + d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted((str(i), j, d, per[j], sum(per.values()), digest[j]) for i, j, d in out)


def found(df):
    return sorted((str(r.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in df.collect())


def made(spark, rows):
    return spark.createDataFrame([(i, v, 1, "c", "v", "p") for i, v in rows], VECTORS)


def normal(n, seed, spread=1.0):
    rng = np.random.default_rng(seed)
    return [(i * 3, [float(x) for x in row]) for i, row in enumerate((rng.normal(size=(n, 64)) * spread).astype(np.float32))]


@pytest.mark.parametrize("bits", [1, 5, 12, 28])
def test_planes_give_exact_products(bits):
    rng = np.random.default_rng(bits)
    a, b = rng.integers(0, 1 << bits, (50, 64)), rng.integers(0, 1 << bits, (7, 64))
    a[0], b[0] = (1 << bits) - 1, 0
    assert (components_of(planes_of(a, bits)) == a).all()
    want = a.astype(object) @ b.astype(object).T
    assert (products(planes_of(a, bits)[:, None, :], planes_of(b, bits)[None]) == want).all()
    home, distance = assign(planes_of(a, bits), planes_of(b, bits))
    apart = ((a[:, None, :].astype(object) - b[None].astype(object)) ** 2).sum(axis=2)
    assert (distance == apart.min(axis=1)).all() and (home == apart.argmin(axis=1)).all()


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_tables(spark, folder):
    table = spark.read.parquet(f"/root/testdata/{folder}/embeddings.parquet")
    assert found(centroid_clusters(table)) == brute([(r.vec_id, r.embedding) for r in table.collect()])


def test_left_out_vectors_ties_and_repeated_rows(spark):
    rows = normal(60, 1, 0.02) + [(7, [0.0] * 64), (7, [0.0] * 64), (7, [1.0] * 64), (None, [0.5] * 64), (1, None), (2, []), (4, [1.0] * 63), (5, [1.0] * 65),
                                  (8, [float("nan")] + [1.0] * 63), (10, [float("inf")] * 64), (11, [None] + [1.0] * 63), (13, [-0.0] * 64)]
    assert found(centroid_clusters(made(spark, rows).repartition(5))) == brute(rows)
    same = [(i, [0.25] * 64) for i in range(50)]
    got = found(centroid_clusters(made(spark, same), clusters=3))
    assert got == brute(same, 3) and {r[1] for r in got} == {0}


def test_few_and_no_vectors(spark):
    for rows in (normal(5, 2), [(1, [3.0] * 64)]):
        assert found(centroid_clusters(made(spark, rows))) == brute(rows)
    empty = centroid_clusters(made(spark, []))
    assert empty.count() == 0 and empty.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert centroid_clusters(made(spark, [(1, None), (None, [1.0])])).count() == 0


def test_wide_components(spark):
    rows = [(i, [float((-1) ** (i + c) * (5e5 if i % 3 else 1e-3) + i) for c in range(64)]) for i in range(30)]
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in rows]
    assert found(centroid_clusters(made(spark, rows), clusters=4)) == brute(rows, 4)
    with pytest.raises(ValueError):
        centroid_clusters(made(spark, [(1, [1e30] * 64), (2, [0.0] * 64)]))
