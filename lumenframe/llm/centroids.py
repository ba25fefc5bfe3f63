"""Centroid clustering on bit planes: exact integer distances from AND and popcount.

A component x becomes the integer floor(256 * x). Less the smallest of the table, the integers are
small and not negative, so bit b of all 64 components fits in one uint64, the plane b of the vector.
The product of two vectors is the sum over plane pairs of 2^(i+j) times the ones that plane i of one
and plane j of the other share; distances follow from products, and the shift cancels out of them.
Rounds hand back one row of sums for each centroid and task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from lumenframe.llm.tables import written

DIM = 64                # components of a vector: the bits of a plane
SCALE = 256
MAX_BITS = 28           # planes: 64 squares of 28 bits fit a signed 64-bit number
CHUNK = 2_048           # vectors compared at once


def planes_of(values: np.ndarray, bits: int) -> np.ndarray:
    """(vectors, bits) uint64: bit c of plane b is bit b of component c."""
    out = np.empty((len(values), bits), np.uint64)
    for b in range(bits):
        ones = ((values >> b) & 1).astype(np.uint8)
        out[:, b] = np.packbits(ones, axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def components_of(planes: np.ndarray) -> np.ndarray:
    """The integers of each vector again, (vectors, 64)."""
    ones = np.unpackbits(np.ascontiguousarray(planes).view(np.uint8).reshape(*planes.shape, 8), axis=2, bitorder="little")
    return np.einsum("vbc,b->vc", ones.astype(np.int64), np.int64(1) << np.arange(planes.shape[1], dtype=np.int64))


def products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Exact dot products of planes that broadcast against each other along all axes but the last."""
    bits = left.shape[-1]
    total = np.zeros(np.broadcast_shapes(left.shape[:-1], right.shape[:-1]), np.int64)
    for weight in range(2 * bits - 1):
        ones = np.zeros(total.shape, np.uint16)
        for i in range(max(0, weight - bits + 1), min(weight, bits - 1) + 1):
            ones += np.bitwise_count(left[..., i] & right[..., weight - i])
        total += ones.astype(np.int64) << weight
    return total


def assign(planes: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid (ties: the smaller number) and squared distance of each vector."""
    home, distance = np.empty(len(planes), np.int64), np.empty(len(planes), np.int64)
    size = products(centroids, centroids)
    for at in range(0, len(planes), CHUNK):
        some = planes[at:at + CHUNK]
        apart = products(some, some)[:, None] + size[None, :] - 2 * products(some[:, None, :], centroids[None, :, :])
        home[at:at + CHUNK] = apart.argmin(axis=1)
        distance[at:at + CHUNK] = apart.min(axis=1)
    return home, distance


def stacked(column: pd.Series, bits: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), "<u8").reshape(len(column), bits)


def centroid_clusters(table: DataFrame, clusters: int = 40, rounds: int = 5, seed: int = 2, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector of 64 finite components.

    Vectors that are null, have another length or hold a null or a non-finite component are left
    out. The first centroids are the vectors with the smallest sha256 of "seed:id", all vectors if
    there are fewer; rows that repeat an id start in the order of their components, a null id comes
    last. Equal distances go to the smaller centroid, so repeated rows share a cluster. Centroids
    are floored means; one without vectors stays. Distances are exact: they need components whose
    integers lie less than 2^28 apart, otherwise they would not fit a long, and ValueError is
    raised. Other columns are left out; an empty table gives no rows.
    """
    spark = table.sparkSession
    whole = table.select(F.col(id).cast("long").alias("vec"), F.col(vector).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = whole.where(F.coalesce((F.size("v") == DIM) & finite, F.lit(False)))
    ends = kept.agg(F.min(F.array_min("v")).alias("low"), F.max(F.array_max("v")).alias("high")).first()
    schema = "vec long, cluster int, distance long"
    if ends.low is None:
        placed, digests = spark.createDataFrame([], schema), [""]
    else:
        if abs(ends.low) > 2.0 ** 40 or abs(ends.high) > 2.0 ** 40:
            raise ValueError("components lie too far apart for 64-bit distances")
        low, high = int(np.floor(SCALE * ends.low)), int(np.floor(SCALE * ends.high))
        bits = max(1, (high - low).bit_length())
        if bits > MAX_BITS:
            raise ValueError("components lie too far apart for 64-bit distances")

        def packed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for at in range(0, len(frame), CHUNK):
                    some = frame.iloc[at:at + CHUNK]
                    values = np.floor(SCALE * np.stack(some["v"].to_numpy())).astype(np.int64) - low
                    yield pd.DataFrame({"vec": some["vec"], "planes": [r.tobytes() for r in planes_of(values, bits)]})

        planes = written(kept.mapInPandas(packed, "vec long, planes binary"), "planes")
        seeds = planes.orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec").cast("string")), 256).asc_nulls_last(), "planes").limit(clusters)
        centroids = components_of(np.stack([np.frombuffer(r.planes, "<u8") for r in seeds.collect()]))
        for _ in range(rounds):
            centroids = moved(planes, centroids, bits)
        shared = planes_of(centroids, bits)

        def settle(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                home, distance = assign(stacked(frame["planes"], bits), shared) if len(frame) else ([], [])
                yield pd.DataFrame({"vec": frame["vec"], "cluster": home, "distance": distance}).astype({"cluster": "int32", "distance": "int64"})

        placed = written(planes.mapInPandas(settle, schema), "clusters")
        digests = [hashlib.sha256(",".join(str(int(c) + low) for c in row).encode()).hexdigest() for row in centroids]
    per_cluster = placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("cluster_inertia"))
    in_all = per_cluster.agg(F.sum("cluster_inertia").alias("inertia"))
    # One row for each centroid, ``clusters`` at most.
    sums = per_cluster.crossJoin(F.broadcast(in_all))
    return placed.join(F.broadcast(sums), "cluster").select(
        F.col("vec").alias(id), "cluster", "distance", F.col("cluster_inertia").cast("long").alias("cluster_inertia"),
        F.col("inertia").cast("long").alias("inertia"), F.array(*[F.lit(d) for d in digests])[F.col("cluster")].alias("centroid_sha256"))


def moved(planes: DataFrame, centroids: np.ndarray, bits: int) -> np.ndarray:
    """The centroids after a round: floored means of the vectors that are nearest to each."""
    shared = planes_of(centroids, bits)
    columns = [f"s{i}" for i in range(DIM)]

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums, count = np.zeros((len(shared), DIM), np.int64), np.zeros(len(shared), np.int64)
        for frame in frames:
            rows = stacked(frame["planes"], bits)
            for at in range(0, len(rows), CHUNK):
                some = rows[at:at + CHUNK]
                home, _ = assign(some, shared)
                np.add.at(sums, home, components_of(some))
                count += np.bincount(home, minlength=len(shared))
        out = pd.DataFrame(sums, columns=columns).assign(cluster=np.arange(len(shared)), n=count)
        yield out[count > 0]

    parts = planes.mapInPandas(partial, ", ".join(f"{c} long" for c in columns) + ", cluster long, n long")
    total = parts.groupBy("cluster").agg(*[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in [*columns, "n"]])
    after = centroids.copy()
    for r in total.collect():  # one row for each centroid
        after[r.cluster] = [int(r[c]) // int(r.n) for c in columns]
    return after
