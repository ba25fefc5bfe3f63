"""Mini-batch k-means: centres move towards small batches, each at the rate of its own count.

One scan draws all batches by hash, so a round reads a bounded table and not the input. The
rounds change k centres only; the rows are read once more for their labels.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from lumenframe.functions.columns import col
from lumenframe.operators.ward import _points, nearest
from lumenframe.session import ensure_checkpoint_dir

PARTS = 1 << 40


class Centres(NamedTuple):
    means: np.ndarray
    counts: np.ndarray


def _batches(points: DataFrame, key: Sequence[str], rounds: int, batch_rows: int, seed: int) -> DataFrame:
    """(round, x, w): ``batch_rows`` rows a round, about, each round drawn anew; equal points of a batch are one row."""
    n = points.count()
    share = min(1.0, batch_rows / max(n, 1))
    row = F.xxhash64(*[col(k) for k in key])
    taken = F.filter(F.sequence(F.lit(0), F.lit(rounds - 1)), lambda i: F.pmod(F.xxhash64(row, i, F.lit(seed)), F.lit(PARTS)) < F.lit(int(share * PARTS)))
    drawn = points.select(F.col("__x").alias("x"), F.explode(taken).alias("round"))
    return drawn.groupBy("round", "x").agg(F.count(F.lit(1)).alias("w")).checkpoint()


def _spread_out(x: np.ndarray, w: np.ndarray, k: int, rng: np.random.Generator) -> tuple[float, np.ndarray]:
    """k starting points, each drawn with the weight of its squared distance to those before, and the cost."""
    chosen = [int(rng.choice(len(x), p=w / w.sum()))]
    far = ((x - x[chosen[0]]) ** 2).sum(axis=1)
    while len(chosen) < k:
        weight = w * far
        if weight.sum() == 0.0:
            break
        chosen.append(int(rng.choice(len(x), p=weight / weight.sum())))
        far = np.minimum(far, ((x - x[chosen[-1]]) ** 2).sum(axis=1))
    return float((w * far).sum()), x[chosen]


def minibatch_centres(df: DataFrame, key: Sequence[str], columns: Sequence[str], k: int, rounds: int = 30, batch_rows: int = 10_000,
                      starts: int = 5, seed: int = 42) -> Centres:
    """The centres after all rounds, in ascending order, and how many drawn rows moved each.

    The best of ``starts`` draws from the first batch begins. Fewer different points in that batch than k give
    as many centres. Rows with the same key are drawn together. Without complete rows there is no centre.
    """
    if k < 1 or rounds < 1 or batch_rows < 1 or not columns:
        raise ValueError("k, rounds, batch_rows and columns must be at least one")
    ensure_checkpoint_dir(df.sparkSession)
    batches = _batches(_points(df, columns), key, rounds, batch_rows, seed)
    first = batches.where("round = 0").toPandas()  # different points of one batch
    if not len(first):
        # A very small table can leave a batch empty: any drawn point may start.
        first = batches.groupBy("x").agg(F.sum("w").alias("w")).toPandas()
    if not len(first):
        return Centres(np.zeros((0, len(columns))), np.zeros(0))
    first = first.assign(x=[tuple(v) for v in first["x"]]).sort_values("x", ignore_index=True)
    x, w = np.array(first["x"].tolist(), dtype=float), first["w"].to_numpy(float)
    means = min((_spread_out(x, w, k, np.random.default_rng([seed, s])) for s in range(max(starts, 1))), key=lambda t: t[0])[1].copy()
    counts = np.zeros(len(means))
    for i in range(rounds):
        now = means.copy()

        @F.pandas_udf("int")
        def assigned(v: pd.Series) -> pd.Series:
            return pd.Series(nearest(np.stack(v.to_numpy()), now) if len(v) else [], dtype="int32")

        sums = [F.sum(F.col("w") * F.col("x")[j]) for j in range(len(columns))]
        for c, n, *total in batches.where(F.col("round") == i).groupBy(assigned("x").alias("c")).agg(F.sum("w"), *sums).collect():
            counts[c] += n
            means[c] += (np.array(total) - n * means[c]) / counts[c]
    order = np.lexsort(means.T[::-1])
    return Centres(means[order], counts[order])


def minibatch_kmeans(df: DataFrame, key: Sequence[str], columns: Sequence[str], k: int, rounds: int = 30, batch_rows: int = 10_000,
                     starts: int = 5, seed: int = 42) -> DataFrame:
    """Complete rows with ``cluster``, the nearest centre (ties: the smaller number), and its squared ``distance``."""
    means = minibatch_centres(df, key, columns, k, rounds, batch_rows, starts, seed).means

    @F.pandas_udf("cluster int, distance double")
    def assigned(v: pd.Series) -> pd.DataFrame:
        if not len(v):
            return pd.DataFrame({"cluster": pd.Series(dtype="int32"), "distance": pd.Series(dtype=float)})
        x = np.stack(v.to_numpy())
        c = nearest(x, means)
        return pd.DataFrame({"cluster": c.astype("int32"), "distance": ((x - means[c]) ** 2).sum(axis=1)})

    return _points(df, columns).withColumn("__c", assigned("__x")).select(*[col(c) for c in df.columns], "__c.cluster", "__c.distance")
